"""Feed export, line conversion and feed checks as plain Spark jobs."""

from feedmill.spec import CheckSpec, FeedSpec, LineFormat

__all__ = ["CheckSpec", "FeedSpec", "LineFormat"]
