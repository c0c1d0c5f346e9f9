"""Continuous conversion by repeated batches, whose memory of names is a table instead of the driver's."""

from __future__ import annotations

import time
from collections.abc import Iterator
from threading import Event

from pyspark.sql import SparkSession

from feedmill.plans.convert import LineFeed, run_line_feeds
from feedmill.sinks.ledger import MoveLog, SeenFiles

# Fixed value: seconds between polls.
PERIOD = 60.0


def poll_feeds(
    spark: SparkSession,
    feeds: list[LineFeed],
    out_dir: str,
    reject_dir: str,
    seen: SeenFiles,
    moves: MoveLog | None = None,
    period: float = PERIOD,
    rounds: int | None = None,
    stop: Event | None = None,
    compact_every: int = 1000,
) -> Iterator[list[str]]:
    """Convert what is new in the feeds' folders, once a ``period`` in seconds; after each poll, the feeds that had new files.

    A name is processed once, after any gap and whatever the file's age: the names are in ``seen``, of which a poll reads only
    the parts that the names in the folder fall in. Feeds with an archive keep their folders short, so a poll lists only what
    is new. A lost run is taken up by the next, as each poll is a batch of its own. Ends after ``rounds`` polls, or when
    ``stop`` is set; the names' small files are merged every so many polls.
    """
    done = 0
    while (rounds is None or done < rounds) and not (stop and stop.is_set()):
        begun = time.monotonic()
        yield run_line_feeds(spark, feeds, out_dir, reject_dir, seen, moves)
        done += 1
        if done % compact_every == 0:
            seen.compact()
        rest = begun + period - time.monotonic()
        if rest > 0 and done != rounds:
            stop.wait(rest) if stop else time.sleep(rest)
