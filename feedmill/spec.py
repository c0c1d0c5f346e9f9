"""What a user declares: feeds, checks and line formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class FeedSpec:
    """One export.

    ``sql`` may use ``:start_pkid`` and ``:end_pkid``. A feed with ``table`` and ``key`` is
    incremental over that key; one without is exported in full each run. ``order_by`` names
    result columns and should end in a unique one, so that row numbers are repeatable.
    ``columns`` are the rendered columns by position (a name may occur twice); by default all.
    ``chunk_rows`` of None takes the run's default, and 0 means unsplit. ``overlap`` starts each
    range that many keys below the mark, to pick up keys committed late, at the price of repeats.
    ``top_key`` asks the source for its highest key above a mark (None: of all), where it can tell without its rows being
    read, for instance a database through ``max_key_jdbc``; by default the table is asked.
    """

    name: str
    sql: str
    order_by: tuple[str, ...]
    columns: tuple[str, ...] = ()
    table: str | None = None
    key: str | None = None
    chunk_rows: int | None = None
    enabled: bool = True
    file_name: str = "FEED-[DT].dat"
    overlap: int = 0
    top_key: Callable[[int | None], int | None] | None = None

    def __post_init__(self):
        if not self.order_by:
            raise ValueError(f"feed {self.name}: order_by fixes the rows of each file and cannot be empty")
        if (self.table is None) != (self.key is None):
            raise ValueError(f"feed {self.name}: table and key go together")

    @property
    def incremental(self) -> bool:
        return self.table is not None and self.key is not None

    def rows_per_file(self, default: int) -> int:
        return default if self.chunk_rows is None else self.chunk_rows


@dataclass(frozen=True)
class CheckSpec:
    """Rows expected in ``table`` within the last ``minutes`` before the check time."""

    name: str
    table: str
    time_column: str
    minutes: int
    min_rows: int
    enabled: bool = True


@dataclass(frozen=True)
class LineFormat:
    """A delimited input line: its fields by position and which of them are checked.

    The checks run in this order and the first failing one names the reject: field count,
    time missing, time unreadable, id missing, code missing, code too long, numbers unreadable.

    Lines are bytes: they are cut, measured and written again byte by byte, whatever their ``encoding`` (any that keeps ASCII);
    a code list is compared in it. With ``validated`` a line that is not valid UTF-8 is rejected first, as ``bad_encoding``.
    """

    fields: tuple[str, ...]
    code_field: str
    time_field: str | None = None
    id_field: str | None = None
    number_fields: tuple[str, ...] = ()
    delimiter: str = ","
    max_code_bytes: int = 50
    encoding: str = "utf-8"
    validated: bool = False

    def as_bytes(self, text: str) -> str:
        """A literal as it stands in lines that were taken byte by byte."""
        return text.encode(self.encoding).decode("latin-1")
