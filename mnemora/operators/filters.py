"""Filters as columns, which Catalyst can push to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(tags: Column, wanted: list[str] | tuple[str, ...]) -> Column:
    """Any tag in common; an empty list matches nothing."""
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def one_of(column: Column, values: list | tuple) -> Column:
    return column.isin(*values) if values else F.lit(False)


def every(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


@dataclass(frozen=True)
class SearchFilter:
    domains: tuple[str, ...] | None = None
    types: tuple[int, ...] | None = None
    min_importance: float | None = None
    min_confidence: float | None = None
    since_ms: int | None = None
    exclude_archived: bool = True

    def column(self) -> Column:
        c = []
        if self.exclude_archived:
            c.append(~F.col("archived"))
        if self.domains is not None:
            c.append(overlap(F.col("domain"), self.domains))
        if self.types is not None:
            c.append(one_of(F.col("type_tag"), self.types))
        if self.min_importance is not None:
            c.append(F.col("importance") >= self.min_importance)
        if self.min_confidence is not None:
            c.append(F.col("confidence") >= self.min_confidence)
        if self.since_ms is not None:
            c.append(F.col("ts_ms") >= self.since_ms)
        return every(c)


    def matches(self, row: dict) -> bool:
        """The same for one row in hand."""
        return (
            not (self.exclude_archived and row["archived"])
            and (self.domains is None or bool({x for x in row["domain"] or () if x is not None} & set(self.domains)))
            and (self.types is None or row["type_tag"] in self.types)
            and (self.min_importance is None or row["importance"] >= self.min_importance)
            and (self.min_confidence is None or row["confidence"] >= self.min_confidence)
            and (self.since_ms is None or row["ts_ms"] >= self.since_ms)
        )


@dataclass(frozen=True)
class WatchFilter:
    domains: tuple[str, ...] | None = None
    types: tuple[int, ...] | None = None
    min_importance: float | None = None

    def column(self) -> Column:
        return SearchFilter(self.domains, self.types, self.min_importance, exclude_archived=False).column()


def fresh(now_ms: Column | int, seconds: float) -> Column:
    """Heartbeat within the threshold, its edge included."""
    return F.col("last_heartbeat_ms") >= now_ms - F.lit(int(seconds * 1000))
