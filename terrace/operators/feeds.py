"""Combining feeds: source preference, unions, rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """All feeds by column name; columns a feed lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def prefer_sources(rows: DataFrame, keys: list[str], priority: str = "priority", present: DataFrame | None = None) -> DataFrame:
    """Keep, per key, only the rows of its best (lowest) source.

    ``present`` lists (keys, priority) of sources that win by existing, even with
    no rows.  The best priority is a small aggregate joined back, so a key with very
    many rows is never gathered into one window.
    """
    seen = rows.select(*keys, priority)
    if present is not None:
        seen = seen.unionByName(present.select(*keys, priority))
    best = seen.groupBy(*keys).agg(F.min(priority).alias(priority))
    return rows.join(best, [*keys, priority], "left_semi")


def with_sequence(rows: DataFrame, order: list[str]) -> DataFrame:
    """A stable tie-break number over the load order, without a global sort task."""
    from terrace.scale import number_rows

    return number_rows(rows, order, "match_seq")


def rejected_count(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: rows read, rows kept, rows dropped."""
    n, k = raw.agg(F.count("*")).scalar(), parsed.agg(F.count("*").alias("kept"))
    return k.select(n.alias("read"), "kept", (n - F.col("kept")).alias("rejected"))


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Fill ``value`` with the last non-null one seen so far inside the key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
