"""As-of joins on a month or day grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], strict: bool = False
) -> DataFrame:
    """Attach the latest ``right`` values at or before (``strict``: before) ``left.on``.

    Both sides are first reduced to one row per (keys, on), so the ordered window
    sees at most one row per key and calendar unit however many rows share it; the
    result goes back to ``left`` by an equi-join.  ``right`` holds one row per
    (keys, on).
    """
    body = F.struct(*values)
    points = (
        right.select(*keys, on, body.alias("_v"), F.lit(False).alias("_asked"))
        .unionAll(left.select(*keys, on).distinct().select(*keys, on, F.lit(None).cast(right.select(body.alias("_v")).schema[0].dataType), F.lit(True)))
        .groupBy(*keys, on)
        .agg(F.max("_v").alias("_v"), F.max("_asked").alias("_asked"))
    )
    w = Window.partitionBy(*keys).orderBy(on).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    known = points.withColumn("_k", F.last("_v", ignorenulls=True).over(w)).filter("_asked")
    known = known.select(*keys, on, *[F.col(f"_k.{v}").alias(v) for v in values])
    return left.join(known, [*keys, on], "left")


def asof_both_sides(
    matches: DataFrame, right: DataFrame, entity: str, on: str, values: dict[str, tuple[str, str]], strict: bool = False
) -> DataFrame:
    """As-of lookup for the home and the away team in one pass over the side table.

    ``values`` maps a side-table column to its (home, away) output names.
    """
    cols = list(values)
    sides = matches.select(on, F.explode(F.array("home_team", "away_team")).alias(entity)).distinct()
    known = asof_join(sides, right, [entity], on, cols, strict)
    out = matches
    for side, pos in (("home", 0), ("away", 1)):
        mine = known.select(F.col(entity).alias(f"{side}_team"), on, *[F.col(c).alias(values[c][pos]) for c in cols])
        out = out.join(mine, [f"{side}_team", on], "left")
    return out
