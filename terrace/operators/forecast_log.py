"""The forecast log: append what is new, settle against results, list recent rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import match_rows


def new_fixtures(fixtures: DataFrame, log: DataFrame, known: DataFrame, now: date, days_ahead: int = 10) -> DataFrame:
    """Fixtures not logged yet, kicking off within the horizon, with both teams known."""
    soon = fixtures.filter(F.col("match_date") <= F.date_add(F.lit(now), days_ahead))
    fresh = soon.join(log.select("match_id"), "match_id", "left_anti")
    for side in ("home_team", "away_team"):
        fresh = fresh.join(known.select(F.col("team").alias(side)).distinct(), side, "left_semi")
    return fresh


def append_new(log: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Rows to append so that a match id is never logged twice."""
    return forecasts.dropDuplicates(["match_id"]).join(log.select("match_id"), "match_id", "left_anti")


def settle(log: DataFrame, results: DataFrame, settled_on: Column | date) -> DataFrame:
    """Grade pending rows whose match has a final score; everything else is unchanged."""
    day = settled_on if isinstance(settled_on, Column) else F.lit(settled_on)
    scored = results.filter("home_score is not null and away_score is not null").select(
        "match_id", F.col("home_score").alias("_h"), F.col("away_score").alias("_a")
    )
    df = log.join(scored, "match_id", "left")
    now = (F.col("status") == "pending") & F.col("_h").isNotNull()
    label = match_rows.result_label(F.col("_h"), F.col("_a"))
    return df.withColumns(
        {
            "status": F.when(now, "settled").otherwise(F.col("status")),
            "actual": F.when(now, label).otherwise(F.col("actual")),
            "actual_score": F.when(now, F.concat_ws("-", "_h", "_a")).otherwise(F.col("actual_score")),
            "settled_at": F.when(now, day).otherwise(F.col("settled_at")),
        }
    ).drop("_h", "_a")


def recent(log: DataFrame, k: int = 20) -> DataFrame:
    """The most recently settled forecasts."""
    done = log.filter("status = 'settled' and actual is not null")
    return done.orderBy(F.desc("settled_at"), F.desc("match_id")).limit(k)


def first_per_match(rows: DataFrame, priority: str = "priority") -> DataFrame:
    """One record per match id, the first feed winning; a map-side-combined aggregate."""
    others = [c for c in rows.columns if c != "match_id"]
    best = rows.filter("match_id is not null").groupBy("match_id").agg(F.min_by(F.struct(*others), F.struct(priority, *others)).alias("s"))
    return best.select("match_id", "s.*")
