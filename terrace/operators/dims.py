"""Registry lookups and small dimension joins; the dimensions are fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import fixed_values as V


def with_registry(df: DataFrame, code: str = "competition") -> DataFrame:
    """League name, rank (999 when unknown), country, source and calendar flag."""
    dim = V.league_dim(df.sparkSession).withColumnRenamed("code", code)
    cups = V.literal_table(df.sparkSession, V.CUPS, [code, "cup_name"])
    out = df.join(dim, code, "left").join(cups, code, "left")
    return out.withColumns(
        {
            "league_name": F.coalesce("league_name", "cup_name", F.nullif(F.col(code), F.lit("")), F.lit("Other")),
            "league_rank": F.coalesce("league_rank", F.lit(999)),
            "calendar_year": F.coalesce("calendar_year", F.lit(False)),
        }
    ).drop("cup_name")


def fixture_leagues(spark) -> DataFrame:
    """Live leagues in rank order, then the cups."""
    live = V.league_dim(spark).filter("live_api").select("code", F.col("league_name").alias("name"), F.col("league_rank").alias("position"))
    cups = V.literal_table(spark, [(c, n, 1000 + i) for i, (c, n) in enumerate(V.CUPS)], ["code", "name", "position"])
    return live.unionByName(cups)


def with_tier_labels(df: DataFrame, code: str = "competition") -> DataFrame:
    """Names of the continental tiers by confederation; the European ones by default."""
    spark = df.sparkSession
    countries = V.league_dim(spark).select(F.col("code").alias(code), "country")
    labels = V.confederation_dim(spark)
    out = df.join(countries, code, "left").join(labels, "country", "left")
    return out.withColumns(
        {"top_label": F.coalesce("top_label", F.lit("UCL")), "second_label": F.coalesce("second_label", F.lit("UEL"))}
    ).drop("country", "confederation")


def league_rules(sizes: DataFrame, code: str = "competition", n: str = "n_teams") -> DataFrame:
    """Slots per league, clamped so that a mid-table place always remains."""
    spark = sizes.sparkSession
    rel, cl, uel, play = V.DEFAULT_RULES
    out = sizes.join(V.rules_dim(spark).withColumnRenamed("code", code), code, "left")
    size = F.col("_n")
    out = out.withColumn("_n", F.coalesce(F.nullif(F.col(n), F.lit(0)), F.lit(20)))
    out = out.withColumn(
        "cl_slots", F.least(F.coalesce("cl_slots", F.lit(cl)), F.greatest(F.lit(1), F.floor(size / 3))).cast("int")
    )
    out = out.withColumn(
        "uel_slots", F.least(F.coalesce("uel_slots", F.lit(uel)), F.greatest(F.lit(0), size - F.col("cl_slots") - 2)).cast("int")
    )
    room = F.greatest(F.lit(1), size - F.col("cl_slots") - F.col("uel_slots") - 1)
    out = out.withColumn("relegation_slots", F.least(F.coalesce("relegation_slots", F.lit(rel)), room).cast("int"))
    out = out.withColumn(
        "playoff_slots", F.when(size >= 8, F.least(F.coalesce("playoff_slots", F.lit(play)), F.lit(1))).otherwise(0).cast("int")
    )
    return out.drop("_n")


def with_display_name(df: DataFrame, pretty: DataFrame, key: str = "team") -> DataFrame:
    """``pretty`` is (key, display); names without an entry show as they are."""
    return df.join(pretty, key, "left").withColumn("display", F.coalesce("display", key))


def reassign_leagues(teams: DataFrame, membership: DataFrame) -> DataFrame:
    """Move each team to its current league; the last listed membership wins."""
    now = membership.groupBy("team").agg(F.max_by("league", "position").alias("_now"))
    out = teams.join(now, "team", "left")
    moved = F.coalesce(F.col("_now") != F.col("league"), F.lit(False))
    return out.withColumns({"moved": moved, "league": F.coalesce("_now", "league")}).drop("_now")


def team_listing(state: DataFrame, pretty: DataFrame | None = None) -> DataFrame:
    """Top-flight teams with data: rounded Elo, tier, display and league name."""
    from terrace.operators.blocks import elo_tier

    spark = state.sparkSession
    top = V.league_dim(spark).select(F.col("code").alias("league"), "league_name", "league_rank")
    known = state.filter((F.col("matches_played") > 0) & (F.col("team") != "")).join(top, "league")
    shown = with_display_name(known, pretty) if pretty is not None else known.withColumn("display", F.col("team"))
    return shown.select(
        "team", "display", F.round("elo", 1).alias("elo"), elo_tier(F.col("elo")).alias("tier"), "league", "league_name", "league_rank"
    )


def league_options(listing: DataFrame) -> DataFrame:
    return listing.select("league", "league_name", "league_rank").distinct()
