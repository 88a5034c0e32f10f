"""Dated club values and rolling player output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.dates import month_key
from terrace.scale import KeyedWindow

PLAYER_WINDOW = 40
PLAYER_MIN_GAMES = 10


def month_snapshots(valuations: DataFrame) -> DataFrame:
    """(club_id, month, value_eur): squad totals at each month start, changes only.

    A valuation counts from the month after it is published until the player's next
    valued month supersedes it, so the snapshots are running sums of plus and minus
    entries per club: months are never iterated.  Values are exact decimals, so a
    change is a real change; an emptied club records zero.
    """
    v = valuations.dropna(subset=["valued_on", "value_eur", "club_id"]).withColumn("m", F.trunc("valued_on", "month"))
    last = v.groupBy("player_id", "m").agg(F.max_by(F.struct("value_eur", "club_id"), F.struct("valued_on", "seq")).alias("s"))
    held = last.select(
        "m", "s.value_eur", "s.club_id", F.lead("m").over(Window.partitionBy("player_id").orderBy("m")).alias("until")
    )
    entry = lambda at, amount: F.struct(F.add_months(at, 1).alias("m"), amount.alias("d"))
    value = F.col("value_eur")
    entries = held.select(
        "club_id",
        F.explode(
            F.when(F.col("until").isNull(), F.array(entry(F.col("m"), value))).otherwise(
                F.array(entry(F.col("m"), value), entry(F.col("until"), -value))
            )
        ).alias("e"),
    ).select("club_id", "e.m", "e.d")
    seen = v.select("club_id", F.add_months("m", 1).alias("m"), F.lit(0).cast("decimal(19,2)").alias("d")).distinct()
    monthly = entries.unionByName(seen).groupBy("club_id", "m").agg(F.sum("d").alias("d"))
    by_club = Window.partitionBy("club_id").orderBy("m")
    totals = monthly.withColumn("value_eur", F.sum("d").over(by_club.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("value_eur").over(by_club)
    changed = totals.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("value_eur")))
    return changed.select("club_id", month_key(F.col("m")).alias("month"), F.col("value_eur").cast("double").alias("value_eur"))


def current_values(players: DataFrame) -> DataFrame:
    """Present squad total and size per club; players without a value still count."""
    return players.dropna(subset=["club_id"]).groupBy("club_id").agg(
        F.sum("value_eur").cast("double").alias("value_eur"), F.count("*").alias("squad_size")
    )


def club_games(appearances: DataFrame) -> DataFrame:
    """One row per (club, game): date and summed goals, assists and cards."""
    a = appearances.dropna(subset=["club_id", "game_id", "played_on"])
    return a.groupBy("club_id", "game_id").agg(
        F.min("played_on").alias("played_on"),
        F.sum("goals").alias("goals"),
        F.sum("assists").alias("assists"),
        F.sum(F.col("yellow_cards") + F.col("red_cards")).alias("cards"),
    )


def player_form(games: DataFrame, window: int = PLAYER_WINDOW, min_games: int = PLAYER_MIN_GAMES, max_rows: int | None = None) -> DataFrame:
    """(club_id, played_on, ga_per_game, cards_per_game) after each day a club played.

    Means over the last ``window`` games up to and including that day; null below
    ``min_games``.  Join it strictly before the match date.
    """
    k = KeyedWindow(games, ["club_id"], ["played_on", "game_id"], halo=window, max_rows=max_rows)
    w = k.up_to_now(window)
    n = F.count("*").over(w)
    k.with_columns(
        {
            "_n": n,
            "_ga": F.sum(F.col("goals") + F.col("assists")).over(w) / n,
            "_cards": F.sum("cards").over(w) / n,
        }
    )
    enough = lambda c: F.when(F.col("_n") >= min_games, F.col(c))
    day = k.result().select("club_id", "played_on", F.struct("game_id", enough("_ga").alias("ga"), enough("_cards").alias("cards")).alias("s"))
    last = day.groupBy("club_id", "played_on").agg(F.max("s").alias("s"))
    return last.select("club_id", "played_on", F.col("s.ga").alias("ga_per_game"), F.col("s.cards").alias("cards_per_game"))


def season_values(values: DataFrame, reference_year: int) -> DataFrame:
    """Current value per club: the reference season's when positive, else the latest season's."""
    at_ref = F.max(F.when(F.col("year") == reference_year, F.col("value_eur")))
    latest = F.max_by("value_eur", "year")
    out = values.groupBy("club_id").agg(at_ref.alias("_r"), latest.alias("_l"), F.count("*").alias("seasons"))
    return out.select("club_id", "seasons", F.coalesce(F.nullif("_r", F.lit(0)), "_l").alias("current_eur"))


def fill_missing_values(teams: DataFrame, pooled: DataFrame, exact: DataFrame) -> DataFrame:
    """Fill team values from resolved pool values first, then from exact-name values.

    ``pooled`` is (team, value_eur) from the resolver; ``exact`` is (team, value_eur).
    """
    out = teams.join(pooled.select("team", F.col("value_eur").alias("_p")), "team", "left")
    out = out.join(exact.select("team", F.col("value_eur").alias("_e")), "team", "left")
    return out.withColumn("value_eur", F.coalesce("value_eur", "_p", "_e")).drop("_p", "_e")
