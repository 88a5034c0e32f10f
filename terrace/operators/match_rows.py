"""Canonical match rows: outcome columns, cleaning, and the two-rows-per-match form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import to_int

SIDE_STATS = [("shots", "shots"), ("sot", "shots_on_target"), ("corners", "corners")]


def result_label(home: Column, away: Column) -> Column:
    return F.when(home > away, "Home Win").when(home < away, "Away Win").otherwise("Draw")


def with_outcome(df: DataFrame) -> DataFrame:
    """result in {-1, 0, 1}, total_goals and goal_diff from the two scores."""
    h, a = F.col("home_score"), F.col("away_score")
    return df.withColumns({"result": F.signum(h - a).cast("int"), "total_goals": h + a, "goal_diff": h - a})


def finished(df: DataFrame, status: str = "status") -> DataFrame:
    return df.filter((F.col(status) == "FINISHED") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def split_score(text: Column) -> tuple[Column, Column]:
    """'2-1' -> (2, 1); anything else -> nulls."""
    parts = F.split(text, "-")
    ok = F.size(parts) == 2
    side = lambda i: to_int(F.when(ok, F.try_element_at(parts, F.lit(i))))
    return side(1), side(2)


def points(result: Column) -> Column:
    return F.when(result == 1, 3).when(result == 0, 1).otherwise(0)


def team_rows(df: DataFrame) -> DataFrame:
    """Each match as two rows, one per side, from a single pass over the table."""

    def side(venue: str, me: str, them: str, sign: int) -> Column:
        stat = lambda s, n: F.coalesce(F.col(f"{s}_{n}"), F.lit(0))
        cols = [
            F.lit(venue).alias("venue"),
            F.col(f"{me}_team").alias("team"),
            F.col(f"{them}_team").alias("opponent"),
            F.col(f"{me}_score").alias("gs"),
            F.col(f"{them}_score").alias("gc"),
            (F.col("goal_diff") * sign).alias("gd"),
            (F.col("result") * sign).alias("side_result"),
            points(F.col("result") * sign).alias("points"),
        ]
        for short, name in SIDE_STATS:
            cols += [stat(me, name).alias(f"{short}_for"), stat(them, name).alias(f"{short}_against")]
        cols += [
            (stat(me, "yellow") + stat(me, "red")).alias("cards_for"),
            (stat(them, "yellow") + stat(them, "red")).alias("cards_against"),
        ]
        return F.struct(*cols)

    sides = F.array(side("H", "home", "away", 1), side("A", "away", "home", -1))
    return df.select("match_id", "match_seq", "match_date", "competition", F.explode(sides).alias("s")).select(
        "match_id", "match_seq", "match_date", "competition", "s.*"
    )


def evenness(df: DataFrame) -> DataFrame:
    """Signed Elo gap and the four closeness columns."""
    return df.withColumns(
        {
            "elo_diff": F.col("home_elo") - F.col("away_elo"),
            "abs_elo_diff": F.abs(F.col("home_elo") - F.col("away_elo")),
            "abs_dc_exp_goals_diff": F.abs(F.col("dc_home_exp_goals") - F.col("dc_away_exp_goals")),
            "abs_form_diff": F.abs(F.col("home_overall_form") - F.col("away_overall_form")),
            "abs_ppf_10_diff": F.abs(F.col("home_ppf_10") - F.col("away_ppf_10")),
        }
    )


def training_rows(df: DataFrame, base_cols: list[str], elo_cols: list[str], warmup: list[str] | None = None) -> DataFrame:
    """Drop warm-up competitions, rows with a null base/elo column, and all-zero base rows."""
    if warmup:
        df = df.filter(~F.col("competition").isin(warmup))
    df = df.dropna(subset=base_cols + elo_cols)
    nonzero = F.lit(False)
    for c in base_cols:
        nonzero = nonzero | (F.col(c) != 0)
    return df.filter(nonzero)
