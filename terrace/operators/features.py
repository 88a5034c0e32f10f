"""The wide feature row: one per match, strictly pre-match, plus after-match ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.operators import blocks, match_rows, ratings, windows
from terrace.scale import checkpoint

TEAM_COLS = [
    "overall_form", "overall_goals_scored_avg", "overall_goals_conceded_avg", "rest_days",
    "ppf_10", "ppf_20", "ewma_form", "ewma_gs", "ewma_gc", "streak", "cs_rate_5", "cs_rate_10",
    "btts_rate_5", "o25_rate_5", "gd_10", "season_matches",
    "shots_avg", "shots_against_avg", "sot_avg", "sot_against_avg",
    "corners_avg", "corners_against_avg", "cards_avg", "cards_against_avg",
]
VENUE_COLS = ["form", "goals_scored_avg", "goals_conceded_avg", "matches_played", "gd_5", "venue_ppf_10"]
SIDE_COLS = TEAM_COLS + VENUE_COLS

# The model vector, in serving order.
BASE_COLS = [
    "home_form", "home_goals_scored_avg", "home_goals_conceded_avg", "home_matches_played",
    "away_form", "away_goals_scored_avg", "away_goals_conceded_avg", "away_matches_played",
    "home_overall_form", "home_overall_goals_scored_avg", "home_overall_goals_conceded_avg",
    "away_overall_form", "away_overall_goals_scored_avg", "away_overall_goals_conceded_avg",
    "h2h_matches", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "home_rest_days", "away_rest_days",
]
ADVANCED_COLS = [
    "home_ppf_10", "home_ppf_20", "away_ppf_10", "away_ppf_20", "home_ewma_form", "away_ewma_form",
    "home_ewma_gs", "away_ewma_gs", "home_ewma_gc", "away_ewma_gc", "home_streak", "away_streak",
    "home_cs_rate_5", "away_cs_rate_5", "home_cs_rate_10", "away_cs_rate_10",
    "home_btts_rate_5", "away_btts_rate_5", "home_o25_rate_5", "away_o25_rate_5",
    "home_home_ppf_10", "away_away_ppf_10", "home_sos", "away_sos",
    "home_gd_5", "away_gd_5", "home_gd_10", "away_gd_10", "season_progress",
]
STAT_COLS = [f"{side}_{s}{x}_avg" for side in ("home", "away") for s in windows.STAT_PAIRS for x in ("", "_against")]
ELO_COLS = ["home_elo", "away_elo", "elo_diff"]
DC_COLS = ["dc_home_exp_goals", "dc_away_exp_goals", "dc_home_prob", "dc_draw_prob", "dc_away_prob"]
EVENNESS_COLS = ["abs_elo_diff", "abs_dc_exp_goals_diff", "abs_form_diff", "abs_ppf_10_diff"]
SQUAD_COLS = ["home_squad_value", "away_squad_value", "squad_value_diff", "abs_squad_value_diff", "has_squad_value"]
DRAW_COLS = ["dc_entropy", "dc_total_exp_goals", "tightness"]
RATING_COLS = ["home_clubelo", "away_clubelo", "clubelo_diff", "clubelo_expected", "has_clubelo"]
PLAYER_COLS = ["home_ga_per_game", "away_ga_per_game", "ga_per_game_diff", "home_cards_per_game", "away_cards_per_game", "has_player_stats"]
PI_COLS = ["home_pi", "away_pi", "pi_diff", "pi_expected_gd", "has_pi"]
FEATURE_COLS = (
    BASE_COLS + ADVANCED_COLS + STAT_COLS + ELO_COLS + DC_COLS + EVENNESS_COLS + SQUAD_COLS + DRAW_COLS + RATING_COLS + PI_COLS
)


def team_form(matches: DataFrame) -> DataFrame:
    """Long form with any-venue and venue windows; both share one shuffle on team."""
    return windows.venue_windows(windows.team_windows(match_rows.team_rows(matches)))


def side_by_side(form: DataFrame) -> DataFrame:
    """Fold the two team rows of a match into home_* / away_* columns in one pass."""
    pick = lambda v: F.first(F.when(F.col("venue") == v, F.struct(*SIDE_COLS)), ignorenulls=True)
    both = form.groupBy("match_id").agg(pick("H").alias("h"), pick("A").alias("a"))
    cols = []
    for side, s in (("home", "h"), ("away", "a")):
        for c in SIDE_COLS:
            name = f"{side}_{side}_ppf_10" if c == "venue_ppf_10" else f"{side}_{c}"
            cols.append(F.col(f"{s}.{c}").alias(name))
    return both.select("match_id", *cols)


def with_enrichment(df: DataFrame) -> DataFrame:
    """Squad, cross-league and player blocks from nullable home_*/away_* inputs."""
    have = set(df.columns)
    c = lambda n, t="double": F.col(n) if n in have else F.lit(None).cast(t)
    df = df.withColumns(blocks.squad_block(c("home_value_eur"), c("away_value_eur")))
    df = df.withColumns(blocks.rating_block(c("home_club_rating"), c("away_club_rating")))
    return df.withColumns(blocks.player_block(c("home_ga"), c("home_cards"), c("away_ga"), c("away_cards")))


def derived_columns(df: DataFrame) -> DataFrame:
    """Everything computed from the joined row itself, shared by training and serving."""
    df = match_rows.evenness(df)
    c = F.col
    df = df.withColumns(
        blocks.draw_signal(
            c("dc_home_prob"), c("dc_draw_prob"), c("dc_away_prob"), c("dc_home_exp_goals"), c("dc_away_exp_goals"),
            c("elo_diff"), c("home_overall_form") - c("away_overall_form"),
        )
    )
    return with_enrichment(df)


def match_features(matches: DataFrame, params: ratings.RatingParams | None = None) -> DataFrame:
    """One wide row per match.

    ``matches`` may already carry as-of enrichment columns (home_value_eur,
    home_club_rating, home_ga ... and their away twins).
    """
    params = params or ratings.RatingParams()
    matches = checkpoint(matches)  # read by every window, its hot-key count and the ratings
    base = windows.pair_windows(matches).drop("pair_a", "pair_b")
    df = base.join(side_by_side(team_form(matches)), "match_id").join(ratings.rate_matches(matches, params), "match_id")
    df = ratings.dixon_coles_columns(df, params.dc_rho)
    df = ratings.pi_columns(df).withColumns(
        {
            "season_progress": windows.season_progress(F.col("home_season_matches"), F.col("away_season_matches")),
            "dc_rho": F.lit(params.dc_rho),
        }
    )
    return derived_columns(df)


def training_table(features: DataFrame, warmup: list[str] | None = None, player_block: bool = False) -> DataFrame:
    """Filtered rows with the label, the meta columns and the ordered feature columns."""
    cols = FEATURE_COLS[: -len(PI_COLS)] + (PLAYER_COLS if player_block else []) + PI_COLS
    kept = match_rows.training_rows(features, BASE_COLS, ELO_COLS, warmup)
    return kept.select(
        "match_id", "match_date", "match_seq", "competition", "home_team", "away_team", F.col("result").alias("y"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
    )


__all__ = ["FEATURE_COLS", "match_features", "side_by_side", "team_form", "training_table", "V"]
