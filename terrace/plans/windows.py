"""Queries over trailing, running and pair windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.operators import match_rows, windows
from terrace.plans.catalogue import query
from terrace.plans.sql import LONG, MATCHES, with_ctes
from terrace.sources import derived

TEAM_W = "PARTITION BY team ORDER BY match_date, match_seq"
VENUE_W = "PARTITION BY team, venue ORDER BY match_date, match_seq"


def _frame(by: str, n: int) -> str:
    return f"OVER ({by} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _avg(expr: str, n: int, name: str, by: str = TEAM_W) -> str:
    return f"round(coalesce(avg({expr}) {_frame(by, n)}, 0.0), 6) AS {name}"


def _long(spark, sf_dir):
    return match_rows.team_rows(derived.matches(spark, sf_dir))


def _team_query(name: str, columns: list[str], select: str, ctes: str = "", digits: bool = True):
    sql = with_ctes(MATCHES, LONG, *([ctes] if ctes else []), select=f"SELECT match_id, venue, team, {select}")

    @query(name, sql)
    def run(spark, sf_dir):
        df = windows.team_windows(_long(spark, sf_dir))
        cols = [F.round(c, 6).alias(c) if digits and df.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns]
        return df.select("match_id", "venue", "team", *cols)

    return run


_team_query(
    "win_overall_form",
    ["overall_form", "overall_goals_scored_avg", "overall_goals_conceded_avg", "gd_10"],
    ", ".join(
        [
            _avg("points", 5, "overall_form"),
            _avg("gs", 5, "overall_goals_scored_avg"),
            _avg("gc", 5, "overall_goals_conceded_avg"),
            _avg("gd", 5, "gd_10"),
        ]
    )
    + " FROM long_form",
)
_team_query("win_ppf", ["ppf_10", "ppf_20"], _avg("points", 10, "ppf_10") + ", " + _avg("points", 20, "ppf_20") + " FROM long_form")
_team_query(
    "win_clean_sheets",
    ["cs_rate_5", "cs_rate_10"],
    _avg("CASE WHEN gc = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 5, "cs_rate_5")
    + ", "
    + _avg("CASE WHEN gc = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 10, "cs_rate_10")
    + " FROM long_form",
)
_team_query(
    "win_btts",
    ["btts_rate_5"],
    _avg("CASE WHEN gs > 0 AND gc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 5, "btts_rate_5") + " FROM long_form",
)
_team_query(
    "win_over25",
    ["o25_rate_5"],
    _avg("CASE WHEN gd <> 0 AND gs + gc > 2.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", 5, "o25_rate_5") + " FROM long_form",
)
_team_query("win_last_date", ["last_date"], f"lag(match_date) OVER ({TEAM_W}) AS last_date FROM long_form")
_team_query(
    "prj_rest_days",
    ["rest_days"],
    f"CAST(least(coalesce(date_diff('day', lag(match_date) OVER ({TEAM_W}), match_date), 7), 30) AS INTEGER) AS rest_days FROM long_form",
)
_team_query(
    "win_stat_avgs",
    [f"{s}{x}_avg" for s in windows.STAT_PAIRS for x in ("", "_against")],
    ", ".join(
        _avg(f"{s}_{side}", 5, f"{s}{'' if side == 'for' else '_against'}_avg")
        for s in windows.STAT_PAIRS
        for side in ("for", "against")
    )
    + " FROM long_form",
)
_EWMA = f"""
numbered AS (
  SELECT *, row_number() OVER ({TEAM_W}) - 1 AS n FROM long_form),
weighted AS (
  SELECT *, CASE WHEN n < 600 THEN pow(0.3, n) ELSE 0.0 END AS w FROM numbered)"""
_EWMA_FRAME = f"OVER ({TEAM_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_team_query(
    "win_ewma",
    ["ewma_form", "ewma_gs", "ewma_gc"],
    ", ".join(
        f"round(coalesce(sum(w * {c}) {_EWMA_FRAME} / sum(w) {_EWMA_FRAME}, 0.0), 6) AS ewma_{n}"
        for n, c in (("form", "points"), ("gs", "gs"), ("gc", "gc"))
    )
    + " FROM weighted",
    ctes=_EWMA,
)
_STREAK = f"""
flagged AS (
  SELECT *, lag(points) OVER ({TEAM_W}) AS prev,
    CASE WHEN points IS DISTINCT FROM lag(points) OVER ({TEAM_W}) THEN 1 ELSE 0 END AS broke FROM long_form),
islands AS (
  SELECT *, sum(broke) OVER ({TEAM_W}) AS island FROM flagged),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY team, island ORDER BY match_date, match_seq) AS run FROM islands),
streaks AS (
  SELECT match_id, venue, team, CAST(coalesce(lag(CASE points WHEN 3 THEN run WHEN 1 THEN -run ELSE 0 END) OVER ({TEAM_W}), 0) AS INTEGER) AS streak
  FROM runs)"""
_team_query("win_streak", ["streak"], "streak FROM streaks", ctes=_STREAK)


def _venue_query(name: str, columns: list[str], select: str):
    @query(name, with_ctes(MATCHES, LONG, select=f"SELECT match_id, venue, team, {select} FROM long_form"))
    def run(spark, sf_dir):
        df = windows.venue_windows(_long(spark, sf_dir))
        cols = [F.round(c, 6).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns]
        return df.select("match_id", "venue", "team", *cols)

    return run


_venue_query(
    "win_venue_form",
    ["form", "goals_scored_avg", "goals_conceded_avg", "matches_played", "gd_5"],
    ", ".join(
        [
            _avg("points", 5, "form", VENUE_W),
            _avg("gs", 5, "goals_scored_avg", VENUE_W),
            _avg("gc", 5, "goals_conceded_avg", VENUE_W),
            f"CAST(count(*) {_frame(VENUE_W, 5)} AS INTEGER) AS matches_played",
            f"CAST(coalesce(sum(gd) {_frame(VENUE_W, 5)}, 0) AS INTEGER) AS gd_5",
        ]
    ),
)
_venue_query("win_venue_ppf10", ["venue_ppf_10"], _avg("points", 10, "venue_ppf_10", VENUE_W))

_PAIR_W = "(PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY match_date, match_seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    "win_h2h",
    with_ctes(
        MATCHES,
        select=f"""
SELECT match_id, CAST(count(*) OVER {_PAIR_W} AS INTEGER) AS h2h_matches,
  CAST(count(*) FILTER (WHERE result = 1) OVER {_PAIR_W} AS INTEGER) AS h2h_home_wins,
  CAST(count(*) FILTER (WHERE result = 0) OVER {_PAIR_W} AS INTEGER) AS h2h_draws,
  CAST(count(*) FILTER (WHERE result = -1) OVER {_PAIR_W} AS INTEGER) AS h2h_away_wins
FROM matches""",
    ),
)
def win_h2h(spark, sf_dir):
    df = windows.pair_windows(derived.matches(spark, sf_dir))
    return df.select("match_id", "h2h_matches", "h2h_home_wins", "h2h_draws", "h2h_away_wins")


BASELINE = """
baselines AS (
  SELECT match_id, count(*) OVER w AS league_matches,
    CASE WHEN count(*) OVER w >= 200 THEN sum(home_score) OVER w / count(*) OVER w ELSE 1.45 END AS base_home,
    CASE WHEN count(*) OVER w >= 200 THEN sum(away_score) OVER w / count(*) OVER w ELSE 1.2 END AS base_away
  FROM matches
  WINDOW w AS (PARTITION BY competition ORDER BY match_date, match_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "win_league_baseline",
    with_ctes(
        MATCHES,
        BASELINE,
        select="""
SELECT match_id, league_matches, round(base_home, 6) AS league_base_home_goals, round(base_away, 6) AS league_base_away_goals
FROM baselines""",
    ),
)
def win_league_baseline(spark, sf_dir):
    df = windows.league_baseline(derived.matches(spark, sf_dir))
    return df.select(
        "match_id",
        "league_matches",
        F.round("league_base_home_goals", 6).alias("league_base_home_goals"),
        F.round("league_base_away_goals", 6).alias("league_base_away_goals"),
    )


@query(
    "win_season_progress",
    with_ctes(
        MATCHES,
        LONG,
        f"counted AS (SELECT match_id, row_number() OVER ({TEAM_W}) AS n FROM long_form)",
        select="SELECT match_id, round(least(sum(n) / 40.0, 1.0)::DOUBLE, 6) AS season_progress FROM counted GROUP BY match_id",
    ),
)
def win_season_progress(spark, sf_dir):
    df = windows.team_windows(_long(spark, sf_dir)).select("match_id", "season_matches")
    total = F.sum("season_matches")
    return df.groupBy("match_id").agg(F.round(windows.season_progress(total, F.lit(0)), 6).alias("season_progress"))
