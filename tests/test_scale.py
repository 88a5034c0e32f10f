"""Hot keys are cut into bounded pieces and give the same answers."""

import pytest
from pyspark.sql import functions as F

from terrace import scale
from terrace.operators import asof, match_rows, ratings, squad_values, windows
from terrace.sources import derived


def rows(df, key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def same(a, b, key, tol=1e-9):
    left, right = rows(a, key), rows(b, key)
    assert left.keys() == right.keys()
    for k, r in left.items():
        for c in a.columns:
            x, y = r[c], right[k][c]
            assert x == pytest.approx(y, abs=tol) if isinstance(x, float) else x == y, (k, c, x, y)


def test_team_windows_split_hot_teams(matches):
    long = match_rows.team_rows(matches)
    same(windows.team_windows(long), windows.team_windows(long, max_rows=25), ("match_id", "venue"))


def test_recent_weights_split_hot_teams(matches):
    long = match_rows.team_rows(matches)
    whole = windows.team_windows(long, ewma_mode="recent")
    same(whole, windows.team_windows(long, ewma_mode="recent", max_rows=70), ("match_id", "venue"))


def test_venue_and_pair_windows_split(matches):
    long = match_rows.team_rows(matches)
    same(windows.venue_windows(long), windows.venue_windows(long, max_rows=11), ("match_id", "venue"))
    pairs = matches.select("match_id", "match_date", "match_seq", "home_team", "away_team", "result")
    same(windows.pair_windows(pairs), windows.pair_windows(pairs, max_rows=6), ("match_id",))


def test_player_form_split(spark, sf_dir):
    games = squad_values.club_games(derived.appearances(spark, sf_dir))
    same(squad_values.player_form(games), squad_values.player_form(games, max_rows=50), ("club_id", "played_on"))


def test_recent_first_ewma_leans_on_the_last_match(matches):
    long = match_rows.team_rows(matches)
    both = windows.team_windows(long).join(
        windows.team_windows(long, ewma_mode="recent").select("match_id", "venue", F.col("ewma_gs").alias("recent")), ["match_id", "venue"]
    )
    assert both.filter("prior_matches > 5 and abs(ewma_gs - recent) > 0.01").count() > 0


def test_chunked_fold_equals_one_fold(matches):
    whole = ratings.rate_matches(matches)
    chunked = ratings.rate_matches(matches, max_rows=60)
    same(whole, chunked, ("match_id",))


def test_row_numbers_are_a_total_order(matches):
    got = scale.number_rows(matches.select("match_id", "match_date", "match_seq"), ["match_date", "match_seq"]).collect()
    want = sorted(got, key=lambda r: (r["match_date"], r["match_seq"]))
    assert [r["row_no"] for r in want] == list(range(len(want)))


def test_no_key_above_the_limit(matches):
    assert scale.hot_keys(matches, ["home_team"]) is None


def test_hot_keys_found(matches):
    hot = scale.hot_keys(matches, ["competition"], max_rows=10)
    assert hot.count() == 8


def test_grid_of_settings_keeps_default_results(matches):
    grid = [ratings.RatingParams(elo_k=24.0), ratings.RatingParams()]
    g = ratings.rate_grid(matches, grid).filter("setting = 1").drop("setting")
    same(g.select("match_id", *ratings.RATED), ratings.rate_matches(matches), ("match_id",))


def test_asof_strictness(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 4.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): 4.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 9): None}
    strict = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert strict == {("a", 1): None, ("a", 2): 4.0, ("a", 3): 5.0, ("b", 9): None}


def test_no_lookahead(matches):
    """Dropping everything after a date changes no feature on or before it."""
    cut = "1998-01-01"
    early = matches.filter(F.col("match_date") <= cut)
    cols = ["match_id", "venue", "overall_form", "ewma_form", "streak", "ppf_20", "rest_days"]
    full = windows.team_windows(match_rows.team_rows(matches)).filter(F.col("match_date") <= cut).select(*cols)
    same(full, windows.team_windows(match_rows.team_rows(early)).select(*cols), ("match_id", "venue"))
    same(ratings.rate_matches(matches).join(early.select("match_id"), "match_id"), ratings.rate_matches(early), ("match_id",))


def test_plans_have_no_one_task_window_or_cross_product(spark, sf_dir):
    from __spark_entry__ import queries

    for name in ("win_overall_form", "win_league_baseline", "win_h2h", "agg_h2h_last5", "agg_squad_months", "agg_team_state", "scn_rank", "join_asof_value"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
