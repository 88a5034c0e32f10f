"""Streams over small tables: late results, new teams, sliding scores, slices of many files."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from terrace.operators import ratings as batch
from terrace.streaming import log, ratings, replay

RESULT = "match_id long, match_seq long, match_time timestamp, competition string, home_team string, away_team string, home_score int, away_score int"
FAR = dt.datetime(2100, 1, 1)


def _day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def _results():
    teams = ["a", "b", "c", "new"]
    rows = []
    for i in range(24):
        home, away = teams[i % 4], teams[(i + 1 + i // 4 % 3) % 4]
        rows.append((i, i, _day(3 * i), "X", home, away, i % 4, i % 3))
    return rows


def test_late_results_go_aside_and_a_new_team_gets_the_batch_ratings(spark):
    rows = _results()
    late = rows[2]
    on_time = [r for r in rows if r != late]
    beat = (-1, -1, FAR, "~", "~a", "~b", 0, 0)
    feed = [spark.createDataFrame(x, RESULT) for x in (on_time[:12], [late, *on_time[12:]], [beat])]
    known = spark.createDataFrame([(t, "a") for t in "abc"], "team string, component string")
    folder = replay.work_folder(spark, "test-late")
    before = spark.conf.get(ratings.PROVIDER_CONF, None)
    with ratings.state_store(spark):
        out = replay.run_slices(
            {f"{folder}/in": feed}, lambda: ratings.streaming_ratings(replay.read_folder(spark, f"{folder}/in", feed[0].schema), known), folder
        )
    assert spark.conf.get(ratings.PROVIDER_CONF, None) == before
    done = spark.read.schema(ratings.OUTPUT).parquet(out).filter("match_id >= 0")
    assert [tuple(r) for r in ratings.late_results(done).collect()] == [("a", late[0])]
    columns = ["match_id", "home_elo", "away_elo", "home_dc_attack_post", "away_pi_home_post"]
    m = spark.createDataFrame(on_time, RESULT).withColumn("match_date", F.to_date("match_time"))
    m = m.withColumn("result", F.signum(F.col("home_score") - F.col("away_score")).cast("int")).withColumn("goal_diff", F.col("home_score") - F.col("away_score"))
    want = batch.rate_matches(m).select(columns).toPandas().sort_values("match_id", ignore_index=True)
    got = ratings.on_time(done).select(columns).toPandas().sort_values("match_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_sliding_scores_equal_counting_every_window(spark):
    schema = "match_id long, competition string, settled_at timestamp, actual string, p_home double, p_draw double, p_away double"
    rows = [(i, "XY"[i % 2], _day(i * i % 37), ["Home Win", "Draw", "Away Win", None][i % 4], 0.5, 0.2, 0.3) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    beat = (-1, "~", FAR, "Draw", 0.0, 1.0, 0.0)
    feed = [spark.createDataFrame(x, schema).repartition(3) for x in (rows[:20], rows[20:], [beat])]
    folder = replay.work_folder(spark, "test-slide")
    out = replay.run_slices({f"{folder}/in": feed}, lambda: log.sliding_score(replay.read_folder(spark, f"{folder}/in", feed[0].schema)), folder)
    got = {(r.window_start, r.competition): (r.n, r.accuracy) for r in spark.read.parquet(out).filter("competition <> '~'").collect()}
    want = {}
    for _, comp, at, actual, *_ in rows:
        if actual is not None:
            for k in range(7):
                n, hits = want.get((at - dt.timedelta(days=k), comp), (0, 0))
                want[(at - dt.timedelta(days=k), comp)] = (n + 1, hits + (actual == "Home Win"))
    assert got == {k: (n, hits / n) for k, (n, hits) in want.items()}
