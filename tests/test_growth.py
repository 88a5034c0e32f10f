"""Steps that must stay spread out when one class, file, league or name holds most of the rows."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from terrace import scale
from terrace.operators import bayes, ratings, resolve, splits, tables
from terrace.sources import headed_csv


@pytest.fixture
def measured(spark):
    """Without estimates small enough for a broadcast, as for large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, old)


def _spread(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_class_weights_leave_rows_where_they_are(measured):
    rows = measured.range(0, 800, 1, 8).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("y"))
    out = splits.class_weight(rows)
    assert _spread(out) == 8
    assert {r.y: round(r.w, 6) for r in out.groupBy("y").agg(F.sum("sample_weight").alias("w")).collect()} == {0: 400.0, 1: 400.0}


def test_lines_of_one_file_stay_spread(measured, monkeypatch):
    lines = measured.range(0, 801, 1, 8).select(F.lit("a.csv").alias("file"), F.when(F.col("id") == 0, "k,v").otherwise(F.concat_ws(",", "id", F.col("id") * 2)).alias("value"))
    out = headed_csv.headed_rows(lines, "^k,", width=2)
    assert _spread(out) == 8
    want = {(str(i), str(2 * i)) for i in range(1, 801)}
    assert {(r.row["k"], r.row["v"]) for r in out.collect()} == want
    monkeypatch.setattr(headed_csv, "MAX_SENT_HEADS", 0)
    assert {(r.row["k"], r.row["v"]) for r in headed_csv.headed_rows(lines, "^k,", width=2).collect()} == want


def test_a_large_league_is_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_TEAMS", 3)
    teams = [("big", f"t{i}") for i in range(11)] + [("big", "t0"), ("four", "a"), ("four", "b"), ("four", "c"), ("four", "d"), ("three", "x"), ("three", "y"), ("three", "z"), (None, "n"), ("big", None)]
    got = tables.round_robin(spark.createDataFrame(teams, "league string, team string"))
    assert got.columns == ["league", "home_team", "away_team"]
    want = [("big", *p) for p in permutations([f"t{i}" for i in range(11)], 2)] + [("four", *p) for p in permutations("abcd", 2)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_settings_are_folded_side_by_side_in_chunks(matches):
    grid = [ratings.RatingParams(elo_k=24.0), ratings.RatingParams()]
    key = ["setting", "match_id"]
    cols = [*key, *ratings.RATED]
    whole = ratings.rate_grid(matches, grid).select(*cols).toPandas().sort_values(key, ignore_index=True)
    cut = ratings.rate_grid(matches, grid, max_rows=60).select(*cols).toPandas().sort_values(key, ignore_index=True)
    assert len(cut) == 2 * matches.count()
    assert (whole - cut).abs().max().max() < 1e-9


@pytest.mark.parametrize("held", [32, 0])
def test_only_near_names_are_scored(spark, monkeypatch, held):
    monkeypatch.setattr(resolve, "SEGMENT_HELD", held)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(14))
    clubs, teams = [word() for _ in range(1500)], [word() for _ in range(1500)]
    near = [(c[:5] + "z" + c[6:], c) for c in clubs[:40]] + [(c[:13], c) for c in clubs[40:60]] + [(c[:2] + "yz" + c[2:], c) for c in clubs[60:80]]
    own = spark.createDataFrame([("B", n) for n in [*teams, *[n for n, _ in near]]], "block string, s string")
    per_name = spark.createDataFrame([("B", n, i) for i, n in enumerate(clubs)], "block string, s string, cid long")
    got = {(r.n, r.nn) for r in resolve._similar_candidates(own, per_name, resolve.SIMILARITY_FLOOR).collect()}
    assert set(near) <= got
    assert len(got) <= len(near) + 20


def test_a_numbered_table_has_slices_by_its_rows(measured, monkeypatch):
    rows = measured.range(0, 500, 1, 3).select("id", (F.col("id") * 7 % 500).alias("at"))
    for most, least, want in ((50_000, 4_000, 1), (50_000, 100, 5), (50, 4_000, 10)):
        monkeypatch.setattr(scale, "SLICE_ROWS", most)
        monkeypatch.setattr(scale, "LEAST_SLICE_ROWS", least)
        out = scale.number_rows(rows, ["at"], total=500)
        assert out.rdd.getNumPartitions() == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
        assert all(r.at == r.row_no for r in out.collect())
    assert {r.role: r.n for r in splits.holdout_split(rows, ["at"]).groupBy("role").agg(F.count("*").alias("n")).collect()} == {"train": 400, "calibrate": 50, "test": 50}


def test_mutual_information_counts_cells_in_tasks(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    rows = [(rng.choice([-1, 0, 1]), rng.gauss(0, 1), rng.randrange(9), None, 4.0, rng.choice([None, 1.0, 2.5]), rng.choice([nan, 1.0]), rng.choice([inf, 0.0, 3.0])) for _ in range(300)]
    rows += [(None, 0.5, 3, None, 4.0, 1.0, 1.0, 0.0)]
    names = ["a", "b", "none", "same", "some", "nan", "inf"]
    df = spark.createDataFrame(rows, "y int, a double, b long, none double, same double, some double, nan double, inf double").repartition(5)
    got = bayes.mutual_information(df, names)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    cells = []  # the same bins by Spark's own expressions
    for f in names:
        lo, hi = df.agg(F.min(f).cast("double"), F.max(f).cast("double")).first()
        width = F.lit(None if lo is None else (hi - lo) / 10)
        at = F.when(width > 0, F.least(F.floor((F.col(f).cast("double") - F.lit(lo)) / width), F.lit(9))).otherwise(0)
        cells += [(f, r.b, r.y, r.n) for r in df.groupBy(at.alias("b"), "y").agg(F.count("*").alias("n")).collect()]
    for f, mi in got.collect():
        own = [c for c in cells if c[0] == f]
        by_b, by_y, total = ({k: sum(c[3] for c in own if c[i] == k) for k in {c[i] for c in own}} for i in (1, 2, 0))
        want = sum(n / total[f] * math.log(n * total[f] / (by_b[b] * by_y[y])) for _, b, y, n in own if y is not None)
        assert abs(mi - want) < 1e-12, f
    assert got.count() == len(names)
