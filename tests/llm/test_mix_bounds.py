"""Mixes in which cells reach the bound of taking every document."""

import itertools

import pytest

from terrace.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string"
POWERS = {"source": 1.0, "lang": 1.0, "topic": 1.0}


def _docs(spark, tokens):
    rows, ids = [], itertools.count()
    for (source, lang), n in tokens.items():
        rows += [(next(ids), "w " * 10, source, lang) for _ in range(n // 10)]
    return spark.createDataFrame(rows, SCHEMA)


def _shares(spark, dim, shares):
    return spark.createDataFrame(list(shares.items()), f"{dim} string, target double")


def test_margins_hold_where_a_cell_clips(spark):
    # (s, en) has 100 of 4000 tokens; raking without the bound would expect 233 of it
    docs = _docs(spark, {("s", "en"): 100, ("s", "de"): 1500, ("t", "en"): 1500, ("t", "de"): 900})
    targets = {"source": _shares(spark, "source", {"s": 0.5, "t": 0.5}), "lang": _shares(spark, "lang", {"en": 0.5, "de": 0.5})}
    got = mixing.mixed(docs, POWERS, 0.7, 1, targets=targets).toPandas()
    weight = got.n_tokens * got.probability
    assert (got.probability[(got.source == "s") & (got.lang == "en")] == 1).all()
    assert weight.sum() == pytest.approx(0.7 * 4000, rel=0.002)
    assert weight.groupby(got.source).sum()["s"] / weight.sum() == pytest.approx(0.5, abs=0.002)
    assert weight.groupby(got.lang).sum()["en"] / weight.sum() == pytest.approx(0.5, abs=0.002)
    for r in mixing.margin_report(docs, POWERS, 0.7, targets=targets).collect():
        assert r.expected == pytest.approx(r.target, abs=0.002) and r.reachable == pytest.approx(r.target, abs=1e-6)


def test_report_shows_targets_that_the_tokens_cannot_reach(spark):
    held = {("hot", "en"): 3400, **{(f"m{i}", "en"): 600 for i in range(10)}, **{(f"s{i}", "en"): 50 for i in range(12)}}
    docs = _docs(spark, held)
    powers = POWERS | {"source": 0.5}
    report = {r.value: r for r in mixing.margin_report(docs, powers, 0.5).filter("dim = 'source'").collect()}
    assert report["s3"].target == pytest.approx(0.0182, abs=2e-4) and report["s3"].reachable == pytest.approx(0.01, abs=1e-4)
    assert report["hot"].target == pytest.approx(0.150, abs=1e-3) and report["hot"].reachable == pytest.approx(0.169, abs=1e-3)
    assert all(r.expected == pytest.approx(r.reachable, rel=2e-3) for r in report.values())
    got = mixing.mixed(docs, powers, 0.5, 1).toPandas()
    assert (got.n_tokens * got.probability).sum() == pytest.approx(0.5 * got.n_tokens.sum(), rel=0.002)


def test_a_value_without_a_target_is_left_out(spark):
    docs = _docs(spark, {("s", "en"): 500, ("t", "en"): 500, (None, "en"): 500})
    got = mixing.mixed(docs, POWERS, 0.3, 1, targets={"source": spark.createDataFrame([("s", 1.0), (None, 3.0)], "source string, target double")}).toPandas()
    weight = (got.n_tokens * got.probability).groupby(got.source.fillna("none")).sum()
    assert weight["t"] == 0 and weight["s"] == pytest.approx(112.5, rel=0.01) and weight["none"] == pytest.approx(337.5, rel=0.01)
