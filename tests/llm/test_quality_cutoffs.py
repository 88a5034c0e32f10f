"""Cutoffs of the quality rules: an outlier of each metric is rejected, the bulk of its group stays."""

import random

import pytest

from terrace.llm import quality


def _text(rng, letters=(3, 8), lines=12):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(*letters)))
    return "\n".join(" ".join(word() for _ in range(8)) for _ in range(lines))


def _with_repeat(rng):
    words = _text(rng).split()
    return " ".join(words + words[:12])


def _with_repeated_lines(rng):
    # repeated lines in changing order, so that no window of eight words occurs twice
    short = [" ".join(x) for x in zip(*[iter(_text(rng, lines=4).split())] * 4)]
    return "\n".join(x for _ in range(3) for x in rng.sample(short, len(short)))


def test_an_outlier_of_each_metric_is_rejected(spark):
    rng = random.Random(8)
    bulk = [(i, _text(rng)) for i in range(300)]
    odd = {
        1001: _text(rng).replace("a", "#"),
        1002: _with_repeat(rng),
        1003: _with_repeated_lines(rng),
        1004: _text(rng, (8, 10)),
        1005: _text(rng, (1, 2)),
    }
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in [*bulk, *odd.items()]], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert not any(got[i].base_failed for i in odd)
    assert [i for i in odd if got[i].kept] == []
    assert sum(got[i].kept for i, _ in bulk) >= 0.98 * len(bulk)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_most_documents_of_the_table_stay(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    got = quality.judged(docs).filter("NOT base_failed")
    total, kept = got.count(), got.filter("kept").count()
    assert 0.85 * total < kept < total


def test_sources_of_one_language_get_cutoffs_of_their_own(spark):
    rng = random.Random(9)
    marked = lambda t, share: "".join("#" if c != "\n" and c != " " and rng.random() < share else c for c in t)
    rows = [(i, marked(_text(rng), 0.002), "en", "prose") for i in range(120)] + [(200 + i, marked(_text(rng), 0.1), "en", "code") for i in range(120)]
    rows += [(500, marked(_text(rng), 0.1), "en", "prose"), (501, marked(_text(rng), 0.1), "en", "code"), (502, marked(_text(rng), 0.1), "en", "rare")]
    rows += [(600 + i, _text(rng), None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {(r.lang, r.source): r for r in quality.cutoffs(quality.sketches(quality.text_counts(docs))).collect()}
    assert limits["en", "code"].symbols_high > 2 * limits["en", "prose"].symbols_high
    assert (None, None) in limits
    kept = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert (kept[500], kept[501], kept[502]) == (False, True, True)  # a rare source takes its language's cutoffs


def test_a_row_at_the_cutoff_stays(spark):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, _text(rng), "en", "s") for i in range(100)], "doc_id long, text string, lang string, source string")
    counted = quality.text_counts(docs)
    top = quality.cutoffs(quality.sketches(counted)).first().word_len_high
    chars = counted.selectExpr("floor(word_chars / n_words * 100) AS m").agg({"m": "max"}).first()[0]
    assert top >= chars
