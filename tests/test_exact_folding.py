"""Folding of every character there is, damaged logs, and infinite feature values."""

import sys
import unicodedata

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import bayes
from terrace.streaming.log import append_once


def plain(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_every_code_point_folds_as_in_unicode(spark):
    letters = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    # each character alone between two letters, a few hundred to a row
    rows = [(i, "".join(f"x{c}" for c in letters[i : i + 500])) for i in range(0, len(letters), 500)]
    got = spark.createDataFrame(rows, "i int, s string").select("i", text.fold_ascii(F.col("s")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: plain(s) for i, s in rows}


def test_folding_of_words_and_missing_text(spark):
    names = ["Śląsk Wrocław", "Ａｊａｘ ½ №5", "e\u0301cole", "ﬃ ㎏ 🄐", "", None]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(text.fold_ascii(F.col("s")).alias("f")).collect()
    assert [r.f for r in got] == [plain(n or "") for n in names]


def test_append_once_does_not_take_an_unreadable_log_for_an_empty_one(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "match_id long, note string")
    path = str(tmp_path / "log")
    write = append_once(path)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == 2
    hollow = tmp_path / "hollow"
    hollow.mkdir()  # a folder without a file has no schema
    with pytest.raises(AnalysisException):
        append_once(str(hollow))(batch, 0)


def test_infinite_values_count_as_bad(spark):
    train = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "a double, b double")
    serve = spark.createDataFrame([(0.5, float("inf")), (0.6, float("-inf")), (0.7, None)], "a double, b double")
    got = {r.feature: r for r in bayes.parity_report(train, serve, ["a", "b"]).collect()}
    assert got["a"].aligned and got["a"].serve_bad == 0
    assert not got["b"].aligned and got["b"].serve_bad == 3 and got["b"].serve_min is None
