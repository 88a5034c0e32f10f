"""Rows that are equal in part: lines with equal shingle sets, queries whose id stands several times."""

import numpy as np
from pyspark.sql import functions as F

from terrace.llm import bit_slices, paragraphs


def test_lines_of_few_words_at_many_lengths_are_linked(spark):
    rows = [(i, "0 " * (16 + i)) for i in range(12)] + [(100 + i, "| --- " * (10 + i)) for i in range(12)]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert {r.keeper_doc_id for r in got if r.doc_id < 100} == {0} and {r.keeper_doc_id for r in got if r.doc_id >= 100} == {100}


def test_own_rows_of_a_repeated_query_id_take_no_places(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-60, 60, 4)]) for i in range(40)] + [(500, [60, 60, 60, 60])] * 6
    frame = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = bit_slices.top_k(frame, frame.filter(F.col("id") == 500), 4).orderBy("rank").collect()
    want = sorted((-sum(60 * x for x in v), i) for i, v in rows if i != 500)[:4]
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]
