"""Columns of the caller that are named as work columns or results neither break an operator nor change."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import credentials, kneser_ney, langid, mixing, paragraphs, pieces, quality
from terrace.llm.queries import piece_model

#: Names that some operator uses inside or adds.
NAMES = [
    "__text", "__key", "__lang", "__source", "__topic", "__n", "__p", "__words", "__lines", "__windows", "__spans", "__links", "__link_key", "__clean",
    "__id", "__given", "__user_0", "__user_3", "__doc_text", "strong", "weak", "role", "cell", "kind", "start", "end", "tokens", "rate", "id", "key", "n",
    "cls", "unit", "root", "symbols", "one", "rows_0", "want_id", "want_key", "text_key", "d", "value", "metric", "bucket",
]
LINE = "the quick brown fox jumps over the lazy dog while seventeen other animals are watching it closely today"
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.5}


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i, f"{LINE}\nline number {i} with some more words of its own, user: bob password: hunter{i}abc", "en", f"s{i % 3}", 10) for i in range(30)]
    rows += [(90, None, None, None, None), (91, "", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select(*[F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")).alias(c) for c in NAMES], "*")


def _models(plain):
    return kneser_ney.train(plain, 2), langid.train(plain)


OPERATORS = {
    "encode": lambda d, m: pieces.encode(d, piece_model(), 0.1, 3),
    "decode": lambda d, m: pieces.decode(pieces.encode(d, piece_model(), 0.1, 3), piece_model()),
    "scored": lambda d, m: kneser_ney.scored(d, m[0]),
    "find_credentials": lambda d, m: credentials.find_credentials(d),
    "redacted": lambda d, m: credentials.redacted(d),
    "without_repeats": lambda d, m: paragraphs.without_repeats(d),
    "identified": lambda d, m: langid.identified(d, m[1]),
    "judged": lambda d, m: quality.judged(d),
    "accepted": lambda d, m: quality.accepted(d),
    "mixed": lambda d, m: mixing.mixed(d, POWERS, 0.5, 1),
    "mixed_by_topic": lambda d, m: mixing.mixed(d, POWERS, 0.5, 1, topic=F.col("n_chars").cast("string")),
    "sampled": lambda d, m: mixing.sampled(d, POWERS, 0.5, 1),
}


@pytest.fixture(scope="module")
def models(plain):
    return _models(plain)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(plain, clashing, models, name):
    want, got = OPERATORS[name](plain, models), OPERATORS[name](clashing, models)
    assert got.columns == [*NAMES, *want.columns]
    rows = got.collect()
    assert sorted(map(repr, want.collect())) == sorted(map(repr, [r for r in got.select(*want.columns).collect()]))
    assert all(r[c] == f"{c}/{r.doc_id}" for r in rows for c in NAMES)


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("encode", "decode")])
def test_columns_that_results_replace(plain, models, name):
    want = OPERATORS[name](plain, models)
    added = [c for c in want.columns if c not in plain.columns]
    mine = plain.select(*[F.lit("mine").alias(c) for c in added], "*")
    got = OPERATORS[name](mine, models)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.select(*want.columns).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns(spark, plain, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    want, got = stage(spark, plain, ""), stage(spark, clashing, "")
    assert got.columns[: len(NAMES)] == NAMES
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in want.collect())
    assert all(r[c] == f"{c}/{r.doc_id}" for r in rows for c in NAMES)
