"""Lines and stretches of many texts at once equal those of each text alone."""

import numpy as np
import pytest

from terrace.llm import paragraphs
from terrace.llm.common import sieve, through, word_hashes
from terrace.llm.paragraphs import Paragraphs, repeated_paragraphs

TEXTS = [
    "alpha beta gamma delta " * 9, "", None, "one", "\n\n", "Éa ü\tb\x0bc  d\n" * 12, "w " * 7, "w " * 8, "a B c d e f g h\ni j\nk l m n o p q r s",
    "x" * 5000 + " " + "x" * 5001 + " y z a b c d e f",
]


def _cut(cut):
    out = []
    for a, b in (cut.lines(), cut.stretches()):
        out.append(list(zip(cut.owners(a).tolist(), *[x.tolist() for x in cut.places(a, b)], (b - a).tolist(), cut.hashes(a, b).tolist())))
    return out


def test_many_texts_are_cut_like_each_alone():
    data = [None if t is None else t.encode() for t in TEXTS]
    together = _cut(Paragraphs(data, 8))
    alone = [_cut(Paragraphs([t], 8)) for t in data]
    for kind in (0, 1):
        assert together[kind] == [(i, *row[1:]) for i, cut in enumerate(alone) for row in cut[kind]]


def test_places_name_the_words_of_a_paragraph():
    cut = Paragraphs([t.encode() for t in TEXTS if t], 8)
    texts = [t for t in TEXTS if t]
    for a, b in (cut.lines(), cut.stretches()):
        for owner, start, end, words in zip(cut.owners(a), *cut.places(a, b), b - a):
            assert len(texts[owner][start:end].encode().split()) == words


def test_equal_words_and_no_others_have_equal_hashes():
    text = b"A a aB ab abcdefgh ABCDEFGHI abcdefghi abcdefghj " + b"x" * 9999 + b" " + b"x" * 10000
    own, other = Paragraphs([text], 1).words, word_hashes(text)
    assert (np.equal.outer(own, own) == np.equal.outer(other, other)).all()


def test_near_copies_of_short_lines_are_found_where_asked_for(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = spark.createDataFrame([(1, near), (2, near), (3, "another line")], "doc_id long, text string")
    assert repeated_paragraphs(docs).count() == 0
    assert {r.doc_id for r in repeated_paragraphs(docs, least_words=8).filter("removed").collect()} == {2}
    with pytest.raises(ValueError):
        repeated_paragraphs(docs, width=5, least_words=4)


def test_a_sieve_lets_its_keys_through_and_few_others(spark):
    rng = np.random.default_rng(6)
    keys, others = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    bitmap = sieve(spark.createDataFrame([(int(k),) for k in keys], "unit long"))
    assert through(keys, bitmap).all() and through(others, bitmap).mean() < 0.1
    assert not through(others, sieve(spark.createDataFrame([], "unit long"))).any()


def test_units_found_once_are_not_shuffled(spark):
    line = " ".join(f"same{i}" for i in range(20))
    rows = [(i, f"{line}\n" + " ".join(f"d{i}x{j}" for j in range(400))) for i in range(6)]
    keyed = paragraphs.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    unit = paragraphs.Paragraphs([line.encode()], 16)
    units = unit.hashes(*unit.lines())
    passing = spark.sparkContext.broadcast(sieve(spark.createDataFrame([(int(u),) for u in units], "unit long")))
    found = keyed.mapInArrow(paragraphs._units(16, passing), paragraphs.ROWS).collect()
    assert {r.doc_id for r in found if r.unit == units[0]} == set(range(6))
    assert len(found) < 30  # of hundreds
    got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.removed, r.start, r.end) for r in got) == [(i, i > 0, 0, len(line)) for i in range(6)]


def test_least_values_of_ranges_are_those_of_trying_every_value():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 700, np.uint64)
    first = rng.integers(0, 699, 300)
    end = first + 1 + (rng.random(300) * (700 - first - 1)).astype(int)
    got = paragraphs.range_minima(values, first, end)
    assert got.tolist() == [values[a:b].min() for a, b in zip(first, end)]
