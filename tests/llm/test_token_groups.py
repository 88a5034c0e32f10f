"""The token-group join against all pairs, with families large enough to be opened in blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrace.llm import token_groups as tg
from terrace.scale import checkpoint

SCHEMA = "doc_id long, text string"


def components(rows, width, percent):
    sets = {i: frozenset(tg.shingle_set((t or "").encode(), width).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{seed}_{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        text = base[:]
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(text)


def corpus():
    texts = [*family(1, 60, 70, 6), *family(2, 25, 120, 9), *family(3, 5, 9, 1), *family(4, 12, 40, 4)]
    passage = " ".join(f"p{i}" for i in range(30))
    rng = random.Random(9)
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    texts += ["a b c", "A b\tc", "a b", "", None, "  \n ", "one", "one", passage, passage.upper()]
    return list(enumerate(texts))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (3, 50)])
def test_components_equal_all_pairs(spark, monkeypatch, width, percent):
    monkeypatch.setattr(tg, "SMALL_GROUP", 3)
    monkeypatch.setattr(tg, "BLOCK", 7)
    rows = corpus()
    got = tg.ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, width, percent)


def test_any_token_order_gives_the_same(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(tg, "WIDESPREAD_DOCS", 10**9)
    got = {r.doc_id: r.component_id for r in tg.ngram_jaccard_components(docs, 4, 85).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 4, 85).items()}


def test_keep_one_per_group(spark):
    rows = corpus() + [(None, "a b c d e f g h"), (0, corpus()[0][1]), (500, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit(1)).withColumn("n", F.lit("x"))
    kept = tg.keep_one_per_group(docs)
    assert kept.columns == ["doc_id", "text", "cls", "n"]
    want = components(corpus(), 5, 80)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 500)
    assert ids == sorted({c for n, c in want.values() if n} | {i for i, (n, _) in want.items() if not n})
    assert [r.doc_id for r in kept.collect() if r.text == "a b c d e f g h"] == [500]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert tg.ngram_jaccard_components(docs).collect() == []
    assert tg.keep_one_per_group(docs).collect() == []


def test_one_of_each_group_stays_whatever_the_columns_are_called(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, long, 7, 8, 9), (3, long, 7, 8, 9), (3, long, 7, 8, 9), (None, long, 7, 8, 9), (9, long + " more", 7, 8, 9), (1, "", 7, 8, 9), (1, "", 7, 8, 9), (2, None, 7, 8, 9), (8, "alone here", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, key int, __key int")
    kept = tg.keep_one_per_group(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(kept.collect(), key=repr)
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, long), (1, ""), (1, ""), (2, None), (8, "alone here")], key=lambda r: (r[0], str(r[1])))
    assert {(r.id, r["key"], r["__key"]) for r in got} == {(7, 8, 9)}
    assert tg.keep_one_per_group(docs.filter("false"), 5, 80).isEmpty()


def test_sets_of_many_texts_are_those_of_each():
    texts = [b"A b  c d", None, b"", b" \t\n", b"one", b"a b c d e a b c d e", "é ß x y\x0bz".encode(), b"a\x00b c"]
    plain = {}
    for width in (1, 2, 4):
        for text, got in zip(texts, tg.shingle_sets(texts, width)):
            words = (text or b"").lower().split()
            runs = [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
            assert len(got) == len(set(runs)) and list(got) == sorted(set(got.tolist()))
            key = frozenset(runs)
            assert plain.setdefault(key, got.tolist()) == got.tolist()
    assert len({tuple(v) for v in plain.values()}) == len(plain)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_pairs_are_compared_without_shuffling_every_set(spark, monkeypatch, sent):
    monkeypatch.setattr(tg, "SENT_PAIRS", sent)
    sets = [(i, tg.shingle_set(" ".join(f"w{x}" for x in range(i, i + 40)).encode(), 1).tobytes()) for i in range(30)]
    table = checkpoint(spark.createDataFrame(sets, "cls long, data binary"))
    pairs = spark.createDataFrame([(a, b) for a in range(1, 12) for b in range(a)], "a long, b long")
    out = tg.compared(pairs, table, 80, 60)
    shared = {d: 40 - d for d in range(1, 12)}
    want = {(a, b, 100 * shared[a - b] >= 80 * (40 + a - b)) for a in range(1, 12) for b in range(a) if 100 * shared[a - b] >= 60 * (40 + a - b)}
    assert {tuple(r) for r in out.collect()} == want
    if sent:  # the sets of neither side are dealt out by the first of a pair
        assert "hashpartitioning(a#" not in out._jdf.queryExecution().executedPlan().toString()


def test_copies_and_tokens_of_one_class_give_no_postings(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"w{i}" for i in range(58)) + " y z"
    rows = [(1, text), (1, text), (2, text), (None, text), (4, other), (5, "alone " * 3), (6, None)]
    got = tg.ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (4, 1), (5, 5), (6, 6)]


def test_sketches_bound_every_similarity_and_spare_the_sets_of_most_pairs(spark, monkeypatch):
    rng = random.Random(5)
    sets = []
    for i in range(40):
        words = [f"w{x}" for x in range(rng.choice([0, 1, 30, 90, 400]))]
        words = [f"z{rng.randrange(10**6)}" if rng.random() < rng.choice([0.02, 0.3]) else w for w in words]
        sets.append(tg.shingle_set(" ".join(words).encode(), 1))
    table = checkpoint(spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "cls long, data binary"))
    exact = {(a, b): (len(x := set(sets[a].tolist()) & set(sets[b].tolist())), len(sets[a]) + len(sets[b]) - len(x)) for a in range(40) for b in range(a)}
    want = {p for p, (both, union) in exact.items() if 100 * both >= 85 * union}
    pairs = spark.createDataFrame(list(exact), "a long, b long")
    may = {(r.a, r.b) for r in tg.bounded(pairs, table, 85, 60).filter("may").collect()}
    assert want <= may and len(may) < len(exact) / 2
    asked = []
    whole = tg.compared
    monkeypatch.setattr(tg, "compared", lambda p, *more: asked.append(p.count()) or whole(p, *more))
    assert {tuple(r) for r in tg.verified(pairs, table, 85).select("a", "b").collect()} == want
    assert asked == [len(may)]


def test_a_family_is_connected_without_comparing_all_its_pairs(spark, monkeypatch):
    sets = [(i, tg.shingle_set(" ".join([f"f{i // 10}x{x}" for x in range(60)] + [f"own{i}"]).encode(), 1).tobytes()) for i in range(30)]
    table = checkpoint(spark.createDataFrame(sets, "cls long, data binary"))
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)], "a long, b long")
    asked = []
    whole = tg.compared
    monkeypatch.setattr(tg, "compared", lambda p, *more: asked.append(p.count()) or whole(p, *more))
    links = tg.connecting(pairs.filter("floor(a / 10) = floor(b / 10)"), table, 85)
    got = {r.node: r.root for r in tg.connected_components(links).collect()}
    assert got == {i: i // 10 * 10 for i in range(30)} and asked == [27, 0]
