"""Line dedup: filters, counts, insertions, deletions and dropped lines against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest

from terrace.llm import line_dedup


def _keys(rng, n):
    return rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)


def test_a_filter_holds_what_was_added_and_not_removed():
    rng = np.random.default_rng(1)
    hi, lo = _keys(rng, 20_000)
    held = line_dedup.filter_of(hi, lo)
    assert held.has(hi, lo).all()
    held.remove(hi[:15_000], lo[:15_000])
    assert held.has(hi[15_000:], lo[15_000:]).all() and not held.has(hi[:15_000], lo[:15_000]).any()
    assert held.add(hi[:15_000], lo[:15_000]) and held.has(hi, lo).all()
    held.remove(hi, lo)
    assert not held.slots.any()


def test_more_keys_than_slots_are_dealt_anew():
    hi, lo = _keys(np.random.default_rng(2), 100)
    small = line_dedup.CuckooFilter.sized(4)
    assert not small.add(hi, lo)
    assert line_dedup.filter_of(hi, lo).has(hi, lo).all()
    same = np.full(3, 7, np.uint64)
    twice = line_dedup.filter_of(same, same)
    twice.remove(same[:2], same[:2])
    assert twice.has(same, same).all()


def _plain(rows, held, least_docs, least_chars=1):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(white))
    docs = defaultdict(set)
    for i, text in held:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                docs[key(line)].add(i)
    hot = {k for k, ids in docs.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def _got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def _rows(n, seed):
    rng = random.Random(seed)
    pool = ["Terms of use", "  terms OF use\t", "Zur Startseite", "ä Ö", "Ä ö", "x", "", " ", "- - -", "more"] + [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(n)]
    rows += [(3, rows[3][1]), (3, "x\nTerms of use"), (None, "x\nmore"), (None, "x"), (n + 1, None), (n + 2, ""), (n + 3, "\n\n")]
    return [*rows, (n + 4, "\n".join(["More", "more "] * 20_000)), (n + 5, "only\r\nx\r")]


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("route", ["sent", "shuffled"])
def test_lines_go_as_in_a_plain_version(spark, monkeypatch, route):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 12)
    monkeypatch.setattr(line_dedup, "GROUP_LINES", 30)
    if route == "shuffled":
        monkeypatch.setattr(line_dedup, "SENT_BYTES", -1)
    rows = _rows(60, 4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    store = line_dedup.insert(line_dedup.empty_store(spark, 6), docs)
    assert store.shards > 1
    assert _got(line_dedup.deduplicated(docs, store)) == sorted(_plain(rows, rows, 6), key=repr)


def test_insertions_and_deletions_end_where_the_remaining_documents_lead(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 10)
    rows, rng = _rows(80, 5), random.Random(6)
    store, held = line_dedup.empty_store(spark, 5), {}
    for step in range(5):
        batch = [r for r in rows if (r[0] or 0) % 4 == step % 4]
        store = line_dedup.insert(store, spark.createDataFrame(batch, SCHEMA))
        for i in {i for i, _ in batch} - set(held):
            held[i] = [r for r in batch if r[0] == i]
        gone = rng.sample(sorted(held, key=repr), len(held) // 3)
        store = line_dedup.delete(store, spark.createDataFrame([(i,) for i in [*gone, -9]], "doc_id long"))
        for i in gone:
            del held[i]
        now = [r for rs in held.values() for r in rs]
        want = sorted(_plain(now, now, 5), key=repr)
        assert _got(line_dedup.deduplicated(spark.createDataFrame(now, SCHEMA), store)) == want
    store = line_dedup.delete(store, spark.createDataFrame([(i,) for i in held], "doc_id long"))
    assert store.table("refs").isEmpty() and store.table("counts").isEmpty()
    assert all(not any(r.slots) and not r.extra for r in store.table("filters").collect())


def test_a_repeated_insertion_changes_nothing(spark):
    docs = spark.createDataFrame(_rows(30, 7), SCHEMA)
    once = line_dedup.insert(line_dedup.empty_store(spark, 4), docs)
    twice = line_dedup.insert(once, docs)
    assert sorted(once.table("counts").collect()) == sorted(twice.table("counts").collect())


def test_wrong_answers_of_a_filter_are_listed(spark, monkeypatch):
    # fingerprints of few values: the filter answers wrongly for most keys, the list mends it
    places = line_dedup.CuckooFilter.places

    def poor(self, hi, lo):
        mark, first, _ = places(self, hi, lo)
        mark = (mark % 3 + 1).astype(np.uint32)
        return mark, first, first ^ (line_dedup.mix(mark.astype(np.uint64)) & self.mask)

    monkeypatch.setattr(line_dedup.CuckooFilter, "places", poor)
    rng = np.random.default_rng(3)
    import pyarrow as pa

    hi, lo = _keys(rng, 3000)
    n = np.where(np.arange(3000) < 40, 10, 1)
    keys = pa.table({"shard": pa.array(np.zeros(3000, np.int32)), "hi": hi.view(np.int64), "lo": lo.view(np.int64), "n": n, "before": n * 0})
    out = line_dedup._shard_filter(10)(keys, pa.table({"shard": pa.array([], pa.int32())}))
    loaded = [line_dedup._loaded(*(out.column(c)[0].as_py() for c in ("salt", "slots", "extra")))]
    assert len(loaded[0][1]) > 100
    assert (line_dedup._answers(loaded, hi, lo) == (n >= 10)).all()


def test_short_keys_are_left_alone_where_asked(spark):
    rows = [(i, "äöü\nabcd\nab") for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    store = line_dedup.insert(line_dedup.empty_store(spark, 3, least_chars=4), docs)
    assert _got(line_dedup.deduplicated(docs, store)) == _plain(rows, rows, 3, 4)


@pytest.mark.parametrize("sent", [1 << 20, -1])
def test_columns_with_clashing_names_and_empty_tables(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_BYTES", sent)
    more = ["id", "key", "keys", "_key", "hi", "lo", "shard", "n_lines", "text_key", "odd name"]
    docs = spark.createDataFrame([(i, "a\nb", *range(len(more))) for i in range(4)], ["doc_id", "text", *more])
    store = line_dedup.insert(line_dedup.empty_store(spark, 4), docs)
    got = line_dedup.deduplicated(docs, store).collect()
    assert [(r.text, r.n_lines, r.n_dropped, r["key"], r["odd name"], r["text_key"]) for r in got] == [("", 2, 2, 1, 9, 8)] * 4
    none = docs.filter("false")
    assert line_dedup.deduplicated(none, store).isEmpty()
    bare = line_dedup.insert(line_dedup.empty_store(spark, 4), none)
    assert {r.n_dropped for r in line_dedup.deduplicated(docs, bare).collect()} == {0}
    assert {r.n_dropped for r in line_dedup.deduplicated(docs, line_dedup.empty_store(spark)).collect()} == {0}
