"""Importance resampling against a plain version, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from terrace.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _plain(rows, target, percent, seed, least_words, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in _features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in _features(x, longest)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = _features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=repr)


def _rows(n, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(80)] + ["Über", "naïve", "X-ray", "a.b", "　wide", "z\x7f", "9"]
    rows = [(i * 37 - 500, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(n)]
    return [*rows, (10**14, None), (10**14 + 1, ""), (-(2**63), "one " * 25), (2**63 - 1, "two " * 25), (5, " ".join(pool * 2_000)), (None, "w1 " * 30)]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 60), (2, 1, 100)])
def test_ranks_equal_a_plain_version(spark, monkeypatch, longest, buckets, percent):
    monkeypatch.setattr(resampling, "BLOCK_BITS", 5)
    rows, target = _rows(300, 1), ["w1 w2 w3 Über " * 9, "w5", None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, wanted, percent, 11, 20, longest, buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows, target, percent, 11, 20, longest, buckets)


@pytest.mark.parametrize("digit_bits", [3, 12])
def test_radix_ranks_equal_sorted(spark, monkeypatch, digit_bits):
    monkeypatch.setattr(resampling, "DIGIT_BITS", digit_bits)
    monkeypatch.setattr(resampling, "BLOCK_BITS", 4)
    rng = random.Random(2)
    rows = [(rng.randint(-3, 3), rng.choice([None, rng.randint(-5, 5)])) for _ in range(90)]
    if digit_bits == 12:  # a difference beyond a long
        rows += [(-(2**63), 2**63 - 1), (2**63 - 1, -(2**63))]
    docs = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = sorted((r["rank"], r.a, r.b) for r in resampling.radix_ranked(docs, "a", "b").collect())
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]


def test_a_pass_is_stable(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "BLOCK_BITS", 3)
    rows = [(i * 5, (i * 7) % 3, i) for i in range(100)]
    got = resampling.counting_pass(spark.createDataFrame(rows, "pos long, d int, i int").repartition(9), F.col("d")).orderBy("pos").collect()
    assert [(r.d, r.i) for r in got] == sorted((d, i) for _, d, i in rows) and [r.pos for r in got] == list(range(100))


def test_defined_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30, 9, 9, 9, 9, 9)] * 20, "doc_id long, text string, rank int, pos int, score int, digit int, __high int")
    assert resampling.resampled(none, none).isEmpty()
    got = resampling.resampled(some, none, 10).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 20
    assert resampling.resampled(some.limit(9), none, 10).filter("rank IS NOT NULL").isEmpty()
    assert [tuple(r) for r in resampling.drawn(some, none, 5).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        resampling.resampled(none, none, 101)
