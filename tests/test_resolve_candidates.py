"""Candidate search of the resolver against trying every pair, and its cost for long and common names."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.operators import resolve


def _tables(spark, teams, clubs):
    t = spark.createDataFrame([("B", n, n) for n in teams], "block string, team string, n string")
    c = spark.createDataFrame([("B", i, n, n) for i, n in enumerate(clubs)], "block string, cid long, name string, nn string")
    return t, c


def _brute(teams, clubs):
    held, near = {}, {}
    for n in teams:
        inside = [i for i, b in enumerate(clubs) if n and b and (n in b or b in n)]
        if len(inside) == 1:
            held[n] = inside[0]
        scores = [(-SequenceMatcher(None, n, b).ratio(), i) for i, b in enumerate(clubs) if n and b]
        if scores and -min(scores)[0] >= resolve.SIMILARITY_FLOOR:
            near[n] = min(scores)[1]
    return held, near


@pytest.mark.parametrize("letters", ["ab", "abcde", "abcdefghijklmnopqrstuvwxyz"])
def test_hits_equal_trying_every_pair(spark, letters):
    rng = random.Random(len(letters))
    clubs = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "united", "united"]
    teams = {"", "united", "cityunited"}
    for b in clubs:
        if b:
            i = rng.randrange(len(b))
            teams |= {b, b[:i] + rng.choice(letters) + b[i + 1 :], b[:i] + b[i + 1 :], b[: i + 1], b[i:], b + "zz", b[:i] + "q" + b[i:]}
    teams = sorted(teams)
    t, c = _tables(spark, teams, clubs)
    held, near = _brute(teams, clubs)
    assert {r.team: r.cid for r in resolve.containment_hits(t, c).collect()} == held
    assert {r.team: r.cid for r in resolve.similarity_hits(t, c).collect()} == near


def test_keys_grow_with_the_length_of_a_name(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(10_000))
    keys = spark.createDataFrame([(long,)], "s string").select(F.size(text.grams(F.col("s"), resolve.ANCHORS)).alias("n")).first()["n"]
    assert keys <= len(resolve.ANCHORS) * len(long)
    t, c = _tables(spark, [long[500:540], "x" * 30], [long, "unrelated"])
    assert [(r.team, r.cid) for r in resolve.containment_hits(t, c).collect()] == [(long[500:540], 0)]


def test_trigrams_that_all_names_share_are_not_joined_on(spark):
    clubs = [f"{i:04d}sportingclub" for i in range(300)]
    c = spark.createDataFrame([("B", n) for n in clubs], "block string, s string")
    held = c.select("block", F.explode(text.trigrams(F.col("s"))).alias("g")).groupBy("block", "g").agg(F.count("*").alias("held"))
    rare = resolve._rare_grams(c, held, resolve.SIMILARITY_FLOOR)
    assert rare.filter("g = 'lub'").isEmpty() or rare.filter("g = 'spo'").isEmpty()
    assert rare.groupBy("s").count().agg(F.max("count")).first()[0] == 3 * int(16 * 2 / 9) + 1
