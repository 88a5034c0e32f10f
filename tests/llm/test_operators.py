"""Each operator on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import bit_slices, credentials, kneser_ney, langid, mixing, paragraphs, pieces, quality, warc
from terrace.llm.components import connected_components
from terrace.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (None, "plain words here", None, "a", 16),
    (4, "same text for two rows", "en", "a", 22), (4, "same text for two rows", "en", "a", 22), (5, LONG, "en", "b", len(LONG)),
    (6, "é▁日本\x00😀 ﬁ  two\n\nlines", "fr", "b", 20), (7, "x" * 500, "de", "b", 500),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("spans", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_round_trip_and_equal_the_library(odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for rate in (0.0, 0.3):
        coded = pieces.encode(odd, piece_model(), rate, 3)
        back = pieces.decode(coded, piece_model()).collect()
        assert all(r.decoded == r.text for r in back)
        if not rate:
            assert all(r.piece_ids == library.encode(r.text) for r in back if r.text is not None and "▁" not in r.text)
    assert pieces.encode(none, piece_model(), 0.1).collect() == []


def test_dropout_is_seeded_and_alike_in_table_and_heap(monkeypatch):
    model = pieces.load_model(piece_model())
    texts, keys = ["many different merges are possible in longwordswithoutspaces"] * 3, np.arange(3, dtype=np.uint64)
    ids, edges = pieces.encode_texts(model, texts, keys, 0.3)
    again, _ = pieces.encode_texts(model, texts, keys, 0.3)
    assert (ids == again).all() and len({tuple(ids[a:b]) for a, b in zip(edges, edges[1:])}) > 1
    monkeypatch.setattr(pieces, "WIDTHS", (4,))
    assert (pieces.encode_texts(model, texts, keys, 0.3)[0] == ids).all()


def test_kneser_ney_probabilities_add_to_one(spark, odd, none):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(12)))) for i in range(80)], "doc_id long, text string")
    for order in (1, 2, 3):
        model = kneser_ney.train(docs, order)
        words = np.concatenate([kneser_ney.word_hashes(b"a b c d e f g zz"), [kneser_ney.END]])
        context = kneser_ney.word_hashes(b"b a")[-(order - 1) :] if order > 1 else words[:0]
        p, _ = kneser_ney.token_scores(model, np.array([[*context, w] for w in words], np.uint64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()
    got = {r.doc_id: r for r in kneser_ney.scored(odd, model).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[5].n_tokens == 30_001
    assert kneser_ney.scored(none, kneser_ney.train(none.select("text"))).collect() == []


def test_bit_slices_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "ROW_BLOCK", 40)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 2) for _ in range(5)]) for i in range(150)] + [(200 + i, [1.0] * 5) for i in range(90)] + [(7, None), (8, []), (9, [float("nan")] * 5), (None, [1.0] * 5), (400, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, e array<double>").select("id", bit_slices.quantised(F.col("e")).alias("v"))
    got = collections.defaultdict(list)
    for r in bit_slices.top_k(frame, frame.filter("id % 50 = 0"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    fine = {}
    for i, v in rows:
        if i is not None and v and len(v) == 5 and all(x == x for x in v):
            fine.setdefault(i, np.floor(1024 * np.array(v)).astype(np.int64))
    for q in (0, 50, 100, 200, 250):
        want = sorted(((-int(fine[i] @ fine[q]), i) for i in fine if i != q))[:4]
        assert got[q] == [(i, -s) for s, i in want]
    assert bit_slices.top_k(frame.limit(0), frame.limit(0)).collect() == []


def test_credentials_link_only_complementary_parts(spark, odd, none):
    far = "user=bob " + "z " * 200 + "Zk3jf83kdk29dk20dkd9"
    rows = [(1, "user=bob then Zk3jf83kdk29dk20dkd9 at https://db.example.com/x"), (2, "Zk3jf83kdk29dk20dkd9 at https://db.example.com/x"), (3, far), (4, "TOKEN: 'abc' secret=token: abcdefg"), (5, None)]
    found = credentials.find_credentials(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [s.kind for s in r.spans] for r in found.collect()}
    assert got == {1: ["login", "opaque", "endpoint"], 2: [], 3: [], 4: [], 5: []}
    clean = credentials.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert credentials.find_credentials(none).collect() == []


def test_repeated_passages(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(30)]
    rows += [(100 + i, " ".join(word() for _ in range(37 + i)) + " " + passage + " " + " ".join(word() for _ in range(20))) for i in range(12)]
    line = [word() for _ in range(40)]
    rows += [(200 + i, word() + "\n" + " ".join(line[:i] + [word()] + line[i + 1 :]) + "\n" + word()) for i in range(14)] + [(300, None), (301, "")]
    got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {*range(100, 112), *range(200, 214)}
    assert {r.keeper_doc_id for r in got if r.removed and r.doc_id < 200} == {100}
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] in passage for r in got if r.doc_id < 200)
    assert paragraphs.repeated_passages(none).collect() == []
    cut = paragraphs.without_repeats(spark.createDataFrame([(1, passage), (2, passage + " tail")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text == passage for r in cut} == {1: True, 2: False}


def test_warc_round_trip(spark):
    big = "<p>é" + "y" * 1500
    rows = [(1, "http://a/b c", big), (2, "http://a", big), (5, None, big), (3, "http://s", "small"), (4, "http://s", "small"), (6, "u", None), (7, "u", ""), (None, "http://a", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    for payload in (True, False):
        got = warc.assemble(warc.read_records(warc.write_archives(pages), payload)).collect()
        assert len(got) == len(rows) and all(r.request is not None for r in got)
        for r in got:
            page = r.metadata.fields.get("page-id")
            html = dict((i, h) for i, _, h in rows)[None if page is None else int(page)] or ""
            assert r.response.payload_bytes == len(html.encode()) and r.response.payload_digest == hashlib.sha1(html.encode()).hexdigest()
            assert (r.response.type == "revisit") == (html == big and page != "5")
            if payload and r.response.type == "response":
                assert bytes(r.response.payload).decode() == html
    assert warc.assemble(warc.read_records(warc.write_archives(pages.limit(0)))).collect() == []


def test_language_backs_off(spark, odd, none):
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    labelled = spark.createDataFrame([(lang, make(letters)) for lang, letters in [("xx", "abcde"), ("yy", "vwxyz")] for _ in range(20)], "lang string, text string")
    model = langid.train(labelled)
    unseen = spark.createDataFrame([("edcbaabcde ecabd",), ("zzyxvw vvwzy",), ("123 ...",), (None,), ("",)], "text string")
    got = [(r.lang_pred, r.score) for r in langid.identified(unseen, model).collect()]
    assert [g[0] for g in got] == ["xx", "yy", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got)
    assert langid.identified(odd, langid.train(none)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identified(none, model).collect() == []


def test_quality_on_odd_rows(odd, none):
    got = quality.judged(odd)
    assert got.count() == len(ODD) and got.filter("kept AND base_failed").count() == 0
    assert quality.accepted(odd).columns == odd.columns
    assert quality.judged(none).collect() == [] and quality.accepted(none).collect() == []


def test_raked_margins_and_budget(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["en", "de", None]), rng.choice(["s", "s", "s", "t"]), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    powers = {"source": 0.3, "lang": 0.0, "topic": 1.0}
    got = mixing.mixed(docs, powers, 0.3, 1).toPandas()
    weight = got.n_tokens * got.probability
    assert weight.sum() == pytest.approx(0.3 * got.n_tokens.sum(), rel=0.01)
    shares = weight.groupby(got.lang.fillna("none")).sum() / weight.sum()
    assert shares.values == pytest.approx([1 / 3] * 3, abs=0.01)
    assert mixing.sampled(odd, powers, 1.0).columns == odd.columns
    assert mixing.mixed(none, powers, 0.5).collect() == []


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (None, 3), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
