"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import (
    bit_slices, credentials, kneser_ney, langid, line_dedup, mixing, paragraphs, pieces, quality, resampling, token_groups, warc, whitening,
)
from terrace.llm.common import checkpoint
from terrace.llm.twins import TWINS

#: Rate and seed of the registered merge-dropout.
DROPOUT, SEED = 0.1, 20
#: Powers that temper the present shares, and the share of tokens of the registered mix.
POWERS, BUDGET = {"source": 0.5, "lang": 0.5, "topic": 0.7}, 0.5


def piece_model() -> str:
    """Path of the public 32,000-piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with merge-dropout, and whether they decode to the text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.xxhash64("text").alias("key"))
    coded = pieces.encode(docs, piece_model(), DROPOUT, SEED, carry=["doc_id", "key"])
    back = pieces.decode(coded, piece_model())
    return back.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", (F.xxhash64("decoded") == F.col("key")).alias("lossless"))


def _remainder(divisor: int) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves 1; a null id counts as no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 1, F.lit(False))


def op2_kneser_ney_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", _remainder(5).alias("held_out"), "text")
    model = kneser_ney.train(docs.filter("NOT held_out"), order=3)
    scored = kneser_ney.scored(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), bit_slices.quantised(F.col("embedding")).alias("v"))
    return bit_slices.top_k(vectors, vectors.filter("id % 100 = 0"), 10)


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_credentials(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in credentials.STRONG], F.sha2(credentials.rendered(F.col("base_spans")), 256).alias("base_sha256"),
        credentials.rendered(F.col("spans")).alias("spans"),
    )


def op5_paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur again, kept or removed, with the document whose copy stays."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return paragraphs.repeated_passages(docs).select("doc_id", "keeper_doc_id", "removed", "start", "end", "paragraphs")


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.ngram_jaccard_components(_documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = warc.write_archives(pages)
    captures = warc.assemble(checkpoint(warc.read_records(manifest, with_payload=False)))
    fields = F.col("metadata.fields")
    return captures.select(
        fields["page-id"].cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"),
        fields["refers-to-page"].cast("long").alias("refers_to"), 
    )


def op8_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text", _remainder(3).alias("held_out"))
    model = langid.train(docs.filter("NOT held_out"))
    return langid.identified(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), carry_text=False)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return mixing.mixed(docs, POWERS, BUDGET, SEED).drop("text")


def op11_reversible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least 10 documents hold, by a store that holds them all."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    store = line_dedup.insert(line_dedup.empty_store(spark, least_docs=10), docs)
    kept = line_dedup.deduplicated(docs, store)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components, one row each."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(table, scale=64, most=32)
    rows = whitening.whitened(table, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error, shares = (model.n, whitening.identity_error(table, model), model.shares().tolist()) if model else (0, 0.0, [0.0])
    explained = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("at") + 1)
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score, and its rank in a draw of a tenth."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    drawn = resampling.resampled(_documents(spark, sf_dir), target, percent=10, seed=2024, least_words=20, longest=1, buckets=10_000)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_piece_coding, op2_kneser_ney_score, op3_bit_sliced_top_k, op4_credential_links, op5_paragraph_repeats,
        op6_token_group_join, op7_warc_transactions, op8_word_first_language, op9_adaptive_quality, op10_raked_mix,
        op11_reversible_lines, op12_spectral_whitening, op13_radix_resampling,
    )
}
ORACLES = {k: v for k, v in TWINS.items() if k in QUERIES}
