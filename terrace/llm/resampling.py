"""Importance resampling towards a target distribution, drawn by a distributed radix sort.

Runs of words are hashed into buckets and counted over all documents and over the target
texts.  The log ratio of a bucket's shares is its gain; the gains are one array of fixed
length that is sent to every task, which scores each text by indexing it.  A hashed Gumbel
draw is added to the score, so that the highest scores are a sample without replacement.

The ranks come from a least-significant-digit radix sort of the composite key (score
falling, doc_id rising).  Every pass is a stable counting sort: rows lie in blocks of at most
BLOCK_ROWS; each block counts its digits; prefix sums over (digit, block) give the place where
a block's rows of a digit begin; a row's destination is that plus its place among its block's rows
of the same digit.  After the last pass the destinations are the ranks.  Digits in which all
keys agree are passed over.  Every pass is checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import CACHED_WORDS, checkpoint, chunks

#: Bits of a digit, and of the number of rows of a block.
DIGIT_BITS, BLOCK_BITS = 12, 20
BLOCK_ROWS = 1 << BLOCK_BITS
#: Bytes that are no part of a word become spaces and A-Z small letters; others stay.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


class _Buckets(dict):
    """Feature -> bucket; starts anew when it has grown too large."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[feature] = crc32(feature) % self.buckets
        return value


def _features(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                for text in part.column("text").to_pylist():
                    found = _features(words_of(text), longest)
                    total += np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def _bytes(texts: DataFrame, *more: str) -> DataFrame:
    return texts.select(*more, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How often features fall into each bucket, over all ``texts`` (text)."""
    rows = _bytes(texts).mapInArrow(_counted(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the target's share of a bucket to the source's."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    size = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (float(source.sum()) + size) / ((s + 1) * (float(target.sum()) + size)))).astype(np.int64)


def _scored(sent, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        known = _Buckets(len(gain))
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    found = _features(words, longest)
                    sum_ = int(gain[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum())
                    rows.append((len(words), len(found), sum_ // len(found) if found else 0))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _gumbel(seed: int) -> Column:
    """floor(1000 g) of a Gumbel value that the seed and the document's id set."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digits(key: Column, least: int, most: int, falling: bool) -> list[Column]:
    """Digits, the least first, whose order is that of ``key`` (falling: turned round), a long from ``least`` to ``most``."""
    bits = (most - least).bit_length()
    if bits == 64:
        # the difference is no long: turn the sign bit (falling: all others) instead
        whole = key.bitwiseXOR(F.lit((1 << 63) - 1 if falling else -(1 << 63)).cast("long"))
    else:
        whole = F.lit(most).cast("long") - key if falling else key - F.lit(least).cast("long")
    passes = -(-bits // DIGIT_BITS)
    width = -(-bits // passes) if passes else 0
    return [F.shiftrightunsigned(whole, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(passes)]


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable pass: ``rows`` (pos, ...) with ``pos`` the place by ``digit``, then by the place before; dense from 0.

    ``pos`` must differ between rows; rows of one block differ in its last BLOCK_BITS bits only.
    """
    rows = checkpoint(rows.withColumn("digit", digit).withColumn("block", F.shiftright("pos", BLOCK_BITS)))
    counts = rows.groupBy("block", "digit").agg(F.count("*").alias("n"))
    counts = checkpoint(counts)
    # 2 ** DIGIT_BITS rows at most
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    bases = digits.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(bases), "digit")
    offsets = offsets.select("block", "digit", (F.col("base") + F.col("earlier")).alias("start"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("pos")) - 1
    placed = rows.withColumn("within", within).join(offsets, ["block", "digit"])
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("pos", "digit", "block")]
    return placed.select((F.col("start") + F.col("within")).alias("pos"), *keep)


def radix_ranked(rows: DataFrame, falling: str, rising: str) -> DataFrame:
    """``rows`` with ``rank`` (long, from 1) by ``falling`` falling, then ``rising`` rising, nulls of it last.

    ``falling`` and ``rising`` are longs, the first without nulls.  Rows equal in both take ranks beside each other.
    """
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in {falling, rising} for n, f in (("min", F.min), ("max", F.max))], F.max(F.col(rising).isNull()).alias("none")).first()
    if ends[f"min_{falling}"] is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # a row's first place: blocks are cut from the partitions of the checkpointed rows
    keyed = checkpoint(checkpoint(rows).withColumn("pos", F.monotonically_increasing_id()))
    passes = []
    if ends[f"min_{rising}"] is not None:
        least = F.lit(ends[f"min_{rising}"]).cast("long")
        passes += _digits(F.coalesce(F.col(rising), least), ends[f"min_{rising}"], ends[f"max_{rising}"], False)
    passes += [F.col(rising).isNull().cast("int")] if ends["none"] else []
    passes += _digits(F.col(falling), ends[f"min_{falling}"], ends[f"max_{falling}"], True)
    for digit in passes or [F.lit(0)]:
        keyed = counting_pass(keyed, digit)
    return keyed.withColumn("rank", F.col("pos") + 1).drop("pos")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 0, least_words: int = 20, longest: int = 1, buckets: int = 10_000
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), all long, one row for every row of ``docs`` (doc_id, text).

    Features are runs of 1 to ``longest`` words; ``target`` (text) sets the wanted distribution.
    Of the N documents with ``least_words`` words or more the floor(percent * N / 100)
    with the highest scores are drawn, ties to the smaller doc_id; their rank counts from 1.

    Defined cases: null and empty texts and texts without a word have no feature and weight 0;
    a null doc_id draws as the empty id and comes after all others of its score; repeated rows are
    documents of their own; with an empty target all gains come from the documents alone;
    an empty table gives an empty one; further columns are ignored, whatever their names.
    """
    if not 0 <= percent <= 100 or longest < 1 or buckets < 1:
        raise ValueError("percent must lie in 0..100, longest and buckets must be 1 or more")
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    texts = _bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    scored = texts.mapInArrow(_scored(sent, longest), "doc_id long, n_words long, n_features long, weight long")
    scored = checkpoint(scored.withColumn("score", F.col("weight") + _gumbel(seed)))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    ranked = radix_ranked(scored.filter(able), "score", "doc_id")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 0, **options: int) -> DataFrame:
    """The (doc_id, rank) of the documents that ``resampled`` draws."""
    return resampled(docs, target, percent, seed, **options).filter("rank IS NOT NULL").select("doc_id", "rank")
