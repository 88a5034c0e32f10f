"""Helpers the operators of this subpackage share: shared folders, word hashing, row keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.scale import checkpoint, ensure_checkpoint_dir, release

__all__ = [
    "WHITE", "apart", "checkpoint", "chunks", "fresh", "hashed_words", "keyed_texts", "mix", "put_back", "release", "rolling", "shared_path", "sieve", "small_side", "text_key",
    "texts_of", "through", "word_hashes", "word_places",
]

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a regular expression class body.
WHITE = r"\x20\x09-\x0D"
_WHITE_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Most words a worker remembers the hash of; the cache starts anew beyond it.
CACHED_WORDS = 150_000
#: Rows of a checked table up to which it is sent to every task; larger ones are joined by a shuffle.
MAX_SENT_ROWS = 300_000
#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 4 << 20
#: Bits of a sieve for each key, and at most: 16 MB, the bound of what is sent to every task.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 27


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def apart(docs: DataFrame, needed: tuple[str, ...], **made: Column) -> DataFrame:
    """``docs`` with columns other than ``needed`` renamed by their place, and the columns ``made`` added.

    No column of the caller can then have the name of a work column or of a result; ``put_back`` names them again.
    """
    names = [c if c in needed else f"__user_{i}" for i, c in enumerate(docs.columns)]
    # names are given by place, as two of the caller's may differ only in case
    return docs.select("*", *[v.alias(k) for k, v in made.items()]).toDF(*names, *made)


def put_back(result: DataFrame, docs: DataFrame, added: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` but ``without``, from a ``result`` over ``apart(docs, ...)``, and those ``added``, which replace columns of their names."""
    left_out = {a.lower() for a in (*added, *without)}
    have = set(result.columns)
    places = [(f"__user_{i}" if f"__user_{i}" in have else c, c) for i, c in enumerate(docs.columns) if c.lower() not in left_out]
    return result.select(*[F.col(f"`{c}`") for c, _ in places], *added).toDF(*[name for _, name in places], *added)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """64-bit key of a text; null and empty texts differ."""
    return F.xxhash64(text.isNull(), text)


def small_side(table: DataFrame) -> DataFrame:
    """``table``, checkpointed, and marked for broadcast where its row count is below MAX_SENT_ROWS."""
    table = checkpoint(table)
    return F.broadcast(table) if table.count() <= MAX_SENT_ROWS else table


def sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap that lets the 64-bit hashes of the only column of ``keys`` through, and few others.

    It spares a shuffle of rows that a join drops anyway; the join still follows.  Beyond
    MOST_SIEVE_BITS / SIEVE_BITS keys it lets more others through.
    """
    (name,) = keys.columns
    bits = 1 << (min(max(SIEVE_BITS * keys.count(), 64), MOST_SIEVE_BITS) - 1).bit_length()
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(1L, cast(`{name}` & 63L AS int))")
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def through(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of 64-bit ``hashes`` pass a ``sieve``."""
    at = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) with the text as UTF-8 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))


def texts_of(keyed: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """(cls, text, *more): the text of each row of ``wanted`` (cls, want_id, want_key, *more), one row each.

    Only the wanted texts are shuffled, if any; rows of ``keyed`` that are equal in id
    and text count once.
    """
    wanted = small_side(wanted)
    same = (F.col("text_key") == F.col("want_key")) & F.col("doc_id").eqNullSafe(F.col("want_id"))
    texts = keyed.join(wanted, same).select("cls", "text", *more)
    repeated = keyed.select("doc_id", "text_key").join(wanted, same).groupBy("cls", *more).agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return texts
    return texts.groupBy("cls", *more).agg(F.first("text").alias("text")).select("cls", "text", *more)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased."""
    words = text.lower().split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``width`` words; empty when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words ``[^\\x20\\x09-\\x0D]+`` of an array of bytes."""
    edge = np.diff((~_WHITE_BYTES[data]).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data`` at ``starts`` to ``ends``, eight bytes of all words at a time."""
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(1))
    left, at = np.arange(len(starts)), 0
    while len(left):
        rest = sizes[left] - at
        own = np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) + (lanes[starts[left] + at] & own))
        left, at = left[rest > 8], at + 8
    return out


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``size`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // size
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))


def filesystem(uri: str):
    """(file system, path) of a folder in whatever store the cluster shares."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data) -> None:
    """Write a file whole or not at all, so that a repeated task attempt does no harm."""
    fs, path = filesystem(uri)
    draft = f"{path}.{os.getpid()}-{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        for part in data:
            out.write(part)
    fs.move(draft, path)


def make_folder(spark: SparkSession, uri: str) -> str:
    """Create a folder through Spark's own file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return uri
