"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A store holds three tables in the shared folder, a new version of each per update:

* ``refs`` (doc_id, hi, lo): the distinct line keys of every document held, 128-bit hashes;
* ``counts`` (shard, hi, lo, n): the exact number of documents that hold a key;
* ``filters`` (shard, salt, slots, extra): per shard a cuckoo filter of the keys of at
  least ``least_docs`` documents, and the other keys of the shard that it answers for
  wrongly.  Filter and list together answer exactly for every key of the store.

Inserting documents adds to the counts; keys that reach the bound enter their shard's filter.
Deleting documents takes their references off again; keys that fall below the bound leave
the filter, which cuckoo filters allow, so that any order of insertions and deletions ends in
the state of the documents that are left.  Dropping lines reads the texts once and asks the
filters alone: they are sent to every task while they have SENT_BYTES at most; beyond that,
line keys are dealt to (shard, part) groups and meet their shard's filter there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import chunks, keyed_texts, mix, shared_path, text_key

#: Keys a shard is sized for; shards are dealt anew when they hold more than twice that.
KEYS_PER_SHARD = 500_000
#: Bytes of filters that are sent to every task rather than met by a shuffle.
SENT_BYTES = 24 << 20
#: Line keys of one (shard, part) group where filters are met by a shuffle.
GROUP_LINES = 1_000_000
#: Slots of a bucket, and evictions after which a filter is built anew with more buckets.
SLOTS, KICKS = 4, 500
_STRIPPED = b" \t\n\x0b\x0c\r"


class Store(NamedTuple):
    """A version of the store: the paths of its tables (None: empty) and its parameters."""

    spark: SparkSession
    refs: str | None
    counts: str | None
    filters: str | None
    shards: int
    least_docs: int
    least_chars: int

    def table(self, name: str) -> DataFrame:
        path = getattr(self, name)
        schema = {"refs": REFS, "counts": COUNTS, "filters": FILTERS}[name]
        return self.spark.createDataFrame([], schema) if path is None else self.spark.read.schema(schema).parquet(path)


REFS = "doc_id long, hi long, lo long"
COUNTS = "shard int, hi long, lo long, n long"
FILTERS = "shard int, salt long, slots binary, extra binary"
MOVED = "hi long, lo long, n long, before long"


def empty_store(spark: SparkSession, least_docs: int = 10, least_chars: int = 1) -> Store:
    """A store without documents; keys of fewer than ``least_chars`` code points are never counted."""
    if least_docs < 1 or least_chars < 1:
        raise ValueError("least_docs and least_chars must be 1 or more")
    return Store(spark, None, None, None, 1, least_docs, least_chars)


class CuckooFilter:
    """Set of 128-bit keys by 32-bit fingerprints, two buckets a key; equal fingerprints are held as often as added."""

    def __init__(self, slots: np.ndarray, salt: int):
        self.slots, self.salt = slots, salt
        self.mask = np.uint64(len(slots) // SLOTS - 1)

    @classmethod
    def sized(cls, keys: int, salt: int = 0) -> CuckooFilter:
        buckets = 1 << max(math.ceil(math.log2(max(keys, 1) / (0.8 * SLOTS))), 0)
        return cls(np.zeros(buckets * SLOTS, np.uint32), salt)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of keys; fingerprints are never 0, the mark of a free slot."""
        salt = mix(np.array([self.salt + 1], np.uint64))
        mark = mix(lo ^ salt) >> np.uint64(32)
        mark = mark + (mark == 0)
        first = mix(hi + salt) & self.mask
        return mark.astype(np.uint32), first, first ^ (mix(mark) & self.mask)

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(hi, lo)
        table = self.slots.reshape(-1, SLOTS)
        return ((table[first] == mark[:, None]) | (table[second] == mark[:, None])).any(axis=1)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add keys; False where a key found no place (the filter is spoilt then and must be built anew)."""
        slots, mask = self.slots.tolist(), int(self.mask)
        for mark, *both in zip(*(x.tolist() for x in self.places(hi, lo))):
            turn = 0
            for turn in range(KICKS):
                free = next((s for b in both for s in range(b * SLOTS, (b + 1) * SLOTS) if not slots[s]), None)
                if free is not None:
                    slots[free] = mark
                    break
                bucket = both[turn % 2]
                out = bucket * SLOTS + turn % SLOTS
                mark, slots[out] = slots[out], mark
                both = [bucket, bucket ^ (int(mix(np.array([mark], np.uint64))[0]) & mask)]
            else:
                return False
        self.slots = np.array(slots, np.uint32)
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were added before."""
        for mark, *both in zip(*(x.tolist() for x in self.places(hi, lo))):
            at = next(s for b in both for s in range(b * SLOTS, (b + 1) * SLOTS) if self.slots[s] == mark)
            self.slots[at] = 0


def filter_of(hi: np.ndarray, lo: np.ndarray, salt: int = 0) -> CuckooFilter:
    """A filter of the keys; where one finds no place, the next salt and more buckets are tried."""
    room = len(hi)
    while True:
        built = CuckooFilter.sized(room, salt)
        if built.add(hi, lo):
            return built
        room, salt = 2 * room, salt + 1


def _key(line: bytes) -> bytes:
    return line.strip(_STRIPPED).lower()


def _line_keys(lines: list[bytes], least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) 128-bit hashes of the lines' keys, and which of them are long enough."""
    keys = [_key(x) for x in lines]
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    long = [len(k) > 0 if least_chars == 1 else len(k.decode(errors="replace")) >= least_chars for k in keys]
    return digests, np.array(long, bool)


def _references(least_chars: int):
    """(doc_id, text_key, hi, lo): the distinct keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                keys = []
                for text in part.column("text").to_pylist():
                    digests, long = _line_keys((text or b"").split(b"\n"), least_chars)
                    keys.append(np.unique(digests[long], axis=0))
                take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                both = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_key").take(take), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    ["doc_id", "text_key", "hi", "lo"],
                )

    return run


def _of_texts(docs: DataFrame, least_chars: int) -> DataFrame:
    return keyed_texts(docs).mapInArrow(_references(least_chars), "doc_id long, text_key long, hi long, lo long")


def _written(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, f"lines-{name}")
    df.write.parquet(path)
    return path


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.ascontiguousarray(table.column(name).to_numpy()).astype(np.int64)


def _shard_filter(least_docs: int):
    """The filter of a shard after an update, from its keys (shard, hi, lo, n, before) and the filter it had."""

    def run(keys: pa.Table, old: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return old.select(["shard", "salt", "slots", "extra"])
        hi, lo = (_numbers(keys, c).view(np.uint64) for c in ("hi", "lo"))
        n, before = _numbers(keys, "n"), _numbers(keys, "before")
        now, then = n >= least_docs, before >= least_docs
        if old.num_rows:
            held = CuckooFilter(np.frombuffer(old.column("slots")[0].as_py(), np.uint32).copy(), old.column("salt")[0].as_py())
            held.remove(hi[then & ~now], lo[then & ~now])
            new = now & ~then
            if now.sum() > 0.9 * len(held.slots) or not held.add(hi[new], lo[new]):
                held = filter_of(hi[now], lo[now], held.salt + 1)
        else:
            held = filter_of(hi[now], lo[now])
        wrong = (n > 0) & ~now
        wrong[wrong] = held.has(hi[wrong], lo[wrong])
        extra = np.stack([hi[wrong], lo[wrong]], axis=1).tobytes()
        row = [keys.column("shard")[0].as_py()], [held.salt], [held.slots.tobytes()], [extra]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "salt", "slots", "extra"])

    return run


def _updated(store: Store, refs: str, change: DataFrame) -> Store:
    """The store with ``refs``, its counts moved by ``change`` (hi, lo, d) and its filters refreshed."""
    if store.counts is None:
        moved = change.select("hi", "lo", F.col("d").alias("n"), F.lit(0).cast("long").alias("before"))
    else:
        zero = F.lit(0).cast("long")
        moved = store.table("counts").drop("shard").join(change, ["hi", "lo"], "full").select(
            "hi", "lo", (F.coalesce("n", zero) + F.coalesce("d", zero)).alias("n"), F.coalesce("n", zero).alias("before")
        )
    moved = store.spark.read.schema(MOVED).parquet(_written(moved.filter("n > 0 OR before > 0"), "moved"))
    held = moved.filter("n > 0").count()
    shards, old = store.shards, store.table("filters")
    if store.counts is None or held > 2 * KEYS_PER_SHARD * shards:
        shards, old = max(1, -(-held // KEYS_PER_SHARD)), store._replace(filters=None).table("filters")
        moved = moved.withColumn("before", F.lit(0).cast("long"))
    moved = moved.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    counts = _written(moved.filter("n > 0").select("shard", "hi", "lo", "n"), "counts")
    filters = moved.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_shard_filter(store.least_docs), FILTERS)
    return store._replace(refs=refs, counts=counts, filters=_written(filters, "filters"), shards=shards)


def insert(store: Store, docs: DataFrame) -> Store:
    """A new version of the store that holds ``docs`` (doc_id, text) too.

    Defined cases: rows of one doc_id are one document with the keys of all of them; a null
    doc_id is an id like others; documents whose id the store holds already are left out, so a
    repeated insertion changes nothing; null and empty texts hold no key; further columns are ignored.
    """
    refs = _of_texts(docs, store.least_chars).drop("text_key").distinct()
    if store.refs is not None:
        ids = store.table("refs").select(F.col("doc_id").alias("known")).distinct()
        refs = refs.join(ids, F.col("doc_id").eqNullSafe(F.col("known")), "left_anti")
    path = _written(refs, "refs")
    added = store.spark.read.schema(REFS).parquet(path)
    change = added.groupBy("hi", "lo").agg(F.count("*").alias("d"))
    if store.refs is not None:
        path = _written(store.table("refs").unionByName(added), "refs")
    return _updated(store, path, change)


def delete(store: Store, ids: DataFrame) -> Store:
    """A new version of the store without the documents of ``ids`` (doc_id); ids it does not hold are ignored."""
    gone = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone"))
    refs = store.table("refs")
    left = _written(refs.join(gone, same, "left_anti"), "refs")
    change = refs.join(gone, same, "left_semi").groupBy("hi", "lo").agg((-F.count("*")).alias("d"))
    return _updated(store, left, change)


def _answers(filters: list, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which keys of the store are in enough documents; ``filters``: (filter, extra keys) by shard, None where a shard is empty."""
    out = np.zeros(len(hi), bool)
    shard = hi.view(np.int64) % np.int64(len(filters))
    for s in np.unique(shard).tolist():
        if filters[s] is None:
            continue
        at = np.flatnonzero(shard == s)
        at = at[filters[s][0].has(hi[at], lo[at])]
        extra = filters[s][1]
        out[at] = [(a, b) not in extra for a, b in zip(hi[at].tolist(), lo[at].tolist())] if extra else True
    return out


def _loaded(salt: int, slots: bytes, extra: bytes) -> tuple[CuckooFilter, set]:
    pairs = np.frombuffer(extra, np.uint64).reshape(-1, 2)
    return CuckooFilter(np.frombuffer(slots, np.uint32), salt), set(map(tuple, pairs.tolist()))


def _without_lines(columns: list[str], least_chars: int, sent, listed: str | None):
    """Rows with the lines dropped that the filters (or the keys in column ``listed``) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if sent is None else [None if f is None else _loaded(*f) for f in sent.value]
        for batch in batches:
            for part in chunks(batch, "text"):
                texts, total, dropped = [], [], []
                keys = part.column(listed).to_pylist() if listed else [None] * part.num_rows
                for text, named in zip(part.column("text").to_pylist(), keys):
                    lines = (text or b"").split(b"\n")
                    digests, long = _line_keys(lines, least_chars)
                    gone = np.zeros(len(lines), bool)
                    if listed:
                        names = {named[i : i + 16] for i in range(0, len(named or b""), 16)}
                        gone[long] = [x.tobytes() in names for x in digests[long]] if names else False
                    elif long.any():
                        gone[long] = _answers(filters, *np.ascontiguousarray(digests[long].T))
                    count = int(gone.sum())
                    texts.append(text if not count else b"\n".join(x for x, g in zip(lines, gone.tolist()) if not g))
                    total.append(len(lines))
                    dropped.append(count)
                values = {"text": pa.array(texts, pa.binary()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([values.get(c, part.column(c) if c not in values else None) for c in columns], columns)

    return run


def _meet(lines: pa.Table, filters: pa.Table) -> pa.Table:
    hi, lo = (_numbers(lines, c).view(np.uint64) for c in ("hi", "lo"))
    found = np.zeros(len(hi), bool)
    if filters.num_rows and len(hi):
        held, extra = _loaded(*(filters.column(c)[0].as_py() for c in ("salt", "slots", "extra")))
        found = held.has(hi, lo)
        if extra:
            found &= np.array([(a, b) not in extra for a, b in zip(hi.tolist(), lo.tolist())], bool)
    keys = np.stack([hi[found], lo[found]], axis=1)
    out = lines.select(["doc_id", "text_key"]).filter(pa.array(found))
    return out.append_column("key", pa.array([x.tobytes() for x in keys], pa.binary()))


def _met_by_shuffle(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, text_key, keys): the keys to drop of each text, joined as bytes."""
    loads = store.table("counts").groupBy("shard").agg(F.ceil(F.sum("n") / GROUP_LINES).cast("int").alias("parts"))
    parts = F.broadcast(loads) if store.shards <= GROUP_LINES else loads
    lines = _of_texts(docs, store.least_chars).distinct().withColumn("shard", F.pmod("hi", F.lit(store.shards)).cast("int"))
    lines = lines.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), "parts").cast("int")).drop("parts")
    filters = store.table("filters").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = lines.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part"))
    found = found.applyInArrow(_meet, "doc_id long, text_key long, key binary")
    # the keys of one text: never more than its lines
    return found.groupBy("doc_id", "text_key").agg(F.array_join(F.collect_list(F.hex("key")), "").alias("keys")).withColumn("keys", F.unhex("keys"))


def deduplicated(docs: DataFrame, store: Store) -> DataFrame:
    """``docs`` (doc_id, text) without the lines whose key is in ``least_docs`` documents of the store, and n_lines, n_dropped (long).

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  ``text``
    holds the other lines joined by newlines; n_lines counts before dropping.
    Exact for texts whose keys the store knows; a key that it never saw is taken for a
    frequent one with a probability below 2e-9.

    Defined cases: null and empty texts have one empty line, which stays (null stays null);
    texts without lines to drop are unchanged; where all lines go the text is empty; repeated rows are
    answered alike; an empty table or store drops nothing; columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    columns = [*docs.columns, "n_lines", "n_dropped"]
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", n_lines long, n_dropped long"
    as_bytes = docs.withColumn("text", F.col("text").cast("string").cast("binary"))
    size = store.table("filters").agg(F.sum(F.octet_length("slots") + F.octet_length("extra")).alias("b")).first()["b"] or 0
    if size <= SENT_BYTES:
        filters: list = [None] * store.shards
        for row in store.table("filters").toLocalIterator():
            filters[row["shard"]] = (row["salt"], bytes(row["slots"]), bytes(row["extra"]))
        out = as_bytes.mapInArrow(_without_lines(columns, store.least_chars, store.spark.sparkContext.broadcast(filters), None), schema)
    else:
        names = {c: c for c in ("id", "key", "keys")}
        for c in names:
            while names[c] in docs.columns:
                names[c] = f"_{names[c]}"
        found = _met_by_shuffle(docs, store).toDF(names["id"], names["key"], names["keys"])
        same = (text_key(docs["text"]) == found[names["key"]]) & docs["doc_id"].cast("long").eqNullSafe(found[names["id"]])
        joined = docs.join(found, same, "left").select(
            *[F.col(f"`{c}`").cast("string").cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], names["keys"]
        )
        out = joined.mapInArrow(_without_lines(columns, store.least_chars, None, names["keys"]), schema)
    return out.withColumn("text", F.col("text").cast("string"))
