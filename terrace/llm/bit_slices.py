"""Exact top-k by integer inner product over a bit-sliced index.

Index: blocks of rows; each dimension's integers, shifted to start at 0 and cut to
their leading bits, are stored as slices, one bitmap a bit.  A query adds slices,
weighted by the bits of its own components, column by column with carry-save
bitmap adders; the sums come out as slices again.  The top rows are taken from the
most significant slice downward.  The bits that were cut bound the true score from
both sides; only rows whose bounds reach the boundary are scored exactly.

Blocks of queries meet blocks of rows by an equi-join on the row block's number;
each pair of blocks yields at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint

#: Rows of an index block and of a query block.
ROW_BLOCK, QUERY_BLOCK = 16384, 512
#: Leading bits of a dimension's range that are kept as slices.
SLICES = 7


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as array<bigint>; null where the vector is null, empty or holds null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & fine, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _index_block(key: tuple, group: pa.Table) -> pa.Table:
    ids = group.column("id").to_numpy()
    rows = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low = rows.min(axis=0)
    widest = int((rows - low).max())
    cut = max(0, widest.bit_length() - SLICES)
    kept = (rows - low) >> cut
    bits = max(1, int(kept.max()).bit_length())
    words = -(-len(ids) // 64)
    slices = np.zeros((rows.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((kept >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    kind = np.promote_types(np.min_scalar_type(int(rows.min())), np.min_scalar_type(-1 - int(rows.max())))
    return pa.table({
        "dims": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
        "cut": pa.array([cut], pa.int32()), "bits": pa.array([bits], pa.int32()), "low": pa.array([low.tobytes()]), "ids": pa.array([ids.tobytes()]),
        "vectors": pa.array([rows.astype(kind).tobytes()]), "kind": pa.array([kind.str]), "slices": pa.array([slices.tobytes()]),
    })


INDEX = "dims int, block long, n int, cut int, bits int, low binary, ids binary, vectors binary, kind string, slices binary"


def build_index(vectors: DataFrame) -> DataFrame:
    """Index blocks of ``vectors`` (id, v: array<bigint>): every row is in one block of its dimension count."""
    sized = vectors.withColumn("dims", F.size("v"))
    counts = sized.groupBy("dims").agg(F.count("*").alias("rows"))
    blocks = counts.select("dims", F.ceil(F.col("rows") / ROW_BLOCK).alias("blocks"))
    placed = sized.join(blocks, "dims").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return placed.groupBy("dims", "block").applyInArrow(_index_block, INDEX)


def add_slices(weights: np.ndarray, slices: np.ndarray) -> list[np.ndarray]:
    """Slices of sum(weights[d] * column d) for weights of 0 or more, by carry-save addition of bitmaps."""
    columns: dict[int, list[np.ndarray]] = {}
    top = int(weights.max()).bit_length() if len(weights) else 0
    for j in range(top):
        chosen = slices[(weights >> j) & 1 == 1]
        for s in range(slices.shape[1]):
            if len(chosen):
                columns.setdefault(j + s, []).append(chosen[:, s])
    out: list[np.ndarray] = []
    at = 0
    while columns:
        stack = columns.pop(at, None)
        maps = np.concatenate(stack) if stack else np.zeros((1, slices.shape[2]), np.uint64)
        while len(maps) > 1:
            three = len(maps) // 3 * 3
            if three:
                a, b, c = maps[0:three:3], maps[1:three:3], maps[2:three:3]
                half = a ^ b
                carry, total, rest = a & b | half & c, half ^ c, maps[three:]
            else:
                carry, total, rest = maps[:1] & maps[1:], maps[:1] ^ maps[1:], maps[2:]
            columns.setdefault(at + 1, []).append(carry)
            maps = np.concatenate([total, rest])
        out.append(maps[0])
        at += 1
    return out


def top_rows(slices: list[np.ndarray], k: int, among: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmap of rows, value): the value of the k-th largest sum and the rows that reach it, most significant slice first."""
    sure, tied, value = np.zeros_like(among), among.copy(), 0
    have = 0
    for b in range(len(slices) - 1, -1, -1):
        ones = tied & slices[b]
        n = int(np.bitwise_count(ones).sum())
        if have + n >= k:
            tied, value = ones, value | 1 << b
        else:
            sure, tied, have = sure | ones, tied & ~slices[b], have + n
    return sure | tied, value


def _reaching(slices: list[np.ndarray], least: int, among: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is ``least`` or more."""
    if least <= 0:
        return among
    if least >> len(slices):
        return np.zeros_like(among)
    above, tied = np.zeros_like(among), among.copy()
    for b in range(len(slices) - 1, -1, -1):
        if least >> b & 1:
            tied = tied & slices[b]
        else:
            above, tied = above | tied & slices[b], tied & ~slices[b]
    return above | tied


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                ids, low = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["low"], np.int64)
                rows = np.frombuffer(block["vectors"], block["kind"]).astype(np.int64).reshape(len(ids), block["dims"])
                slices = np.frombuffer(block["slices"], np.uint64).reshape(block["dims"], block["bits"], -1)
                everyone = np.frombuffer(np.packbits(np.ones(len(ids), np.uint8), bitorder="little").tobytes().ljust(slices.shape[2] * 8, b"\0"), np.uint64)
                cut = block["cut"]
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                queries = np.frombuffer(block["query_vectors"], np.int64).reshape(-1, block["dims"])
                for qid, q in zip(np.frombuffer(block["query_ids"], np.int64).tolist(), queries):
                    # a negative weight adds the complement of its slices: the same order, a constant more in every row
                    sums = add_slices(np.abs(q), np.where((q < 0)[:, None, None], ~slices, slices))
                    # score = 2**cut * sum + a constant + what the cut bits add, of which rows differ by ``slack`` at most
                    slack = int(np.abs(q).sum()) * ((1 << cut) - 1)
                    # ids are in order; the query's own rows, however many, take none of the k places
                    own = np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right")
                    others = everyone
                    if own[0] < own[1]:
                        flags = np.unpackbits(everyone.view(np.uint8), bitorder="little")
                        flags[own[0] : own[1]] = 0
                        others = np.packbits(flags, bitorder="little").view(np.uint64)
                    kth = top_rows(sums, k, others)[1] if len(ids) - (own[1] - own[0]) > k else 0
                    near = _reaching(sums, kth - (-(-slack >> cut)), others)
                    chosen = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(ids)])
                    score = rows[chosen] @ q
                    best = np.lexsort((ids[chosen], -score))[:k]
                    found.append((qid, ids[chosen][best], score[best]))
                names = ["query_id", "vec_id", "score"]
                columns = [np.repeat([f[0] for f in found], [len(f[1]) for f in found]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return run


def _query_block(key: tuple, group: pa.Table) -> pa.Table:
    vectors = group.column("v").combine_chunks().flatten().to_numpy()
    return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "query_ids": pa.array([group.column("id").to_numpy().tobytes()]), "query_vectors": pa.array([vectors.tobytes()])})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for each query, its own id left out.

    ``vectors`` and ``queries``: (id, v: array<bigint>), integers as ``quantised`` gives them.
    Ties go to the smaller id.  Scores are exact while they fit a 64-bit integer.

    Defined cases: null ids and null or empty vectors take no part; only vectors of
    the query's length are candidates; fewer than ``k`` candidates are all returned;
    rows repeated under one id are candidates each; queries repeated under one id
    and vector give one answer; empty tables give an empty one.
    """
    fine = "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
    index = checkpoint(build_index(vectors.select("id", "v").filter(fine)))
    asked = queries.select("id", "v").filter(fine).distinct().withColumn("dims", F.size("v"))
    counts = asked.groupBy("dims").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("qblocks"))
    packed = asked.join(counts, "dims").withColumn("qblock", F.pmod(F.xxhash64("id"), "qblocks")).groupBy("dims", "qblock")
    packed = packed.applyInArrow(_query_block, "dims int, query_ids binary, query_vectors binary")
    # every query block is sent to each block of its dimension count, named by its number
    targets = index.select(F.col("dims").alias("to_dims"), "block")
    sent = packed.join(targets, F.col("dims") == F.col("to_dims")).drop("to_dims")
    schema = "query_id long, vec_id long, score long"
    near = sent.join(index, ["dims", "block"]).mapInArrow(_search(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
