"""Interpolated modified Kneser-Ney model, counted in Spark and memory-mapped by the workers that score.

Counting: every slice of texts sends its distinct n-grams with counts, packed per
shard, so a frequent n-gram costs one entry a slice.  A shard is a range of context
hashes; its task merges the counts, writes sorted hash arrays and hands the
distinct suffixes on to the next lower order, whose counts are the numbers of
distinct left neighbours.  Shards are as many as the corpus needs for a fixed number of
bytes each, so memory does not grow with it and the model grows in step with it.

Between shards n-grams travel as their words, which pack better than hashes of contexts.  Of a
sorted array of hashes the two leading bytes stand in a list of places, and counts are a byte that
names one of the most frequent values or a row of the rest, so a model takes about two thirds of plain arrays.

Scoring: each worker maps the arrays from the shared folder and looks up the
n-grams of a slice of texts in sorted order, so it touches each page once a slice.
N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint, chunks, filesystem, fresh, hashed_words, make_folder, mix, put_file, release, shared_path, word_places

#: Hashes of the marks before the first and after the last word; no word has them but by a hash collision.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Bytes of training text per shard.
SHARD_BYTES = 32 << 20
#: Code of a value that is not among the most frequent ones.
RARE = 255
ROWS = "level int, shard int, payload binary, n1 long, n2 long, n3 long, n4 long, total long, kinds long"


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and what is global: discounts by order, token and word counts."""

    folder: str
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    tokens: int
    words: int
    lower_total: int


def _fold(words: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    out = np.full(len(words), words.shape[1], np.uint64)
    for j in range(words.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, j])
    return out


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(column: np.ndarray) -> bytes:
    """The bytes of whole numbers, all first ones before all second ones."""
    return column.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T.copy().view(kind).reshape(-1)


def _pack(words: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of word hashes, sorted by the first, with counts; the other words are places in the list of distinct ones."""
    known, places = np.unique(words[:, 1:], return_inverse=True)
    places = places.reshape(len(words), words.shape[1] - 1).astype(np.uint32)
    columns = [_planes(np.diff(words[:, 0], prepend=np.uint64(0))), _planes(np.diff(known, prepend=np.uint64(0)))]
    columns += [_planes(np.ascontiguousarray(places[:, j])) for j in range(places.shape[1])]
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    head = np.array([len(words), words.shape[1], kind.itemsize, len(known)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(columns) + counts.astype(kind).tobytes())


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n, width, size, distinct = np.frombuffer(data, np.int64, 4).tolist()
    words = np.empty((n, width), np.uint64)
    words[:, 0] = np.cumsum(_from_planes(data, np.uint64, n, 32))
    known = np.cumsum(_from_planes(data, np.uint64, distinct, 32 + 8 * n), dtype=np.uint64)
    at = 32 + 8 * n + 8 * distinct
    for j in range(1, width):
        words[:, j] = known[_from_planes(data, np.uint32, n, at)]
        at += 4 * n
    return words, np.frombuffer(data, np.dtype(f"u{size}"), n, at).astype(np.int64)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the order that sorts ``keys``, and where in it each distinct one begins, with the end."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(keys)]), len(keys))


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from edge to edge."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[edges])


def _merged(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows with summed counts, sorted by the first word."""
    order, edges = _ranked(_fold(words) if words.shape[1] > 1 else words[:, 0])
    words, sums = words[order[edges[:-1]]], _sums(counts[order], edges)
    if words.shape[1] == 1:
        return words, sums
    order = np.argsort(words[:, 0])
    return words[order], sums[order]


def _dealt(level: int, words: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows, sorted by the first word, by the shard of their context; single words by their own."""
    shard = _shard(_fold(words[:, :-1]) if words.shape[1] > 1 else words[:, 0], shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            yield level, i, _pack(words[order[a:b]], counts[order[a:b]])


def _table(rows: list[tuple], stats: tuple[int, ...] = (0,) * 6) -> pa.Table:
    """Output rows; the statistics stand in a row of their own without a payload."""
    rows = [(*r, *(0,) * 6) for r in rows] + ([(*rows[0][:2], None, *stats)] if any(stats) and rows else [])
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 6]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _padded(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, firsts, sizes): word hashes of all texts with their marks, where the n-gram of each token begins, tokens of each text."""
    texts = [x or b"" for x in texts]
    joined = b"\n".join([*texts, b""]).lower()
    starts, ends = word_places(np.frombuffer(joined, np.uint8))
    offsets = np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in texts]]))
    sizes, text = np.diff(offsets) + 1, np.arange(len(texts))
    words = np.full(len(starts) + order * len(texts), START, np.uint64)
    words[np.arange(len(starts)) + np.repeat(text, sizes - 1) * order + order - 1] = hashed_words(joined, starts, ends)
    words[offsets[1:] + order * (text + 1) - 1] = END
    return words, np.arange(sizes.sum()) + np.repeat(text, sizes) * (order - 1), sizes


def _sequences(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, sizes): the n-grams of all texts, one row a token, and the number of tokens of each text."""
    words, firsts, sizes = _padded(texts, order)
    return np.lib.stride_tricks.sliding_window_view(words, order)[firsts], sizes


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text with A-Z lower-cased."""
    return _sequences([text], 1)[0][:-1, 0]


def _tallied(words: np.ndarray, firsts: np.ndarray, order: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Distinct last words and distinct n-grams, each with counts and sorted by the first word."""
    known, places = np.unique(words, return_inverse=True)
    last = np.bincount(places[firsts + order - 1], minlength=len(known))
    single = known[last > 0][:, None], last[last > 0]
    if len(known) ** order >= 1 << 63:  # a place in the order of all n-grams is no 64-bit number
        grams = np.lib.stride_tricks.sliding_window_view(words, order)[firsts]
        return single, _merged(grams, np.ones(len(grams), np.int64))
    codes = places[firsts]
    for j in range(1, order):
        codes = codes * len(known) + places[firsts + j]
    codes, counts = np.unique(codes, return_counts=True)
    grams = np.empty((len(codes), order), np.uint64)
    for j in range(order - 1, -1, -1):
        codes, at = np.divmod(codes, len(known))
        grams[:, j] = known[at]
    return single, (grams, counts)


def _count(order: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            begins = np.cumsum([0, *[len(w) for w, _ in held[:-1]]])
            single, grams = _tallied(np.concatenate([w for w, _ in held]), np.concatenate([f + b for (_, f), b in zip(held, begins)]), order)
            rows = [*_dealt(1, *single, shards)]
            if order > 1:
                rows += _dealt(order, *grams, shards)
            yield from _table(rows).to_batches()

        for batch in batches:
            for part in chunks(batch, "text"):
                held.append(_padded(part.column("text").to_pylist(), order)[:2])
                size += len(held[-1][1])
                if size > 4_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _save(folder: str, name: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    put_file(f"{folder}/{name}.npy", [data.getbuffer()])


def _save_keys(folder: str, name: str, keys: np.ndarray) -> None:
    """Sorted hashes without their two leading bytes, and where the hashes of each pair of leading bytes begin."""
    _save(folder, f"{name}-begins", np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.uint32))
    _save(folder, f"{name}-middle", (keys >> np.uint64(32)).astype(np.uint16))
    _save(folder, f"{name}-low", keys.astype(np.uint32))


def _save_coded(folder: str, name: str, columns: list[np.ndarray]) -> None:
    """A byte a row: the place of its values among the most frequent ones, or RARE; those stand in a second array, with their row numbers."""
    rows = np.column_stack(columns).astype(np.int64)
    small = np.flatnonzero(rows.max(axis=1, initial=0) < 256)
    packed = rows[small] @ (256 ** np.arange(rows.shape[1]))
    values, places, counts = np.unique(packed, return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")[:RARE]
    code_of = np.full(len(values), RARE, np.uint8)
    code_of[often] = np.arange(len(often))
    codes = np.full(len(rows), RARE, np.uint8)
    codes[small] = code_of[places]
    table = np.zeros((RARE, rows.shape[1] + 1), np.int64)
    table[: len(often), 1:] = values[often][:, None] >> (8 * np.arange(rows.shape[1])) & 255
    rare = np.flatnonzero(codes == RARE)
    _save(folder, f"{name}-codes", codes)
    _save(folder, f"{name}-values", _small(np.concatenate([table, np.column_stack([rare, rows[rare]])])))


def _small(array: np.ndarray) -> np.ndarray:
    return array.astype(np.min_scalar_type(int(array.max()) if len(array) else 0))


def _spread(counts: np.ndarray) -> tuple[int, ...]:
    return tuple(int((counts == k).sum()) for k in (1, 2, 3, 4)) + (int(counts.sum()), len(counts))


def _merge_level(level: int, shards: int, folder: str):
    """Merge one shard of an order, write its arrays, hand the next lower order's rows on."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        own, shard = key[0].as_py(), key[1].as_py()
        parts = [_unpack(p) for p in group.column("payload").to_pylist() if p is not None]
        words, counts = np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts])
        del parts
        if own != level:  # counts of single words, on their way to the last step
            return _table([(own, shard, _pack(*_merged(words, counts)))])
        # a gram is known by the hash of its context and its last word
        contexts = _fold(words[:, :-1])
        grams = mix(contexts + mix(words[:, -1]))
        order, edges = _ranked(grams)
        counts, first = _sums(counts[order], edges), order[edges[:-1]]
        _save_keys(folder, f"grams-{level}-{shard}", grams[first])
        _save_coded(folder, f"counts-{level}-{shard}", [counts])
        words, contexts = words[first], contexts[first]
        del grams, order, first
        order, edges = _ranked(contexts)
        _save_keys(folder, f"contexts-{level}-{shard}", contexts[order[edges[:-1]]])
        own_counts = counts[order]
        _save_coded(folder, f"totals-{level}-{shard}", [_sums(x, edges) for x in (own_counts, own_counts == 1, own_counts == 2, own_counts > 2)])
        lower, ones = _merged(words[:, 1:], np.ones(len(words), np.int64))
        # level 1 already has raw counts; those of distinct neighbours go by 0
        return _table([*_dealt(level - 1 if level > 2 else 0, lower, ones, shards)], _spread(counts))

    return run


def _merge_words(folder: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        sides = {}
        for level in (0, 1):
            parts = [_unpack(p) for p, l in zip(group.column("payload").to_pylist(), group.column("level").to_pylist()) if p is not None and l == level]
            if parts:
                sides[level] = _merged(np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts]))
        words, raw = sides[1]
        lower = np.zeros(len(words), np.int64)
        if 0 in sides:
            lower[np.searchsorted(words[:, 0], sides[0][0][:, 0])] = sides[0][1]
        else:
            lower = raw
        _save_keys(folder, f"words-{shard}", words[:, 0])
        _save_coded(folder, f"seen-{shard}", [raw, lower])
        _save(folder, f"lower-{shard}", np.bincount(np.minimum(lower, 3), minlength=4))
        counted = _spread(lower)
        return _table([(1, shard, None)], (*counted[:5], len(words))).append_column("tokens", pa.array([0, int(raw.sum())], pa.int64()))

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; one half where the counts of counts give none."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


def train(texts: DataFrame, order: int = 2) -> Model:
    """Count a model of ``order`` on column ``text``; null and empty texts are one end mark.

    The arrays are written to the shared folder and stay there.  An empty table
    gives a model that knows no word.
    """
    spark = texts.sparkSession
    folder = make_folder(spark, shared_path(spark, "kneser-ney"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(order, shards), ROWS)
    discounts = []
    for level in range(order, 1, -1):
        rows = checkpoint(rows.groupBy("level", "shard").applyInArrow(_merge_level(level, shards, folder), ROWS))
        seen = rows.filter(F.col("payload").isNull()).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        discounts.append(_discounts(*(x or 0 for x in seen)))
        rows = rows.filter(F.col("payload").isNotNull())
        release(spark)
    done = checkpoint(rows.groupBy("shard").applyInArrow(_merge_words(folder), f"{ROWS}, tokens long"))
    seen = done.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "kinds", "tokens")]).first()
    n1, n2, n3, n4, total, kinds, tokens = (x or 0 for x in seen)
    discounts.append(_discounts(n1, n2, n3, n4))
    del rows, done
    release(spark)
    return Model(folder, order, shards, tuple(reversed(discounts)), tokens, kinds, total)


@lru_cache(maxsize=1 << 15)
def _mapped(uri: str) -> np.ndarray:
    """The array at ``uri`` as a memory map; empty where there is none."""
    from pyarrow.fs import FileType, LocalFileSystem

    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == FileType.NotFound:
        return np.empty(0, np.uint64)
    if isinstance(fs, LocalFileSystem):
        return np.load(path, mmap_mode="r").view(np.ndarray)
    # a store without local paths: the map outlives the name of its copy
    with tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as copy, fs.open_input_stream(path) as data:
        while block := data.read(8 << 20):
            copy.write(block)
    try:
        return np.load(copy.name, mmap_mode="r").view(np.ndarray)
    finally:
        os.unlink(copy.name)


def _places(folder: str, name: str, keys: np.ndarray) -> np.ndarray:
    """Place of each of ``keys`` among the hashes that ``_save_keys`` has written, or -1."""
    begins, middle, low = (_mapped(f"{folder}/{name}-{part}.npy") for part in ("begins", "middle", "low"))
    if not len(low):
        return np.full(len(keys), -1)
    at = lambda i: (middle[i].astype(np.uint64) << np.uint64(32)) | low[i]
    head, rest = (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1)
    least, end = begins[head].astype(np.int64), begins[head + 1].astype(np.int64)
    most = end
    for _ in range(int((most - least).max(initial=0)).bit_length()):
        half = (least + most) >> 1
        less = (least < most) & (at(np.minimum(half, len(low) - 1)) < rest)
        least, most = np.where(less, half + 1, least), np.where(less, most, np.minimum(half, most))
    return np.where((least < end) & (at(np.minimum(least, len(low) - 1)) == rest), least, -1)


def _coded(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """Rows of values at places ``at`` that ``_save_coded`` has written."""
    codes, values = (_mapped(f"{folder}/{name}-{part}.npy") for part in ("codes", "values"))
    row = codes[at].astype(np.int64)
    rare = np.flatnonzero(row == RARE)
    row[rare] += np.searchsorted(values[RARE:, 0], at[rare])
    return values[row, 1:].astype(np.int64)


def _look_up(folder: str, shards: int, of_shard: np.ndarray, keys: np.ndarray, index: str, values: str, width: int) -> list[np.ndarray]:
    """The ``width`` values of ``keys`` from the arrays of their shards; 0 where a key is unknown.  Keys are sorted within shards."""
    out = np.zeros((len(keys), width), np.int64)
    edges = np.searchsorted(of_shard, np.arange(shards + 1))
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b > a:
            at = _places(folder, f"{index}-{i}", keys[a:b])
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                out[a + hit] = _coded(folder, f"{values}-{i}", at[hit])
    return list(out.T)


def _by_shard(shard_key: np.ndarray, key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, key, inverse) of the distinct keys, sorted by shard and key."""
    ranks, edges = _ranked(key)
    inverse = np.empty(len(key), np.int64)
    inverse[ranks] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    first = ranks[edges[:-1]]
    shard = _shard(shard_key[first], shards)
    order = np.argsort(shard, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return shard[order], key[first][order], back[inverse]


def token_scores(model: Model, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, training count) of the last word of each row of ``grams``."""
    last = grams[:, -1]
    shard, keys, back = _by_shard(last, last, model.shards)
    raw, lower = (x[back] for x in _look_up(model.folder, model.shards, shard, keys, "words", "seen", 2))
    d = model.discounts[0]
    taken = np.array([0.0, *d])
    spread = _unigram_spread(model)
    p = (lower - taken[np.minimum(lower, 3)]) / max(model.lower_total, 1) + spread / (model.words + 1)
    for level in range(2, model.order + 1):
        rows = grams[:, -level:]
        context = _fold(rows[:, :-1])
        taken = np.array([0.0, *model.discounts[level - 1]])
        shard, keys, back = _by_shard(context, context, model.shards)
        total, n1, n2, n3 = _look_up(model.folder, model.shards, shard, keys, f"contexts-{level}", f"totals-{level}", 4)
        some = np.maximum(total, 1)
        left = np.where(total > 0, (taken[1] * n1 + taken[2] * n2 + taken[3] * n3) / some, 1.0)[back]
        some = some[back]
        gram = mix(context + mix(last))
        shard, keys, back = _by_shard(context, gram, model.shards)
        count = _look_up(model.folder, model.shards, shard, keys, f"grams-{level}", f"counts-{level}", 1)[0][back]
        p = (count - taken[np.minimum(count, 3)]) / some + left * p
    return p, raw


@lru_cache(maxsize=8)
def _unigram_spread(model: Model) -> float:
    """The share that the discounts leave to all words, known or not."""
    if not model.lower_total:
        return 1.0
    n = np.zeros(4)
    for i in range(model.shards):
        lower = _mapped(f"{model.folder}/lower-{i}.npy")
        n[: len(lower)] += lower
    return float(n[1:] @ np.array(model.discounts[0]) / model.lower_total)


def _scorer(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.5 * (model.words + 1)
        for batch in batches:
            for part in chunks(batch, text):
                grams, sizes = _sequences(part.column(text).to_pylist(), model.order)
                p, raw = token_scores(model, grams)
                edges = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, edges) for x in ((raw > 0).astype(np.int64), np.log10((raw + 0.5) / floor), np.log10(p))]
                rest = [i for i, c in enumerate(part.schema.names) if c != text]
                columns = [*[part.column(i) for i in rest], pa.array(sizes), *[pa.array(s) for s in sums]]
                yield pa.RecordBatch.from_arrays(columns, [*[part.schema.names[i] for i in rest], "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score, score and perplexity of the whole ``text``.

    ``score``: log10 probability of the words and the end mark; ``base_score``: the
    same by single words with one half added to every count.

    Defined cases: null and empty texts are one end mark; words that training has
    not seen get the unknown word's share; repeated rows score alike; an empty
    table gives an empty one; columns named as the result's are replaced.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, "perplexity")])
    schema = rest.withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    work = fresh(rest, "__text")
    out = rest.withColumn(work, F.col(f"`{text}`").cast("binary")).mapInArrow(_scorer(model, work), schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
