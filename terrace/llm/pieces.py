"""SentencePiece encoding and decoding of BPE models, with seeded merge-dropout.

A text is cut into units at spaces: no piece has a space mark after another
character, so merges never cross a unit's start.  Inside a unit an agenda holds
the candidate merges; the best piece score goes first, leftmost on ties.  With
dropout each candidate is skipped when a keyed hash of it falls below the rate, so
the same seed gives the same segmentation on every run and another seed another
one.  Whatever is skipped, the pieces spell the text: decoding is lossless.

The agendas of all units of a slice of texts advance together, one merge a round,
as array operations; units longer than the widest table have a heap of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import chunks, fresh, mix

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Widths of the tables that hold units of about one length.
WIDTHS = (4, 8, 12, 16, 24, 40)
NONE = np.int32(2**31 - 1)
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1


class PieceModel:
    """Vocabulary of a model file: merges (left id, right id) -> rank, characters -> id, ids of the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    ids[piece] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces; unknown characters would be lost")
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in ids):
            raise ValueError("pieces reach across spaces or lines; units can't be cut there")
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        # the agenda's order: the score, then the id, so that a rank names its piece
        self.id_of_rank = np.lexsort((np.arange(self.size), -scores)).astype(np.int32)
        rank = np.empty(self.size, np.int32)
        rank[self.id_of_rank] = np.arange(self.size, dtype=np.int32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        merges = {}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * self.size + right] = int(rank[i])
        self.merges = merges
        self.bits = max(12, (len(merges) * 4).bit_length())
        self._fill(merges)

    def _fill(self, merges: dict[int, int]) -> None:
        """Open-addressed table of the merges, so that arrays of pairs can be looked up."""
        slots = 1 << self.bits
        self.keys = np.full(slots, -1, np.int64)
        self.ranks = np.full(slots, NONE, np.int32)
        keys = np.fromiter(merges, np.int64, len(merges))
        for k, at in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & (slots - 1)
            self.keys[at] = k
            self.ranks[at] = merges[k]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_SEEDS[0])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; NONE where there is no merge."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        wrong = np.flatnonzero(~hit & (seen >= 0) & (keys >= 0))
        out = np.where(hit, self.ranks[at], NONE)
        place, at, keys = wrong, at[wrong], keys[wrong]
        while len(place):
            at = (at + 1) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == keys
            out[place[hit]] = self.ranks[at[hit]]
            on = ~hit & (seen >= 0)
            place, at, keys = place[on], at[on], keys[on]
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()])
        return text[1:].decode() if text else ""


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Whether the keyed hash of each candidate, named by its place in its unit, falls below the rate."""
    x = key + start.astype(np.uint64) * np.uint64(_SEEDS[0]) + middle.astype(np.uint64) * np.uint64(_SEEDS[1]) + end.astype(np.uint64) * np.uint64(_SEEDS[2])
    return mix(x) < np.uint64(limit)


def _advance(model: PieceModel, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """Merge the rows of ``symbols`` (-1 - code point for unknown ones) to their ends; merged-away cells become NONE."""
    n, width = symbols.shape
    flat = symbols.reshape(-1)
    column = np.arange(width)
    after = np.broadcast_to(column + 1, (n, width)).astype(np.int16).reshape(-1)
    before = np.broadcast_to(column - 1, (n, width)).astype(np.int16).reshape(-1)
    right = np.concatenate([symbols[:, 1:], np.full((n, 1), -1, np.int32)], axis=1)
    flat_rank = model.candidates(flat, right.reshape(-1))
    rank = flat_rank.reshape(n, width)
    rank[column[None, :] + 1 >= sizes[:, None]] = NONE
    rows = np.flatnonzero((rank != NONE).any(axis=1))
    while len(rows):
        table = rank[rows]
        at = table.argmin(axis=1)
        open_ = table[np.arange(len(rows)), at] != NONE
        rows, at = rows[open_], at[open_]
        base = rows * width
        here = base + at
        second = after[here].astype(np.int64)
        end = after[base + second].astype(np.int64)
        if limit:
            drop = _skipped(keys[rows], at, second, end, limit)
            flat_rank[here[drop]] = NONE
            go = ~drop
            base, here, at, second, end, whole = base[go], here[go], at[go], second[go], end[go], sizes[rows[go]]
        else:
            whole = sizes[rows]
        flat[here] = model.id_of_rank[flat_rank[here]]
        flat[base + second] = NONE
        flat_rank[base + second] = NONE
        after[here] = end
        inner = end < whole
        before[(base + end)[inner]] = at[inner]
        left = before[here].astype(np.int64)
        has_left = left >= 0
        # new candidates: (merged, what follows) and (what precedes, merged)
        next_symbol = np.where(inner, flat[np.where(inner, base + end, 0)], -1)
        flat_rank[here] = model.candidates(flat[here], next_symbol)
        prior = (base + left)[has_left]
        flat_rank[prior] = model.candidates(flat[prior], flat[here[has_left]])
    return symbols


def _long_unit(model: PieceModel, symbols: list[int], key: int, limit: int) -> list[int]:
    """The same agenda for one long unit, as a heap."""
    n = len(symbols)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    agenda: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := model.merges.get(symbols[i] * model.size + symbols[j])) is not None:
            heapq.heappush(agenda, (found, i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        rank, i, left, right = heapq.heappop(agenda)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        end = after[j]
        if limit:
            x = (key + i * _SEEDS[0] + j * _SEEDS[1] + end * _SEEDS[2]) & _MASK
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
            if x ^ (x >> 31) < limit:
                continue
        symbols[i], symbols[j], after[i] = int(model.id_of_rank[rank]), int(NONE), end
        if end < n:
            before[end] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return symbols


def encode_texts(model: PieceModel, texts: list[str | None], row_keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edges): the piece ids of all texts in a row and where each text's begin and end."""
    limit = min(int(rate * (1 << 64)), _MASK)
    spaced = [" " + t if t else "" for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in spaced], np.int64)
    ends = np.cumsum(lengths)
    if len(points) == 0:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space, alone = points == 32, (points == 10) | (points == ord(MARK))
    symbols = model.char_ids[points]
    symbols[space] = model.char_ids[ord(MARK)]
    unknown = ((symbols < 0) | alone) & ~space
    symbols[unknown] = -1 - points[unknown].astype(np.int32)
    first = alone | space
    first[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
    first[(ends - lengths)[lengths > 0]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(points)))
    text_of = np.searchsorted(ends, starts, side="right")
    ordinal = np.arange(len(starts)) - np.searchsorted(starts, (ends - lengths)[text_of])
    keys = mix(row_keys[text_of] + mix(ordinal.astype(np.uint64)))
    done = symbols.copy()
    low = 1
    for width in WIDTHS:
        chosen = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if len(chosen):
            cells = starts[chosen][:, None] + np.arange(width)
            inside = np.arange(width)[None, :] < sizes[chosen][:, None]
            table = np.where(inside, symbols[np.minimum(cells, len(points) - 1)], np.int32(-1))
            merged = _advance(model, table, sizes[chosen], keys[chosen], limit)
            done[cells[inside]] = merged[inside]
    for u in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
        part = slice(int(starts[u]), int(starts[u] + sizes[u]))
        done[part] = _long_unit(model, symbols[part].tolist(), int(keys[u]), limit)
    left = done != NONE
    flat, owner = done[left], np.searchsorted(ends, np.flatnonzero(left), side="right")
    flat, owner = _with_bytes(model, flat, owner)
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def _with_bytes(model: PieceModel, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters as the pieces of their UTF-8 bytes."""
    odd = flat < 0
    points, place = np.unique(-1 - flat[odd].astype(np.int64), return_inverse=True)
    if len(points) == 0:
        return flat, owner
    coded = [chr(p).encode() for p in points.tolist()]
    widths = np.ones(len(flat), np.int64)
    widths[odd] = np.array([len(c) for c in coded])[place]
    out, at = np.repeat(flat, widths), np.cumsum(widths) - widths
    table = np.array([[*c, *[0] * (4 - len(c))] for c in coded])
    for j in range(4):
        more = widths[odd] > j
        out[at[odd][more] + j] = model.byte_ids[table[place[more], j]]
    return out, np.repeat(owner, widths)


def _encoder(path: str, rate: float, name: str, text: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for part in chunks(batch, text, 1 << 20):
                keys = part.column(key).to_numpy(zero_copy_only=False).view(np.uint64)
                ids, edges = encode_texts(model, part.column(text).to_pylist(), keys, rate)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()), mask=part.column(text).is_null())
                rest = [i for i, c in enumerate(part.schema.names) if c not in (text, key)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], lists], [*[part.schema.names[i] for i in rest], name])

    return run


def encode(docs: DataFrame, model_path: str, dropout: float = 0.0, seed: int = 0, text: str = "text", ids: str = "piece_ids", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``: array<int> of the pieces of the whole ``text``.

    ``dropout``: the share of candidate merges that are skipped, each by a hash of
    (seed, doc_id if there is one, text, the unit's place, the candidate's place).
    0 gives the plain segmentation.

    Defined cases: null text gives null, empty text no pieces; characters
    outside the vocabulary, and the space mark itself, become byte pieces; rows equal in id
    and text get equal ids; an empty table gives an empty one; a column named as
    the result is replaced.  ``carry``: the columns to hand on, by default all.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must lie in [0, 1)")
    keep = [c for c in (carry if carry is not None else docs.columns) if c != ids]
    own = [F.col("doc_id").cast("string")] if "doc_id" in docs.columns else []
    key = F.xxhash64(F.lit(seed), *own, F.col(f"`{text}`"))
    work = fresh(docs, "__text"), fresh(docs, "__key")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(work[0]), key.alias(work[1]))
    schema = source.select(*[F.col(f"`{c}`") for c in keep]).withColumn(ids, F.lit(None).cast("array<int>")).schema
    return source.mapInArrow(_encoder(model_path, float(dropout), ids, *work), schema)


def _decoder(path: str, ids: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            column = batch.column(ids)
            values, edges = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            texts = [model.decode(values[a:b]) if ok else None for a, b, ok in zip(edges[:-1], edges[1:], column.is_valid().to_pylist())]
            rest = [i for i, c in enumerate(batch.schema.names) if c != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(texts, pa.string())], [*[batch.schema.names[i] for i in rest], name])

    return run


def decode(encoded: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with ``text``: what the pieces spell.  Null gives null, no pieces the empty text; a column named as the result is replaced."""
    rest = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != text])
    schema = rest.withColumn(text, F.lit(None).cast("string")).schema
    return rest.mapInArrow(_decoder(model_path, ids, text), schema)
