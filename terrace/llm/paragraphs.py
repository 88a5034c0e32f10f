"""Repeated and nearly repeated paragraphs across documents, by MinHash banding.

Two kinds of paragraphs are cut from every whole text.  *Lines*: what stands between
newlines.  *Stretches*: runs of words between breakpoints that the words themselves
set, so that a passage pasted into the middle of other text is cut the same
way wherever it stands.  Equal paragraphs meet by their hash.  Distinct lines
are banded by MinHash; the number of bands is tuned for recall at the similarity
asked for; lines that collide are verified by the exact Jaccard similarity of their
word shingles; where a bucket is large, candidates come from the rarest shingles of
its lines instead of from all pairs.  Verified links form components; the first occurrence of a
component stays and the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import (
    apart, checkpoint, chunks, hashed_words, keyed_texts, mix, put_back, release, rolling, sieve, small_side, text_key, through, word_places,
)
from terrace.llm.components import connected_components
from terrace.llm.token_groups import class_links, least_set, shared_tokens, verified

#: Words of a paragraph at least, where the caller names no other number.
LEAST_WORDS = 16
#: A breakpoint is a word whose hash is the smallest among this many on either side.
RADIUS = 4
#: Rows of a MinHash band, and the recall the bands are tuned for at the threshold itself.
BAND_ROWS, RECALL = 2, 0.98
#: Lines of a bucket up to which all its pairs are verified; those of larger ones are joined by their rarest shingles.
SMALL_BUCKET = 8


def tuned_bands(percent: int) -> int:
    """Fewest bands that find a pair of similarity ``percent`` with probability RECALL."""
    miss = 1 - (percent / 100) ** BAND_ROWS
    return max(1, int(np.ceil(np.log(1 - RECALL) / np.log(miss)))) if miss > 0 else 1


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def breakpoints(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where stretches may begin or end: local minima of a hash of two words, and both ends of every text.

    ``words`` are those of all texts, one after another; ``offsets`` holds where each text begins, and the end.
    """
    n, sizes = len(words), np.diff(offsets)
    top = np.uint64(2**64 - 1)
    own = np.append(rolling(words, 2), top)[:n]
    own[offsets[1:][sizes > 0] - 1] = top  # no pair runs on into the next text
    # texts stand RADIUS places apart, so that none sees the words of another
    at = np.arange(n) + RADIUS * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    value = np.full(n + RADIUS * (len(sizes) + 1), top, np.uint64)
    value[at] = own
    low = own < top
    for d in range(1, RADIUS + 1):
        low &= (own < value[at - d]) & (own <= value[at + d])
    return np.unique(np.concatenate([offsets, np.flatnonzero(low)]))


def range_minima(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value of each range, by the two runs of a power of two that cover it."""
    out = np.empty(len(first), values.dtype)
    power = np.frexp((end - first).astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=-1)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(values[first[own]], values[end[own] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


class Paragraphs:
    """Lines and stretches of many texts at once, as ranges over all their words."""

    def __init__(self, texts: list[bytes | None], least_words: int):
        texts = [x or b"" for x in texts]
        joined = b"\n".join(texts).lower()
        data = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = word_places(data)
        self.least, self.words = least_words, hashed_words(joined, self.starts, self.ends)
        self.begins = np.cumsum([0, *[len(x) + 1 for x in texts]])
        self.offsets = np.searchsorted(self.starts, self.begins)
        self.points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
        self.breaks = np.flatnonzero(data == 10)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end word) of the lines of enough words."""
        line = np.searchsorted(self.breaks, self.starts)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(first[1:], len(self.starts)) if len(first) else first
        long = last - first >= self.least
        return first[long], last[long]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end word) of the shortest stretches of enough words from every breakpoint."""
        cuts = breakpoints(self.words, self.offsets)
        own_end = self.offsets[np.searchsorted(self.offsets, cuts, "right").clip(max=len(self.offsets) - 1)]
        whole = cuts + self.least <= own_end
        return cuts[whole], cuts[np.searchsorted(cuts, cuts[whole] + self.least)]

    def owners(self, first: np.ndarray) -> np.ndarray:
        """Which text each first word belongs to."""
        return np.searchsorted(self.offsets, first, "right") - 1

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in code points of the text."""
        base = self.points[self.begins[self.owners(first)]]
        return self.points[self.starts[first]] - base, self.points[self.ends[last - 1]] - base

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        data = self.words.tobytes()
        units = [xxhash.xxh3_64_intdigest(data[8 * x : 8 * y]) for x, y in zip(first.tolist(), last.tolist())]
        return np.array(units, np.uint64).view(np.int64)

    def band_keys(self, first: np.ndarray, last: np.ndarray, bands: int, width: int) -> np.ndarray:
        """A row of band keys for each paragraph; one hash function at a time, to hold little."""
        factor, shift = _multipliers(bands * BAND_ROWS)
        shingles = rolling(self.words, width)
        shingles = np.append(shingles, shingles[-1:])
        keys = np.empty((len(first), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(first), b, np.uint64)
            for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                key = mix(key + range_minima(shingles * factor[r] + shift[r], first, last - width + 1))
            keys[:, b] = key
        return keys.view(np.int64)


def _lines(bands: int, width: int, least_words: int):
    """The hash and the band keys of each line, of equal lines of a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                cut = Paragraphs(part.column("text").to_pylist(), least_words)
                a, b = cut.lines()
                if len(a):
                    units, first = np.unique(cut.hashes(a, b), return_index=True)
                    a, b = a[first], b[first]
                    flat = cut.band_keys(a, b, bands, width).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(units), lists], ["unit", "bands"])

    return run


def _units(least_words: int, wanted):
    """A row for each line and each stretch that passes the sieve ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                cut = Paragraphs(part.column("text").to_pylist(), least_words)
                a, b = map(np.concatenate, zip(cut.lines(), cut.stretches()))
                passes = through(cut.hashes(a, b), wanted.value)
                a, b = a[passes], b[passes]
                if len(a):
                    yield pa.RecordBatch.from_arrays(_rows(part, cut, a, b), _NAMES)

    return run


def _unit_hashes(least_words: int):
    """The hash alone of each line and each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                cut = Paragraphs(part.column("text").to_pylist(), least_words)
                a, b = map(np.concatenate, zip(cut.lines(), cut.stretches()))
                yield pa.RecordBatch.from_arrays([pa.array(cut.hashes(a, b))], ["unit"])

    return run


_NAMES = ["doc_id", "text_key", "unit", "start", "end", "n_words"]


def _rows(part: pa.RecordBatch, cut: Paragraphs, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    take = pa.array(cut.owners(a))
    columns = [cut.hashes(a, b), *cut.places(a, b), b - a]
    return [part.column("doc_id").take(take), part.column("text_key").take(take), *[pa.array(c, pa.int64()) for c in columns]]


ROWS = "doc_id long, text_key long, unit long, start long, end long, n_words long"


def _line_sets(width: int, least_words: int, wanted):
    """The shingles of the lines that pass the sieve ``wanted``, of equal lines of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for part in chunks(batch, "text"):
                cut = Paragraphs(part.column("text").to_pylist(), least_words)
                a, b = cut.lines()
                units = cut.hashes(a, b)
                some = np.flatnonzero(through(units, wanted.value))
                units, first = np.unique(units[some], return_index=True)
                new = [(u, i) for u, i in zip(units.tolist(), some[first].tolist()) if u not in seen]
                seen.update(u for u, _ in new)
                data = [np.unique(rolling(cut.words[a[i] : b[i]], width)).tobytes() for _, i in new]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in new], pa.int64()), pa.array(data, pa.binary())], ["cls", "data"])

    return run


def line_links(keyed: DataFrame, width: int, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """Verified links (a, b) between distinct lines of ``keyed`` (doc_id, text_key, text)."""
    bands = tuned_bands(percent)
    lines = keyed.select("text").mapInArrow(_lines(bands, width, least_words), "unit long, bands array<long>")
    lines = checkpoint(lines.groupBy("unit").agg(F.first("bands").alias("bands")))
    banded = lines.select("unit", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = checkpoint(banded.join(shared.select("band"), "band"))
    # equal lines have equal words, so any of them gives the shingles; texts are not shuffled for it
    wanted = checkpoint(open_.select(F.col("unit").alias("cls")).distinct())
    passing = keyed.sparkSession.sparkContext.broadcast(sieve(wanted))
    sets = keyed.select("text").mapInArrow(_line_sets(width, least_words, passing), "cls long, data binary")
    sets = checkpoint(sets.join(small_side(wanted), "cls", "left_semi").groupBy("cls").agg(F.first("data").alias("data")))
    release(keyed.sparkSession)
    sizes = open_.groupBy("band").agg(F.count("*").alias("lines"))
    here = open_.join(sizes, "band")
    small = here.filter(F.col("lines") <= SMALL_BUCKET).select("band", "unit")
    pairs = small.select("band", F.col("unit").alias("a")).join(small.select("band", F.col("unit").alias("b")), "band").filter("a > b")
    near = checkpoint(verified(pairs.select("a", "b").distinct(), sets, percent))
    release(keyed.sparkSession)
    large = here.filter(F.col("lines") > SMALL_BUCKET).select(F.col("unit").alias("cls")).distinct()
    return near.unionByName(_links_of_large_buckets(sets.join(large, "cls"), percent))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("data").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        if len(sets):
            owner = pa.array(np.repeat(np.arange(len(sets)), sizes))
            columns = [pa.array(np.concatenate(sets)), batch.column("cls").take(owner), pa.array(np.repeat(sizes, sizes).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "cls", "n"])


def _links_of_large_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """Links between the lines of large buckets, found exactly by their rarest shingles instead of by pairs.

    Lines with equal shingle sets, such as few words repeated to different lengths,
    are linked to the smallest of them, which alone is compared with others.
    """
    keyed = checkpoint(sets.withColumn("same", F.xxhash64("data")))
    first = small_side(keyed.groupBy("same").agg(F.min("cls").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    equal = checkpoint(keyed.join(first, "same").filter("cls <> b").select(F.col("cls").alias("a"), "b"))
    sets = checkpoint(keyed.drop("same").join(equal.select(F.col("a").alias("cls")), "cls", "left_anti"))
    tokens = sets.mapInArrow(_tokens, "token long, cls long, n int")
    spread = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = tokens.join(spread, "token", "left").withColumn(
        "at", F.row_number().over(Window.partitionBy("cls").orderBy(F.coalesce("df", F.lit(1)), "token"))
    )
    common = shared_tokens(percent)
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + common
    postings = ranked.filter((F.col("at") <= length) & (F.col("n") >= least_set(percent)) & F.col("df").isNotNull()).select("token", "cls", "n")
    postings = checkpoint(postings)
    enough = postings.groupBy("cls").agg(F.count("*").alias("c")).filter(F.col("c") >= common).select("cls")
    links = class_links(checkpoint(postings.join(enough, "cls")), lambda classes: checkpoint(sets.join(classes, "cls")), percent)
    return links.select("a", "b").unionByName(equal)


def repeated_paragraphs(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, component, start, end, n_words, removed, keeper_doc_id) of paragraphs that occur again.

    A paragraph of ``least_words`` words or more (``width`` at least) occurs again when an equal one, or a line whose
    ``width``-word shingles have a Jaccard similarity of ``percent`` or more, stands
    elsewhere.  Of a component the occurrence with the smallest (doc_id, start) stays;
    ``removed`` marks the others.  Places are code points, end exclusive.

    Defined cases: null and empty texts have no paragraphs; a null doc_id comes
    after all others; rows equal in id and text count as one document; an
    empty table gives an empty result; further columns are ignored.
    """
    if least_words < width:
        raise ValueError("a paragraph needs as many words as a shingle")
    keyed = keyed_texts(docs)
    roots = checkpoint(connected_components(line_links(keyed, width, percent, least_words)))
    release(docs.sparkSession)
    again = keyed.select("text").mapInArrow(_unit_hashes(least_words), "unit long").groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1").select("unit")
    linked = roots.select(F.col("node").alias("unit"), "root")
    wanted = again.join(linked, "unit", "full").select("unit", F.coalesce("root", "unit").alias("component"))
    wanted = checkpoint(wanted)
    release(docs.sparkSession)
    passing = keyed.sparkSession.sparkContext.broadcast(sieve(wanted.select("unit")))
    units = keyed.mapInArrow(_units(least_words, passing), ROWS)
    rows = checkpoint(units.join(small_side(wanted), "unit").drop("unit").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "start", "end")
    keepers = rows.groupBy("component").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(keepers, "component").select(
        "doc_id", "text_key", "component", "start", "end", "n_words", (place != F.col("keeper")).alias("removed"), F.col("keeper.doc_id").alias("keeper_doc_id")
    )


def repeated_passages(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """Overlapping and touching paragraphs of ``repeated_paragraphs`` joined to passages, one row each.

    (doc_id, text_key, removed, start, end, paragraphs, keeper_doc_id); a document's
    kept and removed passages are apart, and ``keeper_doc_id`` is the smallest of a passage.
    """
    rows = repeated_paragraphs(docs, width, percent, least_words)
    own = Window.partitionBy("doc_id", "text_key", "removed").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.withColumn("new", F.when(F.col("start") <= F.coalesce(reach, F.lit(-1)) + 1, 0).otherwise(1))
    numbered = begun.withColumn("passage", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "text_key", "removed", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("paragraphs"), F.min("keeper_doc_id").alias("keeper_doc_id")
    ).drop("passage")


def without_repeats(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with removed passages cut out of their texts; n_chars, where it exists, is counted anew."""
    spans = repeated_passages(docs, width, percent, least_words).filter("removed").groupBy("doc_id", "text_key")
    spans = spans.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__spans")
    same = (text_key(F.col("text")) == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    joined = apart(docs, ("doc_id", "text", "n_chars")).join(spans, same, "left")
    text, start = F.col("text"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    cut = F.aggregate("__spans", start, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out")),
                      lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("long"))))
    joined = joined.withColumn("__text", F.when(F.col("__spans").isNull(), text).otherwise(cut))
    if "n_chars" in docs.columns:
        length = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("__text"))
        joined = joined.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return put_back(joined.withColumn("text", F.col("__text")), docs)
