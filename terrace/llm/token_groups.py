"""N-gram Jaccard join by a token-group matrix.

Similar documents are partitioned into groups; the matrix stores, per token, the
groups whose token union holds it.  A query document's overlap with a group is
bounded through the matrix, and only groups that can hold a partner are opened.

Steps, all of them Spark jobs over whole tables:

1. *Sets.*  Each text becomes its set of distinct word shingles (64-bit hashes).
   Equal sets collapse into one class first, so copies cost one row each.
2. *Signature tokens.*  Two sets that reach the threshold share at least ``k`` of
   their first ``n - ceil(t*n) + k`` tokens in any common order.  The order puts
   the most widespread tokens last, so shared passages rarely meet.
3. *Groups.*  Every token that many classes share names a few of them as leaders, and all
   are compared with those.  Linked classes form groups (connected components); a class that
   links to no leader but may share half of its tokens with one joins that one's group, so that a
   family whose members are too far apart to link is still one group and not thousands.
4. *Matrix.*  (token, group) pairs of the signature tokens, distinct.  For every
   class and every other, larger group: the number of common tokens bounds the
   overlap; fewer than ``k``, or sizes too far apart, closes the group.
5. *Open.*  Members of the groups left are compared exactly, small groups as
   pairs, large ones in blocks against blocks of queries.

Within a group linked members are connected already; only those that joined by
half of their tokens are compared with the others of their own group.
Wherever pairs are compared, bitmaps of the sets travel first; they bound the similarity from above, and the
whole sets travel only for pairs whose bound reaches the threshold.
The result is exact up to 64-bit hash collisions of shingles and of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint, chunks, hashed_words, keyed_texts, release, rolling, small_side, text_key, texts_of, word_places
from terrace.llm.components import connected_components

#: Most tokens in the list of widespread tokens: 8 MB, the bound of what is sent to every task.
WIDESPREAD_TOKENS = 1_000_000
#: Documents a token must occur in to count as widespread.
WIDESPREAD_DOCS = 8
#: Groups up to this size are opened as pairs, larger ones in blocks; tokens of more classes than this name leaders.
SMALL_GROUP = 8
#: Pairs to compare (two longs each) that are sent to every task at most: 16 MB.
SENT_PAIRS = 1 << 20
#: Classes of a widespread token that the others are verified against.
LEADERS = 8
#: Bound of the similarity to a leader, in percent, from which a class that links to none joins its group (about half its tokens).
NEAR_PERCENT = 60
#: Bits of a set's sketch for each of its tokens, at least.
SKETCH_BITS = 4
#: Rows of a block of members or of queries of a large group.
BLOCK = 512
#: Distinct tokens that two blocks are multiplied over at a time: 16 MB of counts at BLOCK rows.
SLICE_TOKENS = 4096


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; the whole sequence where words are fewer."""
    texts = [x or b"" for x in texts]
    joined = b"\n".join(texts).lower()
    starts, ends = word_places(np.frombuffer(joined, np.uint8))
    words = hashed_words(joined, starts, ends)
    shingles = rolling(words, width)
    edges = np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in texts]])).tolist()
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = shingles[a : b - width + 1] if b - a >= width else rolling(words[a:b], b - a) if b > a else words[:0]
        out.append(np.unique(own))
    return out


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def signature_length(n: int, percent: int, common: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + common)


def least_set(percent: int) -> int:
    """Smallest size of a set that can reach the threshold with a different set."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def shared_tokens(percent: int) -> int:
    """Signature tokens that linked sets share at least: up to three, as many as the smallest overlap allows."""
    return min(3, least_set(percent)) if percent < 100 else 1


def _reorder(tokens: np.ndarray, widespread: np.ndarray) -> np.ndarray:
    if len(widespread) == 0 or len(tokens) == 0:
        return tokens
    at = np.minimum(np.searchsorted(widespread, tokens), len(widespread) - 1)
    late = widespread[at] == tokens
    return np.concatenate([tokens[~late], tokens[late]])


def _repeated_tokens(width: int):
    """Tokens that occur in two or more documents of a slice, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in chunks(batch, "text") for s in shingle_sets(part.column("text").to_pylist(), width)]
            tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            del sets
            tokens.sort()
            again = np.flatnonzero(tokens[1:] == tokens[:-1])
            tokens, counts = np.unique(tokens[again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts + 1)], ["token", "n"])

    return run


def widespread_tokens(texts: DataFrame, width: int) -> np.ndarray:
    """The most widespread tokens, sorted, WIDESPREAD_TOKENS at most.

    The list only sets the order of tokens; any list gives the same links.
    """
    counts = texts.mapInArrow(_repeated_tokens(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= WIDESPREAD_DOCS).orderBy(F.desc("n"), "token").limit(WIDESPREAD_TOKENS).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _signatures(width: int, percent: int, widespread):
    common, least = shared_tokens(percent), least_set(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = widespread.value
        for batch in batches:
            for part in chunks(batch, "text"):
                sizes, classes, tokens = [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), width):
                    sizes.append(len(s))
                    classes.append(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                    keep = signature_length(len(s), percent, common) if len(s) >= least else 0
                    tokens.append(_reorder(s, late)[:keep].view(np.int64) if keep else s[:0].view(np.int64))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists],
                    ["doc_id", "text_key", "cls", "n", "tokens"],
                )

    return run


def _class_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(data, pa.binary())], ["cls", "data"])

    return run


def _similar(percent: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, linked = [], []
            for i, (x, y) in enumerate(zip(batch.column("data_a").to_pylist(), batch.column("data_b").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if 100 * both >= floor * union:
                    keep.append(i)
                    linked.append(100 * both >= percent * union)
            near = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield near.append_column("linked", pa.array(linked, pa.bool_()))

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's size and a bitmap of the leading bits of its tokens, a power of two long."""
    for batch in batches:
        data = []
        for x in batch.column("data").to_pylist():
            tokens = np.frombuffer(x, np.uint64)
            width = max(6, (SKETCH_BITS * len(tokens) - 1).bit_length())
            bits = np.zeros(1 << width, bool)
            bits[(tokens >> np.uint64(64 - width)).astype(np.int64)] = True
            data.append(np.int64(len(tokens)).tobytes() + np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(data, pa.binary())], ["cls", "data"])


def most_common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """(size, size, most tokens in common) of two sets by their sketches."""
    sizes = [int(np.frombuffer(z, np.int64, 1)[0]) for z in (x, y)]
    maps = [np.frombuffer(z, np.uint8, offset=8) for z in (x, y)]
    short = min(map(len, maps))
    for i, own in enumerate(maps):
        while len(own) > short:
            own = np.packbits(np.unpackbits(own).reshape(-1, 2).any(axis=1))
        maps[i] = own
    # every bit that the other has not stands for a token at least that the other has not
    lacking = [int(np.bitwise_count(p & ~q).sum()) for p, q in (maps, maps[::-1])]
    return *sizes, min(n - m for n, m in zip(sizes, lacking))


def _bounded(percent: int, floor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, may = [], []
            for i, (x, y) in enumerate(zip(batch.column("data_a").to_pylist(), batch.column("data_b").to_pylist())):
                n, m, both = most_common(x, y)
                if 100 * both >= floor * (n + m - both):
                    keep.append(i)
                    may.append(100 * both >= percent * (n + m - both))
            near = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield near.append_column("may", pa.array(may, pa.bool_()))

    return run


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, data_a, data_b) of the pairs (a, b).

    The pairs go to the sets, by a broadcast up to SENT_PAIRS,
    so that a set is shuffled once for each pair it is the first of, and once if it is a second.
    """
    pairs = checkpoint(pairs)
    few = pairs.count() <= SENT_PAIRS
    sent = F.broadcast if few else lambda table: table
    first = sets.join(sent(pairs), F.col("cls") == F.col("a")).select("a", "b", F.col("data").alias("data_a"))
    second = sets.join(sent(pairs.select("b").distinct()), F.col("cls") == F.col("b"), "left_semi")
    return first.join(second.select(F.col("cls").alias("b"), F.col("data").alias("data_b")), "b").select("a", "b", "data_a", "data_b")


def compared(pairs: DataFrame, sets: DataFrame, percent: int, floor: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b) whose exact similarity reaches ``floor``; ``linked`` where it reaches ``percent``.

    ``sets`` (cls, data) is checkpointed.
    """
    return _paired(pairs, sets).mapInArrow(_similar(percent, floor), "a long, b long, linked boolean")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int, floor: int) -> DataFrame:
    """(a, b, may) of the pairs (a, b) whose similarity reaches ``floor`` by its upper bound; ``may`` where that reaches ``percent``.

    No pair that reaches a threshold is left out; sketches travel, of a byte at most for each token instead of eight.
    """
    sketches = sets.mapInArrow(_sketches, "cls long, data binary")
    return _paired(pairs, sketches).mapInArrow(_bounded(percent, floor), "a long, b long, may boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    return compared(bounded(pairs, sets, percent, percent).select("a", "b"), sets, percent, percent).select("a", "b")


def connecting(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of (a, b) that reach the threshold, and that connect all those that any of the pairs connect.

    First every class is compared with one other.  Those links connect most of a family, so that its sets
    travel about once and not once for each pair; the pairs whose ends are still apart follow.
    """
    pairs = checkpoint(pairs)
    one = checkpoint(pairs.groupBy("a").agg(F.min("b").alias("b")))
    first = checkpoint(compared(one, sets, percent, percent).select("a", "b"))
    roots = checkpoint(connected_components(first))
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = pairs.join(one, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return first.unionByName(compared(rest, sets, percent, percent).select("a", "b"))


def _incidence(owner: np.ndarray, at: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.float32)
    out[owner, at] = 1
    return out


def _common_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Tokens in common of every set of ``left`` and every one of ``right``; columns of tokens are multiplied slice by slice."""
    both = np.zeros((len(left), len(right)), np.float32)
    tokens = [np.concatenate(x) for x in (left, right)]
    union = np.intersect1d(*map(np.unique, tokens), assume_unique=True)
    held = []
    for sets, all_tokens in zip((left, right), tokens):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(union, all_tokens)
        inside = (at < len(union)) & (union[np.minimum(at, len(union) - 1)] == all_tokens) if len(union) else np.zeros(len(at), bool)
        order = np.argsort(at[inside], kind="stable")
        held.append((owner[inside][order], at[inside][order]))
    for start in range(0, len(union), SLICE_TOKENS):
        width = min(SLICE_TOKENS, len(union) - start)
        parts = []
        for (owner, at), sets in zip(held, (left, right)):
            a, b = np.searchsorted(at, [start, start + width])
            parts.append(_incidence(owner[a:b], at[a:b] - start, len(sets), width))
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _open_block(percent: int):
    """Links between a block of queries and a block of an opened group: as many as connect what all of them connect."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = np.array(members.column("member").to_pylist(), np.int64), queries.column("query").to_pylist()
        found: list[tuple[int, int]] = []
        if len(ids) and asked:
            sets = [np.frombuffer(x, np.uint64) for x in members.column("tokens").to_pylist()]
            own = [np.frombuffer(x, np.uint64) for x in queries.column("q_tokens").to_pylist()]
            both = _common_tokens(own, sets)
            union = np.array([len(x) for x in own])[:, None] + np.array([len(x) for x in sets])[None, :] - both
            linked = 100 * both >= percent * union
            labels = np.arange(len(ids))  # members connected within this block share a label
            for i, q in enumerate(asked):
                parts, first = np.unique(labels[near := np.flatnonzero(linked[i])], return_index=True)
                if len(parts):
                    found += [(q, m) for m in ids[near[first]].tolist()]
                    labels[np.isin(labels, parts)] = parts[0]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _fits(n, least, most, percent: int):
    """Sizes that can reach the threshold: ``n`` against a set of ``least`` to ``most`` tokens."""
    return (100 * n >= percent * least) & (100 * most >= percent * n)


def _ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.explode(F.array(a, b)).alias("cls")).distinct()


def class_links(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Verified links (a, b) between classes that connect exactly the classes that links connect.

    ``postings`` (token, cls, n): signature tokens that two or more classes share,
    checkpointed; ``sets_of``: the whole sets (cls, data) of a table of classes.
    """
    common = shared_tokens(percent)
    many = postings.groupBy("token").agg(F.count("*").alias("classes")).filter(F.col("classes") > SMALL_GROUP).select("token")
    wide = checkpoint(postings.join(many, "token"))
    leaders = wide.groupBy("token", F.pmod(F.xxhash64("cls"), F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct("cls", "n")).alias("lead"))
    pairs = (
        wide.join(leaders.drop("slot"), "token")
        .filter(F.col("cls") != F.col("lead.cls"))
        .filter(_fits(F.col("n"), F.col("lead.n"), F.col("lead.n"), percent))
        .select(F.greatest("cls", "lead.cls").alias("a"), F.least("cls", "lead.cls").alias("b"))
        .distinct()
    )
    pairs = checkpoint(pairs)
    sets = sets_of(_ends(pairs, "a", "b"))
    close = checkpoint(bounded(pairs, sets, percent, min(NEAR_PERCENT, percent)))
    near = checkpoint(connecting(close.filter("may").select("a", "b"), sets, percent))
    release(postings.sparkSession)
    roots = checkpoint(connected_components(near).select(F.col("node").alias("cls"), "root"))
    centres = close.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("centre"))
    group_of = (
        _ends(close, "a", "b")
        .join(roots, "cls", "left")
        .join(centres, "cls", "left")
        .join(roots.select(F.col("cls").alias("centre"), F.col("root").alias("centre_root")), "centre", "left")
        .select("cls", F.coalesce("root", "centre_root", "centre", "cls").alias("grp"), (F.col("root").isNull() & F.col("centre").isNotNull()).alias("loose"))
    )
    group_of = checkpoint(group_of)
    sizes = group_of.groupBy("grp").agg(F.count("*").alias("members"))
    grouped = checkpoint(group_of.join(sizes, "grp"))
    held = postings.join(grouped, "cls", "left").select(
        "token", "cls", "n", F.coalesce("grp", "cls").alias("grp"), F.coalesce("members", F.lit(1)).alias("members")
    )
    matrix = held.groupBy("token", "grp", "members").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    several = matrix.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
    matrix = checkpoint(matrix.join(several, "token"))
    rows = matrix.select("token", F.col("grp").alias("to"), F.col("members").alias("to_members"), "least", "most")
    overlaps = (
        held.join(rows, "token")
        .filter(F.struct("to_members", "to") > F.struct("members", "grp"))
        .filter(_fits(F.col("n"), F.col("least"), F.col("most"), percent))
        .groupBy("cls", "to", "to_members")
        .agg(F.count("*").alias("bound"))
        .filter(F.col("bound") >= common)
    )
    loose = grouped.filter("loose").select(F.col("cls").alias("query"), F.col("grp").alias("to"), F.col("members").alias("to_members"))
    opened = checkpoint(overlaps.select(F.col("cls").alias("query"), "to", "to_members").unionByName(loose))
    release(postings.sparkSession)
    members = grouped.select(F.col("grp").alias("to"), F.col("cls").alias("member"))
    inside = opened.select("to").distinct().join(members, "to", "left").select(F.coalesce("member", "to").alias("cls"))
    sets = sets_of(inside.unionByName(opened.select(F.col("query").alias("cls"))).distinct())
    small = opened.filter(F.col("to_members") <= SMALL_GROUP).join(members, "to", "left")
    small = small.select(F.col("query").alias("a"), F.coalesce("member", "to").alias("b")).filter("a != b")
    found = [near, verified(small, sets, percent)]
    large = opened.filter(F.col("to_members") > SMALL_GROUP)
    counts = large.groupBy("to", "to_members").agg(F.count("*").alias("queries"))
    counts = counts.select(
        "to", F.ceil(F.col("to_members") / BLOCK).cast("int").alias("mblocks"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("qblocks")
    )

    def dealt(rows: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")
        held = rows.join(counts, "to").join(sets, "cls").withColumn("block", block)
        held = held.withColumn("against", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return held.select(*[F.col(c).alias(n) for c, n in zip(("to", "block", "against", "cls", "data"), names)])

    if not large.isEmpty():
        left = dealt(members.withColumnRenamed("member", "cls"), "mblocks", "qblocks", ["m_to", "m_block", "m_query", "member", "tokens"])
        right = dealt(large.select("to", F.col("query").alias("cls")), "qblocks", "mblocks", ["q_to", "q_block", "q_member", "query", "q_tokens"])
        grouped = left.groupBy("m_to", "m_block", "m_query").cogroup(right.groupBy("q_to", "q_member", "q_block"))
        found.append(grouped.applyInArrow(_open_block(percent), "a long, b long"))
    return reduce(DataFrame.unionByName, found)


def set_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a row (doc_id, text_key, cls, n) for each document, and the root of each linked class.

    The second table (node, root) has the classes that some other class links to.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1..100")
    keyed = keyed_texts(docs)
    widespread = docs.sparkSession.sparkContext.broadcast(widespread_tokens(keyed.select("text"), width))
    schema = "doc_id long, text_key long, cls long, n long, tokens array<long>"
    rows = checkpoint(keyed.mapInArrow(_signatures(width, percent, widespread), schema))
    filled = rows.filter(F.size("tokens") > 0)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    of_class = checkpoint(filled.groupBy("cls").agg(F.min(order).alias("one"), F.count("*").alias("copies")))
    # token lists stay where they are: of copies, the first alone gives its tokens
    copied = small_side(of_class.filter("copies > 1").select("cls", "one"))
    first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_key") == F.col("one.text_key"))
    alone = filled.join(copied, "cls", "left").filter(F.col("one").isNull() | first)
    postings = alone.select(F.explode("tokens").alias("token"), "cls", F.col("n").cast("int").alias("n"))
    own = Window.partitionBy("token")  # one shuffle, where counting tokens and joining the counts takes two
    shared = postings.withColumns({"least": F.min("cls").over(own), "most": F.max("cls").over(own)}).filter("least < most")
    postings = checkpoint(shared.select("token", "cls", "n").dropDuplicates(["token", "cls"]))
    # fewer shared tokens than any link has: no partner
    enough = postings.withColumn("shared", F.count("*").over(Window.partitionBy("cls"))).filter(F.col("shared") >= shared_tokens(percent))
    postings = checkpoint(enough.drop("shared"))

    def sets_of(classes: DataFrame) -> DataFrame:
        wanted = of_class.join(classes, "cls").select("cls", F.col("one.doc_id").alias("want_id"), F.col("one.text_key").alias("want_key"))
        return checkpoint(texts_of(keyed, wanted).mapInArrow(_class_sets(width), "cls long, data binary"))

    return rows.drop("tokens"), connected_components(class_links(postings, sets_of, percent))


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their sets
    of distinct ``width``-word shingles; ``component_id`` is the smallest doc_id
    reachable through links, the document itself included.

    Defined cases: null and empty texts, and texts without a word, have an empty
    set and link with nothing (their component is themselves); texts with fewer words than
    ``width`` have one shingle, the whole sequence; repeated rows link like any
    other copies; a null doc_id takes part but names a component only where no
    member has an id; an empty table gives an empty one; further columns are ignored.
    """
    rows, roots = set_classes(docs, width, percent)
    own = rows.groupBy("cls").agg(F.min("doc_id").alias("least")).join(
        roots.select(F.col("node").alias("cls"), "root"), "cls", "left"
    )
    own = own.select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select("cls", "component_id")
    filled = rows.filter("n > 0").join(named, "cls").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked documents: the one with the smallest doc_id.

    Ties (repeated ids, null ids) go to the smallest text key; of rows equal in id
    and text one stays.  Documents without words are no copies and all stay.
    Columns and their order are those of ``docs``.
    """
    rows, roots = set_classes(docs, width, percent)
    filled = rows.filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    own = filled.groupBy("cls").agg(F.min(order).alias("one")).join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    own = own.select("cls", "one", F.coalesce("root", "cls").alias("grp"))
    kept = own.groupBy("grp").agg(F.min("one").alias("kept"))
    placed = filled.join(own.join(kept, "grp").select("cls", "kept"), "cls")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    names = []
    for name in ("id", "key"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)
    gone = small_side(placed.filter(~stays).select("doc_id", "text_key").distinct().toDF(*names))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (text_key(F.col("text")) == F.col(names[1]))
    # the few rows that go are sent to the texts, which are not shuffled for it
    left = docs.join(gone, same, "left_anti")
    again = placed.filter(stays).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = small_side(again.toDF(*names))
    if again.isEmpty():
        return left
    once = left.join(again, same).dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(again, same, "left_anti").unionByName(once)
