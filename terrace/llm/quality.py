"""Quality rules whose cutoffs adapt to each language and source.

Every metric is counted natively over the whole text.  Per (language, source) a
mergeable quantile sketch of each metric is built: counts of log-linear buckets
(the seven leading bits of the value, so a quantile is off by under 1/64 of itself).
Sketches merge by adding counts: sources merge to a language, languages to all
documents.  A group with few rows takes its cutoffs from the next wider sketch.
Cutoffs lie beyond the bulk of their group; documents outside are rejected by a
join with the cutoffs.  No Python runs.

The cutoffs start at a high (or low) quantile of the group's own sketch; no fixed value enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import WHITE, apart, checkpoint, put_back, small_side

#: Rows from which a group's own sketch is used.
MIN_GROUP = 50
#: Metric -> lower side too.
METRICS = {"symbols": False, "dup_lines": False, "repeats": False, "word_len": True}
#: Percent of a group's rows below the low and the high starting point, and how many quartile distances beyond it are still inside.
LOW_TAIL, HIGH_TAIL, TAIL_REACH = 3, 97, 3
PERCENTS = (LOW_TAIL, 25, 50, 75, HIGH_TAIL)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Counts of ``text_counts`` beside those of the registered query.
MORE_COUNTS = ["n_lines"]
#: Words of a window of the repetition count.
WINDOW = 8


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``hashes`` are the windows' in order."""
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        at = F.transform(
            s,
            lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]
            ),
        )
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    # one-element transforms name an intermediate array, so that it is made once
    covered = F.transform(F.transform(F.array(by_hash), positions), lambda p: F.aggregate(p, start, step, lambda acc: acc["n"]))
    return F.get(covered, 0)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long); null text counts as empty.

    Columns of these names that ``docs`` has already are replaced.
    """
    added = COUNTS + MORE_COUNTS
    base = docs.drop(*added).withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    words = F.array_remove(F.split("__text", f"[{WHITE}]+"), "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    base = base.withColumn("__words", words).withColumn("__lines", lines)
    slots = F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1))
    windows = F.when(F.size("__words") > WINDOW, F.transform(slots, lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    base = base.withColumn("__windows", windows)
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    counts = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, _repeated_words(F.col("__words"), F.col("__windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    # the generator keeps filters on the counts above it; pushed below, they would count anew for every reference
    return base.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Whole-number metrics: shares (repeated lines: of the lines) in thousandths, word length in hundredths of a code point."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.floor(F.expr("1000 * n_symbols / greatest(word_chars, 1)")),
        "dup_lines": F.floor(F.expr("1000 * n_dup_lines / greatest(n_lines, 1)")),
        "repeats": F.floor(1000 * F.col("n_repeat_words") / words),
        "word_len": F.floor(100 * F.col("word_chars") / words),
    }


def _dropped_bits(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number of 0 or more: its seven leading bits."""
    drop = _dropped_bits(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): the quantile sketch of each metric of the rows that pass the base rules."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v.cast("long")).alias("bucket")) for k, v in metrics().items()])
    return (
        counted.filter(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rows).alias("r"))
        .groupBy("lang", "source", "r.metric", "r.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], level: int, percents: tuple[int, ...]) -> DataFrame:
    """One row per key with the row count and each metric's quantiles; ``level``: 0 for the narrowest."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    # a sketch has a bounded number of buckets, whatever the number of rows it counts
    per_metric = merged.groupBy(*keys, "metric").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("bs"))

    def at(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))

        def step(acc: Column, b: Column) -> Column:
            seen = acc["seen"] + b["n"]
            return F.struct(seen.alias("seen"), F.coalesce(acc["value"], F.when(100 * seen >= percent * F.col("rows"), b["bucket"])).alias("value"))

        return F.aggregate("bs", start, step, lambda acc: acc["value"])

    wide = per_metric.select(*keys, "metric", "rows", *[at(p).alias(f"q{p}") for p in percents])
    picks = [F.max(F.when(F.col("metric") == m, F.col(f"q{p}"))).alias(f"{m}_q{p}_{level}") for m in METRICS for p in percents]
    return wide.groupBy(*keys).agg(F.max("rows").alias(f"rows_{level}"), *picks)


def _group_quantiles(sketch: DataFrame, min_group: int, percents: tuple[int, ...]) -> DataFrame:
    """(lang, source, <metric>_q<percent>): a group's own quantiles or, with fewer than ``min_group`` rows, the next wider sketch's."""
    groups = _quantiles(sketch, ["lang", "source"], 0, percents)
    langs = _quantiles(sketch.drop("source"), ["lang"], 1, percents).withColumnRenamed("lang", "__lang")
    overall = _quantiles(sketch.withColumn("one", F.lit(1)), ["one"], 2, percents)
    joined = groups.join(langs, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("one", F.lit(1)).join(overall, "one", "left")
    level = F.when(F.col("rows_0") >= min_group, 0).when(F.col("rows_1") >= min_group, 1).otherwise(2)
    names = [f"{m}_q{p}" for m in METRICS for p in percents]
    return joined.select("lang", "source", *[F.element_at(F.array(*[F.col(f"{n}_{i}") for i in range(3)]), level + 1).alias(n) for n in names])


def cutoffs(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high) for every group of ``sketch``; nulls are groups of their own.

    A cutoff is the group's tail quantile, TAIL_REACH quartile distances and the width of one
    bucket away from the median; at most 3% of a group's rows are beyond each side of a metric.
    """
    width = lambda q: F.call_function("shiftleft", F.lit(1).cast("long"), _dropped_bits(q))
    out = []
    for m, both in METRICS.items():
        bottom, q25, q50, q75, top = (F.col(f"{m}_q{p}") for p in PERCENTS)
        low = bottom - TAIL_REACH * (q50 - q25) - width(bottom) if both else F.lit(0)
        out += [low.cast("long").alias(f"{m}_low"), (top + TAIL_REACH * (q75 - q50) + width(top)).cast("long").alias(f"{m}_high")]
    return _group_quantiles(sketch, min_group, PERCENTS).select("lang", "source", *out)


def judge(counted: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``counted`` (lang, source and the counts) with base_failed and kept.

    ``counted`` is read twice: for the sketches, then for the verdicts.
    """
    limits = cutoffs(sketches(counted), min_group)
    limits = small_side(limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in limits.columns[2:]]))
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    inside = [(v >= F.col(f"__{m}_low")) & (v <= F.col(f"__{m}_high")) for m, v in metrics().items()]
    verdict = ~base_failed() & F.coalesce(inside[0] & inside[1] & inside[2] & inside[3], F.lit(False))
    keep = [F.col(f"`{c}`") for c in counted.columns if c not in ("base_failed", "kept")]
    return counted.join(limits, same, "left").select(*keep, base_failed().alias("base_failed"), verdict.alias("kept"))


def judged(docs: DataFrame, min_group: int = MIN_GROUP, carry_text: bool = True) -> DataFrame:
    """``docs`` (text, lang, source) with the counts of ``text_counts``, base_failed and kept.

    Without ``carry_text`` the text is dropped and the counts are checkpointed, so that texts are counted once.

    Defined cases: null and empty texts have counts of 0, fail the base rules and
    are not kept; null languages and sources are groups of their own; a group
    without a row that passes the base rules keeps nothing anyway; repeated rows
    are judged alike; an empty table gives an empty one; columns named as the
    result's are replaced.
    """
    added = (*COUNTS, *MORE_COUNTS, "base_failed", "kept")
    docs = docs.drop(*added)
    counted = text_counts(apart(docs, ("text", "lang", "source")))
    verdicts = judge(counted if carry_text else checkpoint(counted.drop("text")), min_group)
    return put_back(verdicts, docs, added, () if carry_text else ("text",))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    return put_back(judged(apart(docs, ("text", "lang", "source"))).filter("kept"), docs)
