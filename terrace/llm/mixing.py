"""Mixing documents to target shares by iterative proportional fitting.

Expected tokens of the (source, language, topic) cells are raked until each margin
has its target share of the budget, with no cell above the tokens it holds; documents
are then sampled by the probability of their cell.  A value that holds fewer tokens
than its target asks for is taken whole and the others share the rest in the ratio of
their targets; ``margin_report`` shows the target, reachable and expected shares.
Documents are aggregated to cells before anything iterates, so the rounds run over a
table as large as the number of cells, as sums over its margins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import WHITE, apart, checkpoint, put_back, small_side


DIMS = ["source", "lang", "topic"]
NAMES = [f"__{d}" for d in DIMS]
#: Columns of the documents that the mix reads.
NEEDED = ("doc_id", "text", "source", "lang")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def layout_topic(text: Column) -> Column:
    """A topic stand-in from the layout of a text: markup, listing, brief, longform or article; 'none' for null or empty."""
    size = F.length(text)
    lines = size - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return (
        F.when(text.isNull() | (size == 0), "none")
        .when(symbols * 20 > size, "markup")
        .when((lines > 3) & (size < lines * 80), "listing")
        .when(size < 600, "brief")
        .when(size > 6000, "longform")
        .otherwise("article")
    )


def _label(c: Column) -> Column:
    """A text that is never null and differs for null and every value."""
    return F.when(c.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), c.cast("string")))


def with_targets(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` with target_<dim> from tables (dim, target); a value without a target gets 0."""
    for dim, table in targets.items():
        cells = cells.join(table.select(dim, F.col("target").alias(f"target_{dim}")), dim, "left").fillna(0.0, [f"target_{dim}"])
    return cells


def with_tempered_targets(cells: DataFrame, powers: Mapping[str, float]) -> DataFrame:
    """``cells`` with target_<dim>: the share of the cell's value, raised to a power and made to add to 1 over the values."""
    held = cells.select("*", *[F.sum("tokens").over(Window.partitionBy(d)).cast("double").alias(f"t_{d}") for d in powers])
    raised = {d: F.when(F.col(f"t_{d}") > 0, F.pow(F.col(f"t_{d}"), F.lit(p))).otherwise(0.0) for d, p in powers.items()}
    held = checkpoint(held)
    # a value's cells hold all its tokens, so their shares of it add to 1
    part = {d: F.when(F.col(f"t_{d}") > 0, raised[d] * F.col("tokens") / F.col(f"t_{d}")) for d in powers}
    sums = held.agg(*[F.sum(x).alias(d) for d, x in part.items()]).first()
    return held.select(*cells.columns, *[(raised[d] / F.lit(sums[d] or 1.0)).alias(f"target_{d}") for d in powers])


def with_reachable(cells: DataFrame, dims: list[str], budget: float) -> DataFrame:
    """``cells`` with wanted_<dim>: the tokens to expect of the cell's value, ``budget`` of all tokens in every dimension.

    A value gets its target's part of the budget or, where it holds less, all it
    holds; the others share what is left in the ratio of their targets.  Cells with
    a target of 0 in any dimension hold nothing that can be taken.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    open_ = F.lit(True)
    for d in dims:
        open_ = open_ & (F.col(f"target_{d}") > 0)
    cells = cells.withColumn("usable", F.when(open_, F.col("tokens")).otherwise(0))
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target"), "usable") for d in dims]))
    values = checkpoint(cells.select(values.alias("v")).groupBy("v.dim", "v.value").agg(F.first("v.target").alias("target"), F.sum("v.usable").alias("held")))
    values = values.filter("target > 0 AND held > 0")
    # the scale grows from round to round as values turn out to be taken whole, and ends when no more do
    scale = {d: 0.0 for d in dims}
    whole: dict[str, int] = {}
    while True:
        by = F.create_map(*[x for d in dims for x in (F.lit(d), F.lit(scale[d]))])[F.col("dim")]
        is_whole = by * F.col("target") >= F.col("held")
        sums = values.groupBy("dim").agg(
            F.sum(F.when(is_whole, F.col("held")).otherwise(0)).alias("taken"), F.sum(F.when(~is_whole, F.col("target"))).alias("rest"),
            F.count(F.when(is_whole, 1)).alias("n"), F.sum("held").alias("held"),
        ).collect()
        now = {r["dim"]: r["n"] for r in sums}
        if whole and now == whole:
            break
        whole = now
        # rest is null when all values are taken whole
        scale |= {r["dim"]: (min(budget * total, r["held"]) - r["taken"]) / r["rest"] for r in sums if r["rest"]}
        if not sums:
            break
    for d in dims:
        held = F.sum("usable").over(Window.partitionBy(d))
        cells = cells.withColumn(f"wanted_{d}", F.least(F.lit(scale[d]) * F.col(f"target_{d}"), held.cast("double")))
    return cells


def rake(cells: DataFrame, dims: list[str], budget: float, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """``cells`` (dims, tokens, target_<dim>) with wanted_<dim> and ``probability``, at most 1, whose expected tokens meet every wanted_<dim>.

    A cell's rate is a product of one factor a value of each dimension and its
    probability is min(1, rate).  Each round finds, dimension by dimension, the factors that meet the
    wanted tokens exactly with that bound, and is checkpointed; it ends when no margin was off by
    more than ``tolerance`` of its wanted tokens.  Cells with a target of 0 get probability 0, as
    do cells without tokens.  Margins that no probabilities can meet together are
    met as nearly as the last round came; ``margin_report`` shows them.
    """
    now = checkpoint(with_reachable(cells, dims, budget).withColumn("rate", F.when(F.col("usable") > 0, F.lit(budget)).otherwise(0.0)))
    for _ in range(rounds):
        for dim in dims:
            now = _scaled(now, dim, dims)
        now = checkpoint(now)
        off = now.agg(*[F.max(f"off_{d}").alias(d) for d in dims]).first()
        now = now.drop(*[f"off_{d}" for d in dims])
        if max((x or 0.0) for x in off) <= tolerance:
            break
    return now.withColumn("probability", F.least(F.lit(1.0), F.col("rate"))).drop("rate", "usable")


def _scaled(cells: DataFrame, dim: str, dims: list[str]) -> DataFrame:
    """``cells`` with the rates of each value of ``dim`` scaled so that sum(usable * min(1, rate)) is its wanted tokens, and how far it was off."""
    value, wanted = Window.partitionBy(dim), F.col(f"wanted_{dim}")
    upward = value.orderBy("rate", *[d for d in dims if d != dim]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # with the cells above this one at their bound, the factor that leaves the rest of the wanted tokens to the others
    seen = F.sum("usable").over(upward)
    free = F.sum(F.col("usable") * F.col("rate")).over(upward)
    cells = cells.withColumn("__seen", seen).withColumn("__f", (wanted - (F.sum("usable").over(value) - F.col("__seen"))) / F.when(free > 0, free))
    fits = (F.col("__f") > 0) & (F.col("__f") * F.col("rate") <= 1)
    factor = F.max(F.when(fits, F.struct("__seen", "__f"))).over(value)["__f"]
    # none fits when the value is taken whole, but for rounding
    whole = 1 / F.min(F.when(F.col("usable") > 0, F.col("rate"))).over(value)
    held = F.sum(F.col("usable") * F.least(F.lit(1.0), F.col("rate"))).over(value)
    cells = cells.withColumn("__by", F.coalesce(factor, whole, F.lit(0.0))).withColumn(f"off_{dim}", F.when(wanted > 0, F.abs(held / wanted - 1)))
    return cells.withColumn("rate", F.col("rate") * F.col("__by")).drop("__seen", "__f", "__by")


def _facts(docs: DataFrame, topic: Column | None) -> DataFrame:
    return apart(docs, NEEDED, __given=layout_topic(F.col("text")) if topic is None else topic)


def _counted(facts: DataFrame) -> DataFrame:
    labels = F.struct(
        _label(F.col("source")).alias("__source"), _label(F.col("lang")).alias("__lang"), _label(F.col("__given")).alias("__topic"), word_count(F.col("text")).alias("__n")
    )
    return facts.select("*", F.inline(F.array(labels)))


def _raked(counted: DataFrame, powers: Mapping[str, float], budget: float, targets: Mapping[str, DataFrame] | None) -> DataFrame:
    if not 0 < budget <= 1:
        raise ValueError("budget must lie in (0, 1]")
    targets = targets or {}
    cells = checkpoint(counted.groupBy(*NAMES).agg(F.sum("__n").alias("tokens")))
    cells = with_tempered_targets(cells, {f"__{d}": powers[d] for d in DIMS if d not in targets})
    tables = {f"__{d}": t.select(_label(F.col(d)).alias(f"__{d}"), F.col("target").cast("double").alias("target")) for d, t in targets.items()}
    return rake(with_targets(cells, tables), NAMES, budget)


def margin_report(
    docs: DataFrame, powers: Mapping[str, float], budget: float, topic: Column | None = None, targets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(dim, value, tokens, target, reachable, expected) of the margins of ``mixed``: tokens held, and shares of the sample.

    ``reachable`` is below ``target`` for a value that holds fewer tokens than its
    target asks for, and above it for the others then; ``expected`` is what the sample has.
    """
    cells = _raked(_counted(_facts(docs, topic)), powers, budget, targets)
    rows = [
        F.struct(F.lit(d).alias("dim"), F.when(F.col(n) != "~", F.substr(F.col(n), F.lit(2))).alias("value"), "tokens", F.col(f"target_{n}").alias("target"),
                 F.col(f"wanted_{n}").alias("wanted"), (F.col("tokens") * F.col("probability")).alias("expected"))
        for d, n in zip(DIMS, NAMES)
    ]
    margins = cells.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.dim", "r.value").agg(
        F.sum("r.tokens").alias("tokens"), F.first("r.target").alias("target"), F.first("r.wanted").alias("wanted"), F.sum("r.expected").alias("expected")
    )
    margins = checkpoint(margins)
    sums = margins.groupBy("dim").agg(F.sum("target").alias("__t"), F.sum("wanted").alias("__w"), F.sum("expected").alias("__e"))
    share = lambda c, whole: F.when(F.col(whole) > 0, F.col(c) / F.col(whole)).otherwise(0.0).alias(c)
    shares = [share("target", "__t"), share("wanted", "__w").alias("reachable"), share("expected", "__e")]
    return margins.join(F.broadcast(sums), "dim").select("dim", "value", "tokens", *shares)


def mixed(
    docs: DataFrame, powers: Mapping[str, float], budget: float, seed: int = 0, topic: Column | None = None, targets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with topic, n_tokens, probability and selected.

    ``powers``: for source, lang and topic the power that tempers its present
    shares into target shares (1 keeps them, 0 makes them equal).  ``budget``: the
    share of all tokens to expect in the sample.  ``topic``: a column expression,
    by default the layout of the text.  ``targets``: for any of source, lang and topic a
    table (that column, target) of shares to use instead of the tempered ones; a value
    that the table does not have gets 0.

    The expected tokens meet the targets where every value holds as many tokens as
    its target's part of the budget; ``margin_report`` shows what is reached elsewhere.

    A document is selected when its uniform hash of (seed, doc_id, text) lies
    below its probability: the same on every run, at any partitioning.  Rows equal in
    id and text share their fate.

    Defined cases: null source, language or topic is a value of its own; null and
    empty texts have no tokens, probability 0 and are not selected; an empty table
    gives an empty one; columns named as the result's are replaced.
    """
    counted = _counted(_facts(docs, topic))
    rates = _raked(counted, powers, budget, targets).select(*NAMES, F.col("probability").alias("__p"))
    rates = small_side(rates)
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    p = F.when(F.col("__n") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(0.0)
    shown = F.when(F.col("__topic") != "~", F.substr(F.col("__topic"), F.lit(2)))
    result = counted.join(rates, NAMES, "left").withColumns(
        {"topic": shown, "n_tokens": F.col("__n"), "probability": p, "selected": uniform < p}
    )
    return put_back(result, docs, ("topic", "n_tokens", "probability", "selected"))


def sampled(docs: DataFrame, powers: Mapping[str, float], budget: float, seed: int = 0) -> DataFrame:
    """The selected documents of ``mixed``, with the columns of ``docs``."""
    return put_back(mixed(apart(docs, NEEDED), powers, budget, seed).filter("selected"), docs)
