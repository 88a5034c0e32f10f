"""Proper scoring rules and classification metrics as column expressions and aggregates.

Classes are -1 (away), 0 (draw), 1 (home); probability columns come in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.scale import sliced_running

CLASSES = (-1, 0, 1)
PROBS = ("p_away", "p_draw", "p_home")


def _p(probs=PROBS) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in probs]


def rps(y: Column, probs=PROBS) -> Column:
    """Ranked probability score of one row."""
    away, draw, _ = _p(probs)
    first = away - F.when(y == -1, 1.0).otherwise(0.0)
    second = away + draw - F.when(y <= 0, 1.0).otherwise(0.0)
    return (first * first + second * second) / 2.0


def true_probability(y: Column, probs=PROBS) -> Column:
    away, draw, home = _p(probs)
    return F.when(y == -1, away).when(y == 0, draw).otherwise(home)


def log_loss(y: Column, probs=PROBS) -> Column:
    return -F.ln(F.least(F.greatest(true_probability(y, probs), F.lit(1e-15)), F.lit(1.0)))


def brier(y: Column, probs=PROBS) -> Column:
    """Summed squared error over the classes (divide by 3 for the per-class form)."""
    out = F.lit(0.0)
    for c, p in zip(CLASSES, _p(probs)):
        gap = p - F.when(y == c, 1.0).otherwise(0.0)
        out = out + gap * gap
    return out


def argmax_class(probs=PROBS) -> Column:
    """Most likely class; ties go to the lowest class."""
    away, draw, home = _p(probs)
    return F.when((away >= draw) & (away >= home), -1).when(draw >= home, 0).otherwise(1)


def pick_label(probs=PROBS) -> Column:
    """Most likely label; ties go to the first of home, draw, away."""
    away, draw, home = _p(probs)
    return F.when((home >= draw) & (home >= away), "Home Win").when(draw >= away, "Draw").otherwise("Away Win")


def draw_rule(threshold: float | Column, probs=PROBS) -> Column:
    """Draw when its probability reaches the threshold, else the better win."""
    away, draw, home = _p(probs)
    return F.when(draw >= threshold, 0).when(away >= home, -1).otherwise(1)


def count_columns(y: Column, pred: Column, weight: Column | None = None) -> dict[str, Column]:
    """Per-class hits, predictions and occurrences: all that the metrics below need."""
    w = F.lit(1) if weight is None else weight
    total = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    out = {"n": F.sum(w)}
    for i, c in enumerate(CLASSES):
        out[f"tp{i}"] = total((y == c) & (pred == c))
        out[f"pp{i}"] = total(pred == c)
        out[f"ap{i}"] = total(y == c)
    return out


def accuracy_of() -> Column:
    return (F.col("tp0") + F.col("tp1") + F.col("tp2")) / F.col("n")


def macro_f1_of() -> Column:
    out = F.lit(0.0)
    for i in range(3):
        size = F.col(f"pp{i}") + F.col(f"ap{i}")
        out = out + F.when(size > 0, 2.0 * F.col(f"tp{i}") / size).otherwise(0.0)
    return out / 3.0


def recall_of(i: int) -> Column:
    return F.when(F.col(f"ap{i}") > 0, F.col(f"tp{i}") / F.col(f"ap{i}"))


def summary(df: DataFrame, y: Column, pred: Column, keys: list[str] | None = None, probs=PROBS, digits: int = 4) -> DataFrame:
    """Accuracy, macro-F1, draw recall, RPS, log-loss and both Brier forms in one pass."""
    aggs = count_columns(y, pred)
    aggs.update({"_rps": F.avg(rps(y, probs)), "_ll": F.avg(log_loss(y, probs)), "_br": F.avg(brier(y, probs))})
    g = df.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    r = lambda c: F.round(c, digits)
    return g.select(
        *(keys or []),
        "n",
        r(accuracy_of()).alias("accuracy"),
        r(macro_f1_of()).alias("macro_f1"),
        r(recall_of(1)).alias("draw_recall"),
        r(F.col("_rps")).alias("rps"),
        r(F.col("_ll")).alias("log_loss"),
        r(F.col("_br") / 3.0).alias("brier"),
        r(F.col("_br")).alias("brier_sum"),
    )


def confusion(df: DataFrame, y: Column, pred: Column) -> DataFrame:
    """Confusion counts with precision, recall, F1 and support per actual class."""
    cells = df.groupBy(y.alias("actual"), pred.alias("pred")).agg(F.count("*").alias("c"))
    hit = lambda c: F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("c"))), F.lit(0))
    rows = cells.groupBy("actual").agg(*[hit(c).alias(f"pred_{n}") for c, n in zip(CLASSES, ("away", "draw", "home"))], F.sum("c").alias("support"))
    predicted = cells.groupBy(F.col("pred").alias("actual")).agg(F.sum("c").alias("_pp"))
    out = rows.join(predicted, "actual", "left")
    tp = F.when(F.col("actual") == -1, F.col("pred_away")).when(F.col("actual") == 0, F.col("pred_draw")).otherwise(F.col("pred_home"))
    pp = F.coalesce("_pp", F.lit(0))
    return out.select(
        "actual", "pred_away", "pred_draw", "pred_home", "support",
        F.round(F.when(pp > 0, tp / pp).otherwise(0.0), 6).alias("precision"),
        F.round(tp / F.col("support"), 6).alias("recall"),
        F.round(F.when(pp + F.col("support") > 0, 2.0 * tp / (pp + F.col("support"))).otherwise(0.0), 6).alias("f1"),
    )


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """Counts per outcome and whether it is the majority class."""
    c = df.groupBy(y).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # over one row per class
    top = F.max(F.struct("n", F.col(y).alias("y"))).over(w)["y"]
    return c.select(y, "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), (F.col(y) == top).alias("majority"))


def auc_ovr(df: DataFrame, y: str = "y", probs=PROBS) -> DataFrame:
    """One-vs-rest ROC-AUC per class.

    Rows are first summed per distinct score; the cumulative counts then run over
    range-partitioned scores, never in one window.
    """
    rows = df.select(
        F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), p.alias("score")) for c, p in zip(CLASSES, _p(probs))])).alias("s")
    )
    pos = F.when(F.col("_y") == F.col("s.cls"), 1).otherwise(0)
    by_score = rows.groupBy(F.col("s.cls").alias("cls"), F.col("s.score").alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    ranked = sliced_running(by_score, ["cls"], ["score"], {"below": ("sum", F.col("neg"))})
    return ranked.groupBy("cls").agg(
        F.round(
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg")), 6
        ).alias("auc")
    )


def league_breakdown(df: DataFrame, league: str, y: Column, pred: Column, min_matches: int = 100) -> DataFrame:
    """Per-league accuracy with small leagues pooled; two small aggregations after one pass."""
    known = F.coalesce(F.nullif(F.col(league), F.lit("")), F.lit("unknown"))
    per = df.groupBy(known.alias("league")).agg(*[c.alias(n) for n, c in count_columns(y, pred).items()])
    small = F.col("n") < min_matches
    keyed = per.withColumn("key", F.when(small, F.lit(None)).otherwise(F.col("league")))
    sums = [F.sum(c).alias(c) for c in per.columns if c != "league"]
    rolled = keyed.groupBy("key").agg(*sums, F.count("*").alias("_k"))
    label = F.coalesce("key", F.concat(F.lit("(pooled: "), F.col("_k").cast("string"), F.lit(f" leagues under {min_matches} matches)")))
    r = lambda c: F.round(c, 4)
    return rolled.select(
        label.alias("league"), F.col("n").alias("matches"), r(accuracy_of()).alias("accuracy"), r(macro_f1_of()).alias("macro_f1"),
        r(recall_of(1)).alias("draw_recall"), r(F.col("ap2") / F.col("n")).alias("home_win_rate"), F.col("key").isNull().alias("pooled"),
    )


def reliability(df: DataFrame, y: Column, probs=PROBS, n_bins: int = 10) -> DataFrame:
    """Confidence bins [lo, hi), the last one closed, against observed accuracy."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    conf = F.greatest(*_p(probs))
    idx = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(conf >= e, 1).otherwise(0)
    hit = F.when(argmax_class(probs) == y, 1.0).otherwise(0.0)
    g = df.groupBy(idx.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(hit).alias("a"))
    edge = lambda i: F.round(F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + i), 2)
    return g.select(
        edge(1).alias("bin_low"), edge(2).alias("bin_high"), "n", F.round("c", 4).alias("mean_confidence"), F.round("a", 4).alias("observed_accuracy")
    )


def confidence_bands(log: DataFrame) -> DataFrame:
    """Settled forecasts by confidence band: stated against realised rate, in percent."""
    conf = F.greatest("p_home", "p_draw", "p_away")
    band = None
    for lo, hi in V.TRACK_BANDS:
        name = f"{int(lo * 100)}–{int(hi * 100) if hi <= 1 else 100}%"
        cond = (conf >= lo) & (conf < hi)
        band = F.when(cond, name) if band is None else band.when(cond, name)
    hit = F.when(pick_label() == F.col("actual"), 1.0).otherwise(0.0)
    g = settled(log).groupBy(band.alias("band")).agg(F.avg(conf).alias("c"), F.avg(hit).alias("a"), F.count("*").alias("n"))
    return g.select("band", F.round(F.col("c") * 100, 1).alias("predicted"), F.round(F.col("a") * 100, 1).alias("actual"), "n")


def settled(log: DataFrame) -> DataFrame:
    return log.filter((F.col("status") == "settled") & F.col("actual").isNotNull())


def label_class(label: Column) -> Column:
    return F.when(label == "Home Win", 1).when(label == "Draw", 0).when(label == "Away Win", -1)


def track_score(log: DataFrame) -> DataFrame:
    """Counts and scores of the whole log in one conditional aggregation."""
    done = (F.col("status") == "settled") & F.col("actual").isNotNull()
    y = label_class(F.col("actual"))
    mean = lambda c: F.round(F.avg(F.when(done, c)), 4)
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return log.agg(
        F.count("*").alias("n_logged"),
        F.count(F.when(F.col("status") == "pending", 1)).alias("n_pending"),
        F.count(F.when(done, 1)).alias("n_settled"),
        mean(flag(pick_label() == F.col("actual"))).alias("accuracy"),
        mean(flag(F.col("actual") == "Home Win")).alias("baseline_acc"),
        mean(rps(y)).alias("rps"),
        mean(log_loss(y)).alias("log_loss"),
        mean(brier(y)).alias("brier"),
    )


def track_by_league(log: DataFrame, league: str = "competition") -> DataFrame:
    y = label_class(F.col("actual"))
    hit = F.when(pick_label() == F.col("actual"), 1.0).otherwise(0.0)
    return settled(log).groupBy(league).agg(
        F.count("*").alias("n"), F.round(F.avg(hit), 3).alias("accuracy"), F.round(F.avg(rps(y)), 4).alias("rps")
    )
