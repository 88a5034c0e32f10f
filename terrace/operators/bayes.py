"""Gaussian naive Bayes as plain aggregation and column scoring, and binned mutual information."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

VAR_FLOOR = 1e-9
PDF_FLOOR = 1e-300


@dataclass(frozen=True)
class NaiveBayesModel:
    """Three classes by F features: priors, means and variances."""

    features: list[str]
    classes: list[int]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def log_scores(self) -> list[Column]:
        out = []
        for prior, means, variances in zip(self.priors, self.means, self.variances):
            score = F.lit(math.log(prior))
            for f, m, v in zip(self.features, means, variances):
                x = F.col(f).cast("double") - m
                log_pdf = -x * x / (2.0 * v) - 0.5 * math.log(2.0 * math.pi * v)
                score = score + F.greatest(log_pdf, F.lit(math.log(PDF_FLOOR)))
            out.append(score)
        return out

    def transform(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Add one probability column per class."""
        raw = [f"_s{i}" for i in range(len(self.classes))]
        df = df.withColumns(dict(zip(raw, self.log_scores())))
        top = F.greatest(*raw)
        df = df.withColumns({f"_e{i}": F.exp(F.col(r) - top) for i, r in enumerate(raw)})
        total = sum((F.col(f"_e{i}") for i in range(1, len(raw))), F.col("_e0"))
        df = df.withColumns({n: F.col(f"_e{i}") / total for i, n in enumerate(names)})
        return df.drop(*raw, *[f"_e{i}" for i in range(len(raw))])


def fit_naive_bayes(df: DataFrame, features: list[str], y: str = "y") -> NaiveBayesModel:
    """One aggregation by class; only (classes x features) numbers reach the driver."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    rows = df.groupBy(y).agg(*aggs).orderBy(y).collect()
    total = sum(r["n"] for r in rows)
    k = range(len(features))
    return NaiveBayesModel(
        list(features),
        [r[y] for r in rows],
        [r["n"] / total for r in rows],
        [[r[f"m{i}"] for i in k] for r in rows],
        [[max(r[f"v{i}"], VAR_FLOOR) for i in k] for r in rows],
    )


def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def _extremes(n: int):
    """(_i, lo, hi) of each of the first ``n`` columns of a slice; NaN is the largest value, as in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, float]] = []
        for batch in batches:
            for i in range(n):
                values = batch.column(i).drop_null().to_numpy()
                if len(values):
                    held.append((i, np.fmin.reduce(values), values.max()))
        at, lo, hi = zip(*held) if held else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64())], ["_i", "lo", "hi"])

    return run


def _cells(spans: list[tuple[float, float] | None], bins: int, y_type: pa.DataType):
    """(_i, b, y, n): how many rows of a slice lie in each bin of each column, by the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[Any, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(len(spans)).dictionary_encode()
            classes = [*coded.dictionary.to_pylist(), None]
            code = coded.indices.fill_null(len(classes) - 1).to_numpy()
            for y in classes:
                counts.setdefault(y, np.zeros((len(spans), bins), np.int64))
            for i, span in enumerate(spans):
                b = np.zeros(len(code), np.int64)
                width = (span[1] - span[0]) / bins if span else 0.0
                if width > 0 or np.isnan(width):
                    column = batch.column(i)
                    place = np.floor((column.fill_null(0.0).to_numpy() - span[0]) / width)
                    b = np.minimum(np.where(np.isnan(place), 0.0, place), bins - 1).astype(np.int64)
                    b[column.is_null().to_numpy(zero_copy_only=False)] = bins - 1
                here = np.bincount(code * bins + b, minlength=len(classes) * bins).reshape(len(classes), bins)
                for y, n in zip(classes, here):
                    counts[y][i] += n
        rows = [(int(i), int(b), y, int(n[i, b])) for y, n in counts.items() for i, b in zip(*np.nonzero(n))]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), y_type, pa.int64()))], ["_i", "b", "y", "n"])

    return run


def mutual_information(df: DataFrame, features: list[str], y: str = "y", bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of each binned feature with the label.

    Bins are equal-width between the feature's extremes; every task counts its rows' cells
    column by column, and the counts are summed before anything else is computed.
    """
    numbers = df.select(*[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)], F.col(y).alias("y"))
    ends = numbers.drop("y").mapInArrow(_extremes(len(features)), "_i int, lo double, hi double").groupBy("_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = {r["_i"]: (r["lo"], r["hi"]) for r in ends.collect()}  # one row a feature
    kind = numbers.schema["y"].dataType
    binned = numbers.mapInArrow(
        _cells([found.get(i) for i in range(len(features))], bins, to_arrow_type(kind)), f"_i int, b long, y {kind.simpleString()}, n long"
    )
    counted = binned.groupBy("_i", "b", "y").agg(F.sum("n").alias("n"))
    cells = counted.select(F.array(*[F.lit(f) for f in features])[F.col("_i")].alias("feature"), "b", "y", "n")
    by_b = cells.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = cells.join(by_b, ["feature", "b"]).join(by_y, ["feature", "y"]).join(total, "feature")
    term = F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_k_best(df: DataFrame, features: list[str], k: int | None, y: str = "y") -> list[str]:
    """The k most informative features, in their original order."""
    if k is None or k >= len(features):
        return list(features)
    rows = mutual_information(df, features, y).orderBy(F.desc("mi"), "feature").limit(k).collect()
    best = {r["feature"] for r in rows}
    return [f for f in features if f in best]


def parity_report(train: DataFrame, serve: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: train and serve ranges, non-finite counts, and whether serving stays in range.

    A serving value may leave the training range by at most the training span.
    """

    def stats(df: DataFrame, tag: str) -> DataFrame:
        m = melt(df, features, [])
        ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
        v = F.when(ok, F.col("value"))
        return m.groupBy("feature").agg(F.min(v).alias(f"{tag}_min"), F.max(v).alias(f"{tag}_max"), F.count(F.when(~ok, 1)).alias(f"{tag}_bad"))

    j = stats(train, "train").join(stats(serve, "serve"), "feature")
    span = F.col("train_max") - F.col("train_min")
    inside = (F.col("serve_min") >= F.col("train_min") - span) & (F.col("serve_max") <= F.col("train_max") + span)
    return j.withColumn("aligned", inside & (F.col("serve_bad") == 0))
