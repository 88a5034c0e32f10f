"""Time-ordered splits, row caps and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.scale import number_rows


def _sized(df: DataFrame, order: list[str]) -> DataFrame:
    total = df.count()
    return number_rows(df, order, "row_no", total=total).withColumn("_n", F.lit(total).cast("long"))


def purged_folds(df: DataFrame, order: list[str], n_folds: int = 5, gap: int = 0) -> DataFrame:
    """Expanding folds: a row trains folds from ``train_from`` on and tests at most one.

    Fold k trains on the first k slices and tests on the slice that starts ``gap``
    rows later.
    """
    s = _sized(df, order)
    size, rn = F.floor(F.col("_n") / (n_folds + 1)), F.col("row_no")
    k = F.floor((rn - gap) / F.greatest(size, F.lit(1)))
    in_test = (rn >= size + gap) & (k >= 1) & (k <= n_folds) & (size > 0)
    first_train = F.floor(rn / F.greatest(size, F.lit(1))) + 1
    return s.withColumns(
        {
            "test_fold": F.when(in_test, k).cast("int"),
            "train_from": F.when((first_train <= n_folds) & (size > 0), first_train).cast("int"),
        }
    ).drop("_n")


def holdout_split(df: DataFrame, order: list[str], fraction: float = 0.2) -> DataFrame:
    """role: train, then a calibration half and a test half of the newest rows."""
    s = _sized(df, order)
    hold = F.greatest(F.floor(F.col("_n") * fraction), F.lit(1))
    test = hold - F.floor(hold / 2)
    role = F.when(F.col("row_no") < F.col("_n") - hold, "train").when(F.col("row_no") < F.col("_n") - test, "calibrate").otherwise("test")
    return s.withColumn("role", role).drop("_n")


def newest_rows(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The last ``cap`` rows by time."""
    return _sized(df, order).filter(F.col("row_no") >= F.col("_n") - cap).drop("_n", "row_no")


def recency_weight(df: DataFrame, date: str, halflife_days: float) -> DataFrame:
    """0.5 ** (age / halflife) from the newest date; unknown dates get the smallest weight."""
    span = df.agg(F.max(date).alias("hi"), F.min(date).alias("lo"))
    hi, lo = span.select("hi").scalar(), span.select("lo").scalar()
    decay = lambda d: F.pow(F.lit(0.5), F.greatest(F.datediff(hi, d), F.lit(0)) / float(halflife_days))
    return df.withColumn("recency_weight", F.when(F.col(date).isNotNull(), decay(F.col(date))).otherwise(decay(lo)))


def class_weight(df: DataFrame, y: str = "y", recency: str | None = None) -> DataFrame:
    """Balanced class weights, scaled by recency and renormalised per class.

    The class totals are one row a class and sent to every task: a join on the class by a
    shuffle would leave the table in as many tasks as there are classes.
    """
    r = F.col(recency) if recency else F.lit(1.0)
    per = df.groupBy(F.col(y).alias("_c")).agg(F.count("*").alias("_m"), F.sum(r).alias("_s"))
    everything = Window.partitionBy()  # over one row per class
    per = per.withColumn("_each", F.sum("_m").over(everything) / F.count("*").over(everything))
    out = df.join(F.broadcast(per), F.col(y) == F.col("_c"))
    if recency:
        weight = F.when(F.col("_s") > 0, r * F.col("_each") / F.col("_s")).otherwise(0.0)
    else:
        weight = F.col("_each") / F.col("_m")
    return out.withColumn("sample_weight", weight).drop("_c", "_m", "_s", "_each")
