"""Helpers that keep keyed work bounded when one key holds much of the data.

Windows, folds and numberings are planned per key.  A key whose rows exceed
``spark.terrace.maxRowsPerGroup`` is cut into ordered segments first, so no task
ever sorts or folds more than that many rows of it.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS_CONF = "spark.terrace.maxRowsPerGroup"
MAX_ROWS_DEFAULT = 2_000_000
#: Rows of a slice of a numbered table at most, about (a training table has 95 doubles a row), and at least where there are more cores.
SLICE_ROWS, LEAST_SLICE_ROWS = 50_000, 4_000


def max_rows_per_group(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back only for a local master.

    Checkpoints that nothing refers to any more are deleted, unless the session says otherwise.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrace-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage is cut and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Free the disk of steps whose results are written or checkpointed.

    Spark removes shuffle files, and checkpoints, once the driver has collected what refers to them;
    without being asked it may not do so before a job ends.
    """
    for _ in range(3):  # what refers to a plan goes some time before the plan itself; two times were too few in trials
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def hot_keys(df: DataFrame, keys: list[str], max_rows: int | None = None, weight: int = 1) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or None when no key can be that large.

    One map-side-combined count over the key columns decides, at every size.
    ``weight`` is how many units of the session's limit one row stands for.
    """
    if max_rows is None:
        max_rows = max(max_rows_per_group(df.sparkSession) // weight, 1)
    hot = df.groupBy(*keys).count().filter(F.col("count") > max_rows).drop("count")
    hot = checkpoint(hot)
    return None if hot.isEmpty() else hot


def ordered_slices(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and pin the slice number of every row."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))


_OPS = {"sum": F.sum, "max": F.max, "count": F.count}


def _merge(op: str, a: Column, b: Column) -> Column:
    if op == "max":
        return F.greatest(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def sliced_running(
    df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Exclusive running aggregates over a total order without a one-task window.

    Rows are range-partitioned on (keys, order); each slice runs its own window
    and adds the totals of the earlier slices.  The totals table has one row per
    (slice, key), so its own window is bounded by the number of slices.
    """
    sliced = ordered_slices(df, [F.col(c) for c in keys + order])
    own = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_slice", *keys).agg(*[_OPS[op](e).alias(f"_t_{n}") for n, (op, e) in specs.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        F.col("_slice"),
        *keys,
        *[("max" == op and F.max or F.sum)(f"_t_{n}").over(before).alias(f"_p_{n}") for n, (op, _) in specs.items()],
    )
    inner = sliced.select("*", *[_OPS[op](e).over(own).alias(f"_r_{n}") for n, (op, e) in specs.items()])
    joined = inner.join(prefix, ["_slice", *keys])
    for n, (op, _) in specs.items():
        joined = joined.withColumn(n, _merge(op, F.col(f"_r_{n}"), F.col(f"_p_{n}")))
    drop = ["_slice"] + [f"_r_{n}" for n in specs] + [f"_p_{n}" for n in specs]
    return joined.drop(*drop)


def number_rows(df: DataFrame, order: list[str], name: str = "row_no", keys: list[str] | None = None, total: int | None = None) -> DataFrame:
    """0-based position of each row in the total order, without one global sort task.

    Without ``keys`` the rows are shuffled once, into as many slices as their number ``total`` asks for where it is
    given; a slice numbers its own rows and adds the counts of the earlier ones, one row a slice.
    """
    if keys:
        return sliced_running(df, keys, order, {name: ("count", F.lit(1))})
    if total is None:
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:  # a fit runs hundreds of jobs over the slices: few of them for few rows
        slices = max(1, min(df.sparkSession.sparkContext.defaultParallelism, total // LEAST_SLICE_ROWS), -(-total // SLICE_ROWS))
    placed = df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # partition and place in it, pinned by the checkpoint
    placed = checkpoint(placed.withColumns({"_slice": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_slice").agg(F.count("*").alias("_n_here"))
    # every reader of the rows needs these few
    starts = checkpoint(starts.select("_slice", F.coalesce(F.sum("_n_here").over(before), F.lit(0)).alias("_before")))
    return placed.join(F.broadcast(starts), "_slice").withColumn(name, F.col("_at") + F.col("_before")).drop("_slice", "_at", "_before")


class KeyedWindow:
    """Ordered windows per key that stay bounded when a key is hot.

    ``halo`` is the longest trailing frame used.  Cold keys use one plain window.
    Hot keys are cut into segments of ``max_rows`` rows; the last ``halo`` rows of
    a segment are repeated at the head of the next, and running aggregates add
    the totals of the earlier segments.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], halo: int = 1, max_rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.part = list(keys)
        self.df = df
        hot = hot_keys(df, keys, max_rows)
        self.split = hot is not None
        if self.split:
            limit = max(max_rows or max_rows_per_group(df.sparkSession), halo + 1)
            cold = df.join(hot, keys, "left_anti").withColumn("_seg", F.lit(0).cast("long")).withColumn("_halo", F.lit(False))
            numbered = number_rows(df.join(hot, keys, "left_semi"), order, "_rn", keys)
            seg = F.floor(F.col("_rn") / limit)
            home = F.struct(seg.alias("seg"), F.lit(False).alias("halo"))
            spill = F.struct((seg + 1).alias("seg"), F.lit(True).alias("halo"))
            copies = F.when(F.col("_rn") % limit >= limit - halo, F.array(home, spill)).otherwise(F.array(home))
            cut = numbered.withColumn("_c", F.explode(copies)).withColumn("_seg", F.col("_c.seg")).withColumn("_halo", F.col("_c.halo"))
            self.df = cold.unionByName(cut.drop("_rn", "_c"))
            self.part = keys + ["_seg"]

    def trailing(self, n: int):
        return Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(-n, -1)

    def up_to_now(self, n: int):
        """The last ``n`` rows including the current one (needs halo >= n - 1)."""
        return Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(1 - n, 0)

    def ordered(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def with_columns(self, cols: dict[str, Column]) -> "KeyedWindow":
        self.df = self.df.select("*", *[c.alias(n) for n, c in cols.items()])
        return self

    def with_running(self, specs: dict[str, tuple[str, Column]]) -> "KeyedWindow":
        """Add exclusive running aggregates (sum, count or max) from the key's first row."""
        w = Window.partitionBy(*self.part).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        if not self.split:
            zero = {n: _OPS[op](e).over(w) for n, (op, e) in specs.items()}
            self.df = self.df.select(
                "*", *[(c if specs[n][0] == "max" else F.coalesce(c, F.lit(0))).alias(n) for n, c in zero.items()]
            )
            return self
        own = {n: (op, F.when(~F.col("_halo"), e)) for n, (op, e) in specs.items()}
        totals = self.df.groupBy(*self.part).agg(*[_OPS[op](e).alias(f"_t_{n}") for n, (op, e) in own.items()])
        before = Window.partitionBy(*self.keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        prefix = totals.select(
            *self.part, *[(F.max if op == "max" else F.sum)(f"_t_{n}").over(before).alias(f"_p_{n}") for n, (op, _) in own.items()]
        )
        inner = self.df.select("*", *[_OPS[op](e).over(w).alias(f"_r_{n}") for n, (op, e) in own.items()])
        joined = inner.join(prefix, self.part)
        for n, (op, _) in own.items():
            joined = joined.withColumn(n, _merge(op, F.col(f"_r_{n}"), F.col(f"_p_{n}")))
        self.df = joined.drop(*[f"_r_{n}" for n in own], *[f"_p_{n}" for n in own])
        return self

    def result(self) -> DataFrame:
        if not self.split:
            return self.df
        return self.df.filter(~F.col("_halo")).drop("_seg", "_halo")
