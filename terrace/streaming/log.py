"""The forecast log as streams: dedupe, settle, rolling scores, idempotent append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators import forecast_log, match_rows, metrics


def dedupe(records: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def settle(forecasts: DataFrame, results: DataFrame, horizon: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Forecasts joined to the result that follows within the horizon; unmatched ones stay pending.

    ``forecasts`` has match_id, logged_at and probabilities; ``results`` has match_id,
    finished_at and scores.  The time bound lets Spark drop old state on both sides.
    """
    f = forecasts.withWatermark("logged_at", delay).alias("f")
    r = results.filter("home_score is not null and away_score is not null").withWatermark("finished_at", delay).alias("r")
    near = (F.col("r.finished_at") >= F.col("f.logged_at")) & (F.col("r.finished_at") <= F.col("f.logged_at") + F.expr(f"interval {horizon}"))
    joined = f.join(r, (F.col("f.match_id") == F.col("r.match_id")) & near, "left_outer")
    hit = F.col("r.match_id").isNotNull()
    label = match_rows.result_label(F.col("r.home_score"), F.col("r.away_score"))
    return joined.select(
        "f.*",
        F.when(hit, "settled").otherwise("pending").alias("status"),
        F.when(hit, label).alias("actual"),
        F.when(hit, F.concat_ws("-", "r.home_score", "r.away_score")).alias("actual_score"),
        F.col("r.finished_at").alias("settled_at"),
    )


def _panes(settled: DataFrame, size: str, delay: str, league: str) -> DataFrame:
    """Counts, hits and summed RPS per league and tumbling settlement window."""
    y = metrics.label_class(F.col("actual"))
    hit = F.when(metrics.pick_label() == F.col("actual"), 1).otherwise(0)
    known = settled.withWatermark("settled_at", delay).filter(F.col("actual").isNotNull())
    sums = [F.count("*").alias("n"), F.sum(hit).alias("hits"), F.sum(metrics.rps(y)).alias("rps")]
    return known.groupBy(F.window("settled_at", size), league).agg(*sums)


def _means(sums: DataFrame, league: str) -> DataFrame:
    return sums.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), league, "n",
        (F.col("hits") / F.col("n")).alias("accuracy"), (F.col("rps") / F.col("n")).alias("rps"),
    )


def rolling_score(settled: DataFrame, size: str = "1 day", delay: str = "1 day", league: str = "competition") -> DataFrame:
    """Accuracy and RPS per league over tumbling settlement windows."""
    return _means(_panes(settled, size, delay, league), league)


def sliding_score(settled: DataFrame, span: str = "7 days", pane: str = "1 day", delay: str = "1 day", league: str = "competition") -> DataFrame:
    """Accuracy and RPS per league over windows of ``span`` that move on by a ``pane``.

    Two stateful steps: records are summed to panes once, and closed panes are added to
    the windows that hold them, so a record is never copied into every window.  A window
    appears once the watermark has passed its end.
    """
    panes = _panes(settled, pane, delay, league)
    slid = panes.groupBy(F.window(F.window_time("window"), span, pane), league)
    return _means(slid.agg(*[F.sum(c).alias(c) for c in ("n", "hits", "rps")]), league)


def append_once(path: str):
    """A foreachBatch sink that never logs a match id twice, also when a batch is retried.

    Only a log that is not there yet counts as empty; any other failure to read it ends the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        try:
            log = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = spark.createDataFrame([], "match_id long")
        forecast_log.append_new(log, batch).write.mode("append").parquet(path)

    return write
