"""Replaying a table as date-ordered deliveries to a file stream, and running a stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.scale import ensure_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Drop a part of a ``work_folder`` that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def time_slices(df: DataFrame, time: str, cuts: list[str], heartbeat: dict | None = None) -> list[DataFrame]:
    """``df`` as consecutive time slices, oldest first, then a far later heartbeat row.

    The heartbeat moves the watermark past the data, as live traffic would.
    """
    parts = []
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(time) >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            part = part.filter(F.col(time) < F.lit(hi).cast("timestamp"))
        parts.append(part)
    if heartbeat:
        row = df.sparkSession.range(1).select(
            *[F.lit(heartbeat.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        )
        parts.append(row)
    return parts


def read_folder(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_slices(feeds: dict[str, list[DataFrame]], build: Callable[[], DataFrame], folder: str, each: Callable | None = None) -> str:
    """Deliver the slices of all ``feeds`` (input folder -> slices) one after another.

    After each delivery the stream of ``build`` is started from its checkpoint, takes all
    new files as one batch and stops, as a scheduled job would; a slice may have any
    number of files.  Returns the output path.
    """
    out = f"{folder}/out"
    for step in zip(*feeds.values(), strict=True):
        for path, part in zip(feeds, step):
            part.write.mode("append").parquet(path)
        out = run_to_end(build(), folder, each=each)
    return out


def run_to_end(df: DataFrame, folder: str, mode: str = "append", each: Callable | None = None, timeout: int | None = None) -> str:
    """Run a stream over everything available; returns the output path.

    Without ``timeout`` (seconds) it may take as long as its input needs.
    """
    out = f"{folder}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", out)
    q: StreamingQuery = writer.start()
    try:
        if timeout is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout):
            raise TimeoutError(f"stream did not finish in {timeout}s")
    finally:
        q.stop()
    return out
