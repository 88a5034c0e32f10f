"""CSV files whose shape differs per file, as rows of header -> value.

Lines are read as text so that files can stay splittable; each file's own header
line then names its values.  One pass handles any mix of shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.scale import checkpoint

#: Files whose headers are sent to every task; with more of them lines meet their header by a shuffle.
MAX_SENT_HEADS = 100_000


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", spread: int | None = None) -> DataFrame:
    """(file, line_no, value) of text files.  ``spread`` redistributes unsplittable (gz) input."""
    reader = spark.read
    if encoding.upper() not in ("UTF-8", "UTF8"):
        reader = reader.option("encoding", encoding).option("header", False).option("quote", "").option("sep", "\u0001")
        lines = reader.schema("value string").csv(paths)
    else:
        lines = reader.text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.repartition(spread) if spread else lines


def _with_cells(df: DataFrame, line: str, width: int, out: str) -> DataFrame:
    """Cells of a line; lines without quotes are split directly, the rest go through the CSV parser.

    The parsed struct is its own column, so a line is parsed once and not once per cell.
    """
    schema = ", ".join(f"c{i} string" for i in range(width))
    quoted = F.col(line).contains('"')
    df = df.withColumn("_parsed", F.when(quoted, F.from_csv(line, schema)))
    fields = F.array(*[F.col(f"_parsed.c{i}") for i in range(width)])
    cells = F.when(quoted, fields).otherwise(F.split(line, ","))
    return df.withColumn(out, F.transform(cells, lambda c: F.trim(c))).drop("_parsed")


def headed_rows(lines: DataFrame, header_marker: str, width: int | None = None, file: str = "file") -> DataFrame:
    """Lines with ``row``: a map from the file's header names to this line's values.

    ``header_marker`` is a pattern only header lines match; of several in a file the one with the
    lowest line_no (without such a column: the smallest) names the values.  ``width``: cells that
    are read of a line with quotes; without it the headers are read first and
    the widest one's count is taken, so that no named cell is lost.
    """
    clean = lines.withColumn("value", F.regexp_replace("value", "^﻿|[\r\n]+$", "")).filter(F.trim("value") != "")
    is_header = F.col("value").rlike(header_marker)
    first = F.min_by("value", "line_no") if "line_no" in lines.columns else F.min("value")
    heads = clean.filter(is_header).groupBy(file).agg(first.alias("_head"))
    if width is None:
        width = (heads.agg(F.max(F.regexp_count("_head", F.lit(",")))).first()[0] or 0) + 1
    named = F.filter(
        F.transform("_cells", lambda c, i: F.struct(c.alias("name"), i.alias("at"))),
        lambda p: F.coalesce(p["name"], F.lit("")) != "",
    )
    heads = _with_cells(heads, "_head", width, "_cells").select(file, named.alias("_all"))
    # A name printed twice keeps its last column.
    last = F.filter("_all", lambda p: ~F.exists("_all", lambda q: (q["name"] == p["name"]) & (q["at"] > p["at"])))
    heads = checkpoint(heads.select(file, last.alias("_cols")).select(file, F.col("_cols.name").alias("_names"), F.col("_cols.at").alias("_at")))
    # One row a file: sent to every task, so that the lines of a large file stay where they were read.
    few = heads.limit(MAX_SENT_HEADS + 1).count() <= MAX_SENT_HEADS
    body = _with_cells(clean.filter(~is_header), "value", width, "_vals").join(F.broadcast(heads) if few else heads, file)
    values = F.transform("_at", lambda i: F.get(F.col("_vals"), i))
    return body.withColumn("row", F.map_from_arrays("_names", values)).drop("_vals", "_names", "_at", "value")


def value(name: str, row: str = "row") -> Column:
    """A header's value; empty text when the file does not have it."""
    return F.coalesce(F.try_element_at(F.col(row), F.lit(name)), F.lit(""))


def has(name: str, row: str = "row") -> Column:
    return F.map_contains_key(F.col(row), F.lit(name))


def path_season_league(pattern: str = r"(\d{4}-\d{2})_(?:\w+_)?([a-z]+\.\d)", file: str = "file") -> dict[str, Column]:
    """Season and league code from file names such as ``2023-24_eng.1.csv``."""
    path = F.col(file)
    return {"season": F.regexp_extract(path, pattern, 1), "feed_code": F.regexp_extract(path, pattern, 2)}
