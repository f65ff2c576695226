"""Point files: CSV with a header (Dim_0, Dim_1, ...), identifiers, text forms and results."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dominance import dimension_columns
from ..storage import Table

log = logging.getLogger("vantage")


def read_points_csv(spark: SparkSession, path: str, dims: Sequence[str] | None = None, id_col: str | None = "id", strict: bool = False) -> DataFrame:
    """(id, dimensions as doubles). Without dims, the columns Dim_*, or all columns if there are none.

    The header is dropped from every file. The id is the row's place in the input, files in the order of their names,
    from 0 and without gaps; id_col None leaves it out. A field that isn't a number is null, or with strict an error."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = list(dims) if dims else ([c for c in raw.columns if c.startswith("Dim_")] or raw.columns)
    cast = [F.col(f"`{c}`").cast("double") if strict else F.col(f"`{c}`").try_cast("double") for c in dimension_columns(raw, names)]
    if strict:
        cast = [F.when(F.col(f"`{n}`").isNotNull(), c).otherwise(F.raise_error(F.lit(f"no number in {n}"))) for n, c in zip(names, cast, strict=True)]
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")] if id_col else []
    rows = raw.select(*(c.alias(n) for n, c in zip(names, cast, strict=True)), *place)
    return _numbered(rows, id_col, ["__file", "__start"]) if id_col else rows


def with_row_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """df with ids 0, 1, 2, ... in the order of its partitions, without bringing rows together. df is evaluated once,
    and written to the shared folder: another evaluation may put its rows elsewhere."""
    return _numbered(df, id_col, [])


def _numbered(df: DataFrame, id_col: str, pieces: list[str]) -> DataFrame:
    """df without the columns in pieces, with ids in the order of these columns, or of its partitions. Rows of a piece lie
    next to each other in one partition; the counts of the pieces (a row each) give every piece's first id."""
    names = [c for c in df.columns if c not in pieces]
    table = Table(df.withColumn("__m", F.monotonically_increasing_id()), "numbered").df
    if not pieces:
        table, pieces = table.withColumn("__part", F.shiftright("__m", 33)), ["__part"]
    sizes = table.groupBy(*pieces).agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    before = F.sum("__n").over(W.orderBy(*pieces).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn("__first", F.coalesce(before, F.lit(0))).drop("__n")
    return table.join(starts, pieces).select((F.col("__first") + F.col("__m") - F.col("__low")).alias(id_col), *(F.col(f"`{c}`") for c in names))


def write_points_csv(points: DataFrame, path: str, dims: Sequence[str] | None = None) -> None:
    """A folder of CSV files with header Dim_0, Dim_1, ..."""
    names = dimension_columns(points, dims)
    points.select(*(F.col(c).cast("double").alias(f"Dim_{i}") for i, c in enumerate(names))).write.mode("overwrite").option("header", True).csv(path)


def point_text(id_col: str, dims: Sequence[str]) -> Column:
    """`id,x,y,...`"""
    return F.concat_ws(",", F.col(id_col), *(F.col(d).cast("double") for d in dims))


def box_text(cell_col: str, n_col: str, low: Sequence[str], high: Sequence[str]) -> Column:
    """`cell,count,low...,high...`"""
    return F.concat_ws(",", F.col(cell_col), F.col(n_col), *(F.col(c).cast("double") for c in (*low, *high)))


def node_text(node_col: str, leaf_col: str, n_col: str, entries: Column) -> Column:
    """`node|1 or 0|count|entry|entry|...`, where a leaf's entries are point texts and others' are box texts."""
    return F.concat_ws("|", F.col(node_col), F.col(leaf_col).cast("int"), F.col(n_col), entries)


def parse_node_text(text: Column, dims: int) -> Column:
    """struct(node, leaf, n, points, boxes) of a node's text; null if it has no three parts before its entries, or
    an entry isn't a point's (of a leaf) or a box's."""
    parts = F.split(text, r"\|")
    entries = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    leaf = F.get(parts, F.lit(1)) == "1"
    points = F.when(leaf, F.transform(entries, lambda e: parse_point_text(e, dims)))
    boxes = F.when(~leaf, F.transform(entries, lambda e: parse_box_text(e, dims)))
    found = F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("node"), leaf.alias("leaf"), F.get(parts, F.lit(2)).try_cast("long").alias("n"), points.alias("points"), boxes.alias("boxes"))
    broken = F.exists(F.coalesce(points, F.array().cast("array<struct<id:bigint,x:array<double>>>")), lambda x: x.isNull())
    broken |= F.exists(F.coalesce(boxes, F.array().cast("array<struct<cell:bigint,n:bigint,low:array<double>,high:array<double>>>")), lambda x: x.isNull())
    return F.when((F.size(parts) >= 3) & ~broken, found)


def parse_box_text(text: Column, dims: int) -> Column:
    """struct(cell, n, low, high) from `cell,count,low...,high...`; null if a part is missing."""
    parts = F.split(text, ",")
    numbers = lambda start: F.transform(F.slice(parts, start, dims), lambda s: s.try_cast("double"))
    found = F.struct(F.get(parts, F.lit(0)).try_cast("long").alias("cell"), F.get(parts, F.lit(1)).try_cast("long").alias("n"), numbers(3).alias("low"), numbers(3 + dims).alias("high"))
    return F.when(F.size(parts) == 2 + 2 * dims, found)


def parse_point_text(text: Column, dims: int) -> Column:
    """struct(id long, x array<double>) from `id,x,y,...`; null if a part is missing or isn't a number."""
    parts = F.split(text, ",")
    x = F.transform(F.slice(parts, 2, dims), lambda s: s.try_cast("double"))
    return F.when(F.size(parts) == dims + 1, F.struct(parts[0].try_cast("long").alias("id"), x.alias("x")))


def coordinate_key(dims: Sequence[str]) -> Column:
    """The coordinates as one string, for identity by value."""
    return F.concat_ws(",", *(F.col(d).cast("double").cast("string") for d in dims))


def format_result(rows: DataFrame, title: str, most: int = 100) -> str:
    """A result as text, its first rows; also sent to the log."""
    found = rows.limit(most + 1).collect()
    lines = [title, *(", ".join(map(str, r)) for r in found[:most]), *(["..."] if len(found) > most else [])]
    log.info("%s: %d rows%s", title, min(len(found), most), " and more" if len(found) > most else "")
    return "\n".join(lines)


def write_run_record(spark: SparkSession, record: dict, path: str) -> None:
    """A run's figures as one JSON document in a folder."""
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def plot_points(points: DataFrame, path: str, dims: Sequence[str] | None = None, most: int = 100_000) -> int:
    """Scatter plot of the first two dimensions of at most `most` rows; needs matplotlib. Returns the rows drawn."""
    import matplotlib.pyplot as plt

    a, b = dimension_columns(points, dims)[:2]
    rows = points.select(a, b).limit(most).toPandas()
    figure, axes = plt.subplots(layout="constrained")
    axes.plot(rows[a], rows[b], ".", markersize=2)
    axes.set(xlabel=a, ylabel=b)
    figure.savefig(path)
    plt.close(figure)
    return len(rows)
