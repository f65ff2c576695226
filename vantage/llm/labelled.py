"""Choice of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from: crc32(id as text) mod 5 is 0. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, y), rows of each class in the whole table): at most per_class rows of either class, by
    a hash of the id, from the labelled rows that aren't held out. Rows with a null id or a label other
    than 0 or 1 are left out; a row that repeats counts again."""
    require(labels, id_col, label)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))
    )
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_class) for y in (0, 1)]
    return chosen[0].union(chosen[1]), {y: counts.get(y, 0) for y in (0, 1)}
