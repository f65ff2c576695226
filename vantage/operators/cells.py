"""Cell summary: counts of points in a grid of quantile buckets, and the score bounds that follow from it.

It prunes exactly: a point dominates all points of the cells that are greater in every dimension, and
none outside the cells that are at least equal in every dimension.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most cells of a grid; the driver holds one count a cell.
MOST_CELLS = 32_768


def grid_dimensions(dims: int, most_cells: int = MOST_CELLS) -> int:
    """How many of the dimensions a grid is laid over: as many as can be halved within its cells."""
    return min(dims, most_cells.bit_length() - 1)


def buckets_per_dimension(dims: int, most_cells: int = MOST_CELLS) -> int:
    return max(2, min(128, int(most_cells ** (1 / grid_dimensions(dims, most_cells)) + 1e-9)))


def quantile_edges(points: DataFrame, xs: Sequence[str], buckets: int | None = None) -> list[list[float]]:
    """Ascending edges of each dimension; a value's bucket is the number of edges at or below it."""
    g = buckets or buckets_per_dimension(len(xs))
    found = points.approxQuantile(list(xs), [i / g for i in range(1, g)], 1 / (4 * g))
    return [sorted({float(e) for e in edges}) for edges in found]


def bucket(value: Column, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(0)
    total = F.lit(0)
    for e in edges:
        total = total + (value >= F.lit(float(e))).cast("int")
    return total


def cell_number(xs: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    number = F.lit(0)
    for x, e in zip(xs, edges, strict=True):
        number = number * (len(e) + 1) + bucket(F.col(x), e)
    return number


def cell_summary(points: DataFrame, xs: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """(cell, n, low_x.., high_x..): the occupied cells with their counts and the least boxes around their points."""
    return points.groupBy(cell_number(xs, edges).alias("cell")).agg(
        F.count("*").alias("n"), *(F.min(x).alias(f"low_{x}") for x in xs), *(F.max(x).alias(f"high_{x}") for x in xs)
    )


@dataclass
class Grid:
    """Counts of all cells of a grid, with bounds of the score of a point in each.

    The grid lies over the first dimensions if there are too many for all (complete is False then): points outside
    its cells that are at least equal still aren't dominated, but nothing is known to be dominated."""

    edges: list[list[float]]
    counts: np.ndarray  #: one dimension for each that the grid lies over
    complete: bool = True

    @property
    def lower(self) -> np.ndarray:
        """Points in cells greater in every dimension: all of them are dominated."""
        if not self.complete:
            return np.zeros_like(self.counts)
        out = self._suffix()
        for k in range(out.ndim):
            out = np.concatenate([np.take(out, range(1, out.shape[k]), axis=k), np.zeros_like(np.take(out, [0], axis=k))], axis=k)
        return out

    @property
    def upper(self) -> np.ndarray:
        """Points in cells at least equal in every dimension: no others are dominated."""
        return self._suffix()

    def _suffix(self) -> np.ndarray:
        out = self.counts
        for k in range(out.ndim):
            out = np.flip(np.cumsum(np.flip(out, k), axis=k), k)
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Flat cell numbers of points."""
        return np.ravel_multi_index(tuple(self.buckets(x).T.astype(np.int64)), self.counts.shape)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(np.asarray(e), x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.int16)


def histogram(points: DataFrame, xs: Sequence[str], edges: list[list[float]]) -> np.ndarray:
    """Points in every cell: each task counts its own, then the counts are summed up by cell."""
    shape = [len(e) + 1 for e in edges]
    grid = Grid(edges, np.zeros(shape, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            total += np.bincount(grid.cells(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in points.select(*xs).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
        out[r["cell"]] = r["n"]
    return out.reshape(shape)


def build_grid(points: DataFrame, xs: Sequence[str], buckets: int | None = None) -> Grid:
    over = list(xs)[: grid_dimensions(len(xs))]
    edges = quantile_edges(points, over, buckets)
    return Grid(edges, histogram(points, over, edges), len(over) == len(xs))


def check_summary(cells: DataFrame, points: DataFrame, xs: Sequence[str], edges: Sequence[Sequence[float]], id_col: str | None = None) -> list[str]:
    """What is wrong with a summary of points: cells whose count or box isn't that of their points, cells that are
    missing or empty, repeated ids. An empty list says that all is well."""
    own = cell_summary(points, xs, edges)
    names = [c for c in own.columns if c != "cell"]
    mine = own.select("cell", F.struct(*names).alias("__own"))
    theirs = cells.select("cell", F.struct(*names).alias("__stored"))
    both = mine.join(theirs, "cell", "full")
    wrong = both.where(~F.col("__own").eqNullSafe(F.col("__stored")))
    found = [f"cell {r['cell']}: {r['__stored']} is stored, {r['__own']} is right" for r in wrong.orderBy("cell").limit(10).collect()]
    if id_col:
        twice = points.groupBy(id_col).count().where("count > 1").orderBy(id_col).limit(10).collect()
        found += [f"id {r[0]} stands {r[1]} times" for r in twice]
    return found


def _ends(rows: DataFrame, xs: Sequence[str], low: str = "{}", high: str = "{}", n: Column | None = None) -> tuple:
    return tuple(rows.agg(F.count("*") if n is None else n, *(F.min(low.format(x)) for x in xs), *(F.max(high.format(x)) for x in xs)).first())


class CellIndex:
    """A cell summary kept in a folder, to be used again by later runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/edges/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save(self, points: DataFrame, xs: Sequence[str], edges: Sequence[Sequence[float]] | None = None) -> DataFrame:
        edges = edges or quantile_edges(points, xs)
        cell_summary(points, xs, edges).write.mode("overwrite").parquet(f"{self.path}/cells")
        meta = json.dumps({"dims": list(xs), "edges": [list(e) for e in edges]})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/edges")
        return self.load()[0]

    def load(self) -> tuple[DataFrame, list[str], list[list[float]]]:
        meta = json.loads(self.spark.read.text(f"{self.path}/edges").first()[0])
        return self.spark.read.parquet(f"{self.path}/cells"), meta["dims"], meta["edges"]

    def load_or_build(self, points: DataFrame, xs: Sequence[str], reset: bool = False) -> DataFrame:
        """The stored summary; built anew with reset, or if there is none, or if it is of other dimensions or of other
        points, as their number and the ends of their coordinates tell."""
        if not reset and self.exists():
            cells, dims, _ = self.load()
            if dims == list(xs) and _ends(points, xs) == _ends(cells, xs, "low_{}", "high_{}", F.sum("n")):
                return cells
        return self.save(points, xs)

    def within(self, low: Sequence[float], high: Sequence[float]) -> DataFrame:
        """The stored cells whose boxes touch the box from low to high; the filter reaches the Parquet scan."""
        cells, dims, _ = self.load()
        for x, a, b in zip(dims, low, high, strict=True):
            cells = cells.where((F.col(f"low_{x}") <= float(b)) & (F.col(f"high_{x}") >= float(a)))
        return cells

    def delete(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
