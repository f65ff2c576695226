"""Dominance scores: how many points a point dominates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dominance import all_of, dominates
from ..storage import Table
from . import kernels
from .cells import Grid, bucket, build_grid, cell_number
from .points import as_points

#: Most candidates that are broadcast, and counted for, at a time; rows of either side that a task compares at once.
BLOCK, CHUNK = 10_000, 20_000
#: Fewer candidates than this are compared with all points; the summary that would spare it costs more.
SMALL = 1_000
#: Most rows whose pairs are made.
PAIR_ROWS = 20_000


def partial_counts(candidates: np.ndarray, points: DataFrame, xs: Sequence[str], grid: Grid | None) -> tuple[DataFrame, Broadcast]:
    """(k, n): for candidate k, the dominated points of each task. With a grid, only of the points that share a
    bucket with it in some dimension; the others follow from the grid's counts. The broadcast is to be destroyed
    when the counts have been read."""
    spark = points.sparkSession
    held = spark.sparkContext.broadcast((candidates, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, g = held.value
        cb = g.buckets(c) if g else None
        total = np.zeros(len(c), np.int64)
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            total += kernels.count_dominated(c, x, cb, g.buckets(x) if g else None)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    return points.select(*xs).mapInArrow(run, "k long, n long"), held


def exact_scores(candidates: np.ndarray, points: DataFrame, xs: Sequence[str], grid: Grid | None) -> np.ndarray:
    """Scores of at most BLOCK candidates against all points: counted where the points are, summed up by candidate."""
    out = np.zeros(len(candidates), np.int64)
    grid = grid if grid is not None and grid.complete else None
    if grid is not None:
        out += grid.lower[tuple(grid.buckets(candidates).T.astype(np.int64))]
    counts, held = partial_counts(candidates, points, xs, grid)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] += r["n"]
    held.destroy()
    return out


def blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of at most size; the driver holds one list and the partition it comes from."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _by_slabs(mine: DataFrame, points: DataFrame, xs: list[str], chunk: int) -> DataFrame:
    """(__k, score) of every row of mine (__k, coordinates); no row passes through the driver.

    A slab is a bucket of one dimension. Candidates meet the points of their slabs only, and a pair of rows that share
    several slabs counts in that of the first dimension. Both sides of a slab are dealt into chunks by their numbers,
    however many rows are equal, and every pair of chunks is a task of its own, of bounded memory. What shares no slab
    with a candidate is dominated whole if its cell is greater in every dimension, as the grid's counts say. Over too
    many dimensions for a grid there is one slab of all rows."""
    grid = build_grid(points, xs)
    spark, d = points.sparkSession, len(xs) if grid.complete else 1
    sizes = [len(e) + 1 for e in grid.edges] if grid.complete else [1]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    shared = grid if grid.complete else Grid([[]], np.zeros(1, np.int64))
    lower = shared.lower.ravel()

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row once for each dimension, with the slab's number; the first row has what the cell is sure to dominate."""
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in xs])
            b = shared.buckets(x).astype(np.int64) if grid.complete else np.zeros((len(x), 1), np.int64)
            sure = lower[shared.cells(x)] if grid.complete else np.zeros(len(x), np.int64)
            for k in range(d):
                own = pa.array(sure if k == 0 else np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base[k] + b[:, k]), own], [*batch.schema.names, "slab", "sure"])

    def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        schema = T.StructType([*rows.schema.fields, T.StructField("slab", T.LongType()), T.StructField("sure", T.LongType())])
        found = Table(rows.mapInArrow(slabs, schema), "slabs").df
        chunks = found.groupBy("slab").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))  # a row a slab
        return found, Table(chunks, "slab-chunks").df

    numbered = points.select(F.monotonically_increasing_id().alias("__k"), *xs)
    (c, c_chunks), (p, p_chunks) = dealt(mine), dealt(numbered)
    both = F.broadcast(c_chunks.withColumnRenamed("chunks", "__c").join(p_chunks.withColumnRenamed("chunks", "__p"), "slab"))  # 15 * 128 rows at most
    mix = lambda own, n: F.pmod(F.xxhash64(F.lit(own), F.col("__k")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = c.join(both, "slab").select("__k", *xs, "slab", mix("c", "__c").alias("i"), every("__p").alias("j"))
    right = p.join(both, "slab").select(*xs, "slab", every("__c").alias("i"), mix("p", "__p").alias("j"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"__k": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y = (np.column_stack([t[name].to_numpy() for name in xs]) for t in (a, b))
        first = int(np.searchsorted(base, a["slab"][0].as_py(), "right")) - 1 if grid.complete else 0
        n = kernels.count_in_slab(x, y, shared.buckets(x) if first else None, shared.buckets(y) if first else None, first)
        at = np.flatnonzero(n)
        return pa.table({"__k": a["__k"].combine_chunks().take(pa.array(at)), "n": pa.array(n[at])})

    keys = ("slab", "i", "j")
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, "__k long, n long")
    return counted.union(c.select("__k", "sure")).groupBy("__k").agg(F.sum("n").alias("score"))


def dominance_score(
    df: DataFrame, dims: Sequence[str] | None = None, id_col: str = "id", candidates: DataFrame | None = None, direction: Mapping[str, str] | None = None
) -> DataFrame:
    """(id, score) of every candidate (default: every row of df); the score counts the rows of df it dominates.

    Up to BLOCK candidates are broadcast and counted for in one pass over df. More stay where they are and meet the
    points that share a slab of the grid with them, in chunks of bounded size. A point that dominates nothing has score
    0. Rows with a null or NaN in a dimension are dropped. With as many candidates as points the work is quadratic at
    worst; the grid's counts spare most of it.
    """
    points, xs = as_points(df, dims, direction)
    mine, _ = as_points(df if candidates is None else candidates, dims, direction, id=id_col)
    spark, kind = df.sparkSession, mine.schema["id"]
    few = mine.limit(BLOCK + 1).collect()  # bounded
    if len(few) <= BLOCK:
        scores = exact_scores(np.array([[r[x] for x in xs] for r in few], float).reshape(-1, len(xs)), points, xs, None if len(few) < SMALL else build_grid(points, xs)) if few else []
        return spark.createDataFrame([(r["id"], int(s)) for r, s in zip(few, scores, strict=True)], _schema(kind, id_col))
    rows = Table(mine.select(F.monotonically_increasing_id().alias("__k"), "id", *xs), "candidates").df
    scored = _by_slabs(rows.select("__k", *xs), points, xs, CHUNK)
    return rows.select("__k", "id").join(scored, "__k").select(F.col("id").alias(id_col), F.col("score").cast("long").alias("score"))


def _schema(kind, id_col: str):
    return T.StructType([T.StructField(id_col, kind.dataType), T.StructField("score", T.LongType())])


def dominated_by_count(df: DataFrame, dims: Sequence[str] | None = None, id_col: str = "id", direction: Mapping[str, str] | None = None) -> DataFrame:
    """(id, score): how many rows dominate each row; the scores of the mirrored points."""
    points, xs = as_points(df, dims, direction, **{id_col: id_col})
    return dominance_score(points, xs, id_col, direction=dict.fromkeys(xs, "max"))


def score_pairs(df: DataFrame, dims: Sequence[str] | None = None, id_col: str = "id", direction: Mapping[str, str] | None = None, most: int = PAIR_ROWS) -> DataFrame:
    """(id, other): every pair in which id dominates other, by a theta join; an error for more than `most` rows."""
    a, xs = as_points(df, dims, direction, id=id_col)
    if a.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: all pairs are for small inputs; score_by_join and dominance_score count them for large ones")
    b = F.broadcast(a.select(F.col("id").alias("other"), *(F.col(x).alias(f"y{x}") for x in xs)))  # counted
    return a.join(b, dominates([F.col(x) for x in xs], [F.col(f"y{x}") for x in xs])).select(F.col("id").alias(id_col), "other")


def score_by_join(df: DataFrame, dims: Sequence[str] | None = None, id_col: str = "id", direction: Mapping[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(id, score) of every row without a null or NaN in a dimension, by a theta join of however many rows.

    Places (distinct points, with the number of their rows) are joined by slabs, as in _by_slabs: a pair of places counts in
    the first dimension in which both share a bucket, and the grid's counts tell of those that share none. One side of
    a slab is dealt into parts of about `chunk` places, each of which meets the whole other side."""
    rows, xs = as_points(df, dims, direction, id=id_col)
    points = Table(rows, "join-points").df
    spark, grid = df.sparkSession, build_grid(points, xs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bs = [f"b{i}" for i in range(len(xs))] if grid.complete else []  # over too many dimensions for a grid there is one slab
    places = points.groupBy(*xs).agg(F.count("*").alias("rows"))
    marked = places.select(*xs, "rows", *(bucket(F.col(x), e).alias(b) for b, x, e in zip(bs, xs, grid.edges, strict=False)))
    slabs = [F.struct(F.lit(k).alias("k"), F.col(b).alias("slab")) for k, b in enumerate(bs)] or [F.struct(F.lit(0).alias("k"), F.lit(0).alias("slab"))]
    found = Table(marked.withColumn("at", F.explode(F.array(*slabs))).select(*xs, "rows", *bs, "at.k", "at.slab"), "place-slabs").df
    parts = F.broadcast(Table(found.groupBy("k", "slab").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "place-parts").df)  # 15 * 128 rows at most
    keys = ["k", "slab", "part"]
    a = found.join(parts, ["k", "slab"]).select(*keys[:2], *xs, *bs, F.pmod(F.xxhash64(*xs), "parts").cast("int").alias("part")).repartition(n, *keys)
    b = found.join(parts, ["k", "slab"]).select(*keys[:2], "rows", *(F.col(c).alias(f"y{c}") for c in xs + bs), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = [(F.col("k") <= i) | (F.col(c) != F.col(f"y{c}")) for i, c in enumerate(bs)]
    pairs = a.join(b, keys).where(all_of([dominates([F.col(x) for x in xs], [F.col(f"y{x}") for x in xs]), *first]))
    counted = pairs.select(*xs, F.col("rows").alias("n"))
    if grid.complete:
        lower = grid.lower.ravel()
        sure = spark.createDataFrame([(int(c), int(lower[c])) for c in np.flatnonzero(lower)], "cell long, n long")
        own = found.where("k = 0").select(*xs, cell_number(xs, grid.edges).cast("long").alias("cell"))
        counted = counted.union(own.join(F.broadcast(sure), "cell").select(*xs, "n"))  # a row a cell
    scores = Table(counted.groupBy(*xs).agg(F.sum("n").alias("score")), "place-scores").df
    return points.join(scores, xs, "left").select(F.col("id").alias(id_col), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
