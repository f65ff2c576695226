"""Connected components of a large edge table by alternating stars (Kiveris et al., SOCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _large_star(e: DataFrame) -> Table:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written down, as Spark splits a node of many edges in a join only without an aggregation in its stage
    least = Table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    out = Table(both.join(least.df.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star-large")
    least.drop()
    return out


def _small_star(e: DataFrame) -> Table:
    least = Table(e.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = e.join(least.df.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = Table(moved.union(least.df.select("u", F.col("m").alias("v"))).distinct(), "stars")
    least.drop()
    return out


def star_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) for each node u that isn't the smallest of its component; v is that smallest node.

    edges: (u long, v long), any order, loops and repeats allowed, no nulls. Every round is written to
    the shared folder, so the plan stays short; the driver sees two numbers a round.
    """
    now = Table(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars"
    )

    def state(t: Table) -> tuple:
        row = t.df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            return now.df
        large = _large_star(now.df)
        now.drop()
        new = _small_star(large.df)
        large.drop()
        now, after = new, state(new)
        if after == before:
            return now.df
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
