"""Synthetic points, made where they are needed: normal, uniform, correlated and anticorrelated."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("normal", "uniform", "correlated", "anticorrelated")


def covariance(kind: str, rho: float, dims: int) -> np.ndarray:
    """Ones on the diagonal, rho (or, anticorrelated, -rho) elsewhere; must be positive definite."""
    if kind == "anticorrelated":
        if dims > 1 and not 0 <= rho < 1 / (dims - 1):
            raise ValueError(f"rho must be at least 0 and below 1/(dims-1) = {1 / (dims - 1):.4g}")
        if dims == 1:
            raise ValueError("anticorrelated points need two dimensions or more")
    sign = -1.0 if kind == "anticorrelated" else 1.0
    found = (1 - sign * rho) * np.eye(dims) + sign * rho
    if np.linalg.eigvalsh(found).min() <= 0:
        raise ValueError("the covariance is not positive definite; choose another rho")
    return found


def generate(
    spark: SparkSession,
    kind: str = "normal",
    n: int = 100,
    dims: int = 2,
    seed: int = 42,
    mean: float = 0.0,
    std: float = 1.0,
    low: float = 0.0,
    high: float = 1.0,
    rho: float = 0.5,
    partitions: int | None = None,
) -> DataFrame:
    """(id, Dim_0, Dim_1, ...) with n rows. Correlated and anticorrelated points are shifted by their least
    coordinate, so that none is negative. The same seed and partitions give the same points."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if dims < 1 or n < 0:
        raise ValueError("dims must be 1 or more and n 0 or more")
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    names = [f"Dim_{i}" for i in range(dims)]
    if kind == "normal":
        return rows.select("id", *((F.randn(seed + i) * std + mean).alias(c) for i, c in enumerate(names)))
    if kind == "uniform":
        return rows.select("id", *((F.rand(seed + i) * (high - low) + low).alias(c) for i, c in enumerate(names)))
    factor = np.linalg.cholesky(covariance(kind, rho, dims))
    drawn = rows.select("id", *(F.randn(seed + i).alias(f"__z{i}") for i in range(dims)))
    mixed = drawn.select("id", *(sum((F.col(f"__z{j}") * float(factor[i, j]) for j in range(1, i + 1)), F.col("__z0") * float(factor[i, 0])).alias(c) for i, c in enumerate(names)))
    ends = mixed.agg(*(F.min(c) for c in names)).first()
    shift = min((e for e in ends if e is not None), default=0.0)
    return mixed.select("id", *((F.col(c) - F.lit(float(shift))).alias(c) for c in names))


def main(argv: Sequence[str] | None = None) -> None:
    from ..session import local_session
    from .points import plot_points, write_points_csv

    p = argparse.ArgumentParser(description="Generate points and write them as CSV.")
    p.add_argument("--generator", choices=KINDS, default="normal")
    for name, kind, default in (("mean", float, 0.0), ("std_dev", float, 1.0), ("min_val", float, 0.0), ("max_val", float, 1.0), ("rho", float, 0.5), ("num_points", int, 100), ("num_dimensions", int, 2), ("seed", int, 42)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--output_file", default="output.csv")
    p.add_argument("--plot", action="store_true", help="also draw the first two dimensions")
    a = p.parse_args(argv)
    points = generate(local_session(), a.generator, a.num_points, a.num_dimensions, a.seed, a.mean, a.std_dev, a.min_val, a.max_val, a.rho)
    write_points_csv(points, a.output_file)
    if a.plot:
        plot_points(points, f"{a.output_file}_image.png")


if __name__ == "__main__":
    main()
