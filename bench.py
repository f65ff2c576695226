"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

lineitem, orders and embeddings are read from the tables; the gen_* queries run over 100,000 generated points
of the published settings (four distributions, 2 to 5 dimensions, k = 10), data generation included.
"""

from __future__ import annotations

import json
import os
import time

from vantage.operators.skyline import skyline
from vantage.operators.topk import topk_dominating, topk_skyline
from vantage.plans import catalogue
from vantage.session import local_session
from vantage.sources.generators import generate

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
TABLES = ("skyline_lineitem_2d", "skyline_lineitem_4d", "skyline_part_2d", "topk_dominating_orders", "topk_skyline_orders", "topk_dominating_part", "topk_skyline_embeddings")
#: Settings of the published point files: rho of the anticorrelated ones by dimensions, mean and range.
ANTI_RHO = {2: 0.95, 3: 0.45, 4: 0.29, 5: 0.2}
SETTINGS = {"uniform": {"low": 0.0, "high": 100.0}, "normal": {"mean": 10.0}, "correlated": {"rho": 0.5}, "anticorrelated": {}}


def main() -> None:
    spark = local_session(CPUS, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    q = catalogue.queries()
    work = {name: (lambda name=name: q[name](spark, SF)) for name in TABLES}
    for kind, setting in SETTINGS.items():
        for d in (2, 3, 4, 5):
            options = setting | ({"rho": ANTI_RHO[d]} if kind == "anticorrelated" else {})
            points = lambda kind=kind, d=d, options=options: generate(spark, kind, 100_000, d, 42, partitions=CPUS, **options)
            work[f"gen_q1_{kind}_{d}d"] = lambda points=points: skyline(points())
            work[f"gen_q2_{kind}_{d}d"] = lambda points=points: topk_dominating(points(), 10)
            work[f"gen_q3_{kind}_{d}d"] = lambda points=points: topk_skyline(points(), 10)
    q["skyline_part_2d"](spark, SF).count()  # warm-up
    seconds = {}
    for name, f in work.items():
        began = time.time()
        f().collect()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
