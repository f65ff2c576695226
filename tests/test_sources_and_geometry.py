"""Geometry constants, point files, generators, stored summaries, runs, streams and the entry points."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from vantage.functions import geometry as G
from vantage.operators import cells
from vantage.operators.skyline import skyline
from vantage.plans import run as runs
from vantage.sources import generators
from vantage.sources import points as P
from vantage.streaming.skyline import maintain_skyline


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(xs):
    return [F.lit(float(x)) for x in xs]


def box(a, b):
    return lits(a), lits(b)


@pytest.mark.parametrize(
    ("a", "b", "area"),
    [
        ((2.2, 3.0), (3.1, 0.2), 2.52),
        ((-0.2, 3.0), (3.1, -1.3), 14.19),
        ((2.2, 3.0, -0.6), (3.1, 0.2, 1.8), 6.048),
        ((-2.2, -3.0, -0.6), (3.1, 0.2, -1.8), 20.352),
        ((2.2, 3.0, -0.6, -0.7), (3.1, 0.2, 1.8, 1.48), 13.18464),
        ((-2.2, 3.0, -0.6, -0.7, 2.7), (3.1, 0.2, -1.8, 1.48, 4.2), 58.23216),
    ],
)
def test_areas(spark, a, b, area):
    assert value(spark, G.area(box(a, b))) == pytest.approx(area, abs=1e-9)


@pytest.mark.parametrize(
    ("a", "b", "square"), [((0,), (3,), 9), ((-1,), (3,), 16), ((1.2, 3.0), (2.5, 4.7), 4.58), ((0.5, -3.2, 7, -2.7), (2.2, -6.1, -0.2, 3.1), 96.78)]
)
def test_distances(spark, a, b, square):
    assert value(spark, G.l2(lits(a), lits(b))) == pytest.approx(math.sqrt(square), abs=1e-9)


def test_boxes(spark):
    one, two = box((0.08, 0.362), (0.284, 0.53)), box((0.282, 0.12), (0.43, 0.364))
    assert value(spark, G.overlaps(one, two)) and value(spark, G.overlaps(two, one))
    assert value(spark, G.overlap_area(one, two)) == pytest.approx(0.002 * 0.002, abs=1e-12)
    far = box((5, 5), (6, 7))
    assert value(spark, G.overlap_area(one, far)) == 0.0 and value(spark, G.overlap_box(one, far)) is None
    assert list(value(spark, G.overlap_box(far, box((5.5, 0), (9, 6)))).low) == [5.5, 5.0]
    assert value(spark, G.perimeter(far)) == 6.0 and value(spark, G.perimeter(box((0, 0, 0), (1, 2, 3)))) == 24.0
    assert value(spark, G.l2_to_box(lits((2, 1)), far)) == 5.0 and value(spark, G.l2_to_box(lits((5.5, 6)), far)) == 0.0
    assert value(spark, G.distance_from_centre(lits((5.5, 9)), far)) == 3.0
    assert value(spark, G.l1(lits((-2, 3)))) == 5.0
    assert not value(spark, G.contains_point(far, lits((5, 6)))) and value(spark, G.contains_point(far, lits((5.5, 6))))
    assert value(spark, G.contains_box(far, box((5.1, 5.1), (5.9, 6.9)))) and not value(spark, G.contains_box(far, far))
    low, high = G.expand(far, lits((4, 8)))
    assert value(spark, low[0]) == pytest.approx(4 - 1e-5) and value(spark, high[1]) == pytest.approx(8 + 1e-5)
    assert value(spark, G.area((lits((1,)), G.dominance_area(lits((1,)))[1]))) > 1e300


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "points")
    points = generators.generate(spark, "uniform", 50, 3, 1, low=-5, high=5, partitions=3)
    P.write_points_csv(points, path)
    back = P.read_points_csv(spark, path)
    assert back.columns == ["id", "Dim_0", "Dim_1", "Dim_2"]
    assert sorted(r["id"] for r in back.collect()) == list(range(50))
    assert back.agg(F.sum("Dim_1")).first()[0] == pytest.approx(points.agg(F.sum("Dim_1")).first()[0])
    bad = tmp_path / "bad.csv"
    bad.write_text("Dim_0,Dim_1\n 1.5 , 2\nx,3\n,4\n")
    rows = P.read_points_csv(spark, str(bad)).collect()
    assert [tuple(r) for r in rows] == [(0, 1.5, 2.0), (1, None, 3.0), (2, None, 4.0)]
    with pytest.raises(Exception):  # noqa: B017
        P.read_points_csv(spark, str(bad), strict=True).collect()
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    assert P.read_points_csv(spark, str(empty)).count() == 0


def test_row_ids_of_many_rows_and_files(spark, tmp_path):
    rows = spark.range(100_000, numPartitions=8).withColumn("x", F.xxhash64("id")).drop("id").repartitionByRange(7, "x")
    got = P.with_row_ids(rows.sortWithinPartitions("x")).agg(F.countDistinct("id"), F.min("id"), F.max("id"), F.count("*")).first()
    assert tuple(got) == (100_000, 0, 99_999, 100_000)
    wrong = P.with_row_ids(rows.sortWithinPartitions("x")).withColumn("r", F.row_number().over(W.orderBy("x")) - 1).where("r <> id")
    assert wrong.count() == 0
    n = 0
    for k, size in enumerate([5, 4000, 1, 300, 0, 2000]):  # Spark would read the largest first
        lines = [f"{n + i},{k}" for i in range(size)]
        (tmp_path / f"part-{k}.csv").write_text("\n".join(["Dim_0,Dim_1", *lines]) + "\n")
        n += size
    got = P.read_points_csv(spark, str(tmp_path))
    assert got.where("id <> Dim_0").count() == 0 and got.count() == n


def test_node_texts(spark):
    rows = spark.createDataFrame([("7|1|2|3,1.5,2.0|4,0.5,9.0",), ("8|0|1|7,2,0.5,2.0,1.5,9.0",), ("9|1|0",), ("9|1",), ("7|1|1|3,1.5",), ("7|0|1|x",), (None,)], "t string")
    got = [r["n"] for r in rows.select(P.parse_node_text(F.col("t"), 2).alias("n")).collect()]
    assert got[0]["leaf"] and [(p["id"], p["x"]) for p in got[0]["points"]] == [(3, [1.5, 2.0]), (4, [0.5, 9.0])]
    assert not got[1]["leaf"] and got[1]["boxes"][0].asDict() == {"cell": 7, "n": 2, "low": [0.5, 2.0], "high": [1.5, 9.0]}
    assert got[2]["points"] == [] and got[3:] == [None] * 4


def test_text_forms(spark):
    df = spark.createDataFrame([(7, 1.5, -2.0)], "id long, a double, b double")
    text = df.select(P.point_text("id", ["a", "b"]).alias("t"))
    assert text.first()["t"] == "7,1.5,-2.0"
    back = text.select(P.parse_point_text(F.col("t"), 2).alias("p")).first()["p"]
    assert back["id"] == 7 and back["x"] == [1.5, -2.0]
    assert df.select(P.parse_point_text(F.lit("7,1"), 2)).first()[0] is None
    assert df.select(P.coordinate_key(["a", "b"])).first()[0] == "1.5,-2.0"
    assert P.format_result(df, "T") == "T\n7, 1.5, -2.0"


@pytest.mark.parametrize("kind", generators.KINDS)
def test_generators(spark, kind):
    rho = 0.3
    points = generators.generate(spark, kind, 20_000, 3, 5, rho=rho, partitions=4)
    again = generators.generate(spark, kind, 20_000, 3, 5, rho=rho, partitions=4)
    stats = points.agg(F.count("*"), F.corr("Dim_0", "Dim_1"), F.least(F.min("Dim_0"), F.min("Dim_1"), F.min("Dim_2")), F.stddev("Dim_2")).first()
    assert tuple(stats) == tuple(again.agg(F.count("*"), F.corr("Dim_0", "Dim_1"), F.least(F.min("Dim_0"), F.min("Dim_1"), F.min("Dim_2")), F.stddev("Dim_2")).first())
    want = {"correlated": rho, "anticorrelated": -rho}.get(kind, 0)
    assert stats[0] == 20_000 and stats[1] == pytest.approx(want, abs=0.03)
    if want:
        assert stats[2] == pytest.approx(0, abs=1e-9) and stats[3] == pytest.approx(1, abs=0.03)


def test_generator_limits(spark):
    with pytest.raises(ValueError, match="rho"):
        generators.generate(spark, "anticorrelated", 10, 3, rho=0.5)
    with pytest.raises(ValueError, match="two dimensions"):
        generators.generate(spark, "anticorrelated", 10, 1)
    with pytest.raises(ValueError, match="kind"):
        generators.generate(spark, "other")
    assert generators.generate(spark, "correlated", 0, 2).count() == 0


def test_stored_summary(spark, tmp_path):
    points = generators.generate(spark, "normal", 500, 2, 3)
    index = cells.CellIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    first = index.load_or_build(points, ["Dim_0", "Dim_1"])
    assert first.agg(F.sum("n")).first()[0] == 500 and index.exists()
    assert index.load_or_build(points.select("id", "Dim_1", "Dim_0"), ["Dim_0", "Dim_1"]).inputFiles() == first.inputFiles()
    dims, edges = index.load()[1:]
    assert cells.check_summary(index.load()[0], points, dims, edges, "id") == []
    assert len(cells.check_summary(index.load()[0], points.limit(499), dims, edges)) >= 1
    assert cells.check_summary(index.load()[0], points.withColumn("id", F.lit(1)), dims, edges, "id") == ["id 1 stands 500 times"]
    inside = index.within([0.0, 0.0], [0.5, 0.5])
    want = index.load()[0].where("low_Dim_0 <= 0.5 AND high_Dim_0 >= 0 AND low_Dim_1 <= 0.5 AND high_Dim_1 >= 0")
    assert sorted(inside.collect()) == sorted(want.collect()) and 0 < inside.count() < index.load()[0].count()
    other = index.load_or_build(points.limit(1), ["Dim_0", "Dim_1"])  # of other points, so built anew
    assert other.agg(F.sum("n")).first()[0] == 1
    assert index.load_or_build(points.limit(10), ["Dim_0", "Dim_1"], reset=True).agg(F.sum("n")).first()[0] == 10
    index.delete()
    assert not index.exists()


def test_whole_run_and_record(spark, tmp_path):
    path = str(tmp_path / "csv")
    P.write_points_csv(generators.generate(spark, "uniform", 300, 2, 9), path)
    said = runs.main([path, "3", "2", "--partitions", "3", "--record", str(tmp_path / "record"), "--distribution", "uniform"], spark)
    assert said.startswith("Skyline\n") and len(said.split("Top-k dominating\n")[1].split("\n\n")[0].split("\n")) == 3
    part = next(f for f in os.listdir(tmp_path / "record") if f.startswith("part-"))
    record = json.loads((tmp_path / "record" / part).read_text())
    assert len(record) == 16 and record["dataSize"] == 300 and record["nDims"] == 2 and record["kForSkyline"] == 2
    assert record["totalTreeCreationIOs"] >= 300 and record["totalNOverflow"] == 0 and record["totalSkyTopKTime_Sol2"] > 0
    done = runs.run(generators.generate(spark, "uniform", 200, 3, 1), 4, 4)
    assert all(0 <= c.merge_seconds <= c.seconds and c.stages >= 1 and c.tasks >= c.stages for c in done.counters.values())


def test_plot(spark, tmp_path):
    pytest.importorskip("matplotlib")
    assert P.plot_points(generators.generate(spark, "uniform", 50, 2, 1), str(tmp_path / "p.png"), most=20) == 20


def test_generator_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vantage.session.local_session", lambda *a, **k: spark)
    generators.main(["--generator", "uniform", "--num_points", "70", "--num_dimensions", "3", "--max_val", "5", "--output_file", str(tmp_path / "out")])
    got = P.read_points_csv(spark, str(tmp_path / "out"))
    assert got.count() == 70 and got.columns == ["id", "Dim_0", "Dim_1", "Dim_2"] and got.where("Dim_0 < 0 OR Dim_2 > 5").count() == 0


def test_skyline_of_a_stream(spark, tmp_path):
    points = generators.generate(spark, "anticorrelated", 300, 2, 9, rho=0.9, partitions=3).persist()
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = maintain_skyline(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    last = max(int(d[1:]) for d in os.listdir(tmp_path / "out"))
    assert last >= 1
    got = spark.read.parquet(str(tmp_path / "out" / f"v{last}"))
    assert sorted(got.collect()) == sorted(skyline(points).collect())


def test_entry_points(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_queries_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    from vantage.plans import catalogue

    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, sf)
        columns = sorted(df.columns)
        mine = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
        assert mine == sorted(map(str, db.sql(sql).project(", ".join(columns)).fetchall())), name
