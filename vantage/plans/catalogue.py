"""The registered queries over the test tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.dominance import box_dominates_box as box_dominates_other
from ..functions.dominance import box_dominates_point as box_dominates
from ..functions.dominance import dominates, dominates_array, partly_dominates
from ..operators import cells, score, skyline, topk
from ..sources import generators
from ..sources import points as P
from ..storage import new_path
from . import run as runs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PART = ("p_size", "p_retailprice")
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _dom(a: str, b: str, dims: Sequence[str], signs: Sequence[int] | None = None) -> str:
    """SQL: row a dominates row b; sign -1 maximises a dimension."""
    signs = signs or [1] * len(dims)
    weak = " AND ".join(f"{a}.{d} {'<=' if s > 0 else '>='} {b}.{d}" for d, s in zip(dims, signs, strict=True))
    strong = " OR ".join(f"{a}.{d} {'<' if s > 0 else '>'} {b}.{d}" for d, s in zip(dims, signs, strict=True))
    return f"({weak} AND ({strong}))"


def _not_dominated(columns: str, table: str, dims: Sequence[str], signs=None, group: str = "") -> str:
    same = f" AND q.{group} = p.{group}" if group else ""
    return f"SELECT {columns} FROM {table} p WHERE NOT EXISTS (SELECT 1 FROM {table} q WHERE {_dom('q', 'p', dims, signs)}{same})"


def _not_dominated_by_strong(dims: Sequence[str], scale: str, table: str = "lineitem") -> str:
    """As _not_dominated of the dims; first against few strong rows, then what is left against all rows."""
    cols = ", ".join(dims)
    return f"""WITH strong AS (SELECT {cols} FROM {table} ORDER BY {scale} LIMIT 300),
weak AS (SELECT {cols} FROM {table} p WHERE NOT EXISTS (SELECT 1 FROM strong q WHERE {_dom("q", "p", dims)}))
SELECT {cols} FROM weak p WHERE NOT EXISTS (SELECT 1 FROM {table} q WHERE {_dom("q", "p", dims)})"""


def _scores(table: str, key: str, dims: Sequence[str], candidates: str | None = None) -> str:
    return (
        f"SELECT p.{key} AS id, count(q.{key})::BIGINT AS score FROM {candidates or table} p LEFT JOIN {table} q ON {_dom('p', 'q', dims)} GROUP BY p.{key}"
    )


def _top(sql: str, k: int = 10) -> str:
    return f"SELECT id, score FROM ({sql}) s ORDER BY score DESC, id LIMIT {k}"


def _read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part", "p_partkey", *PART)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)


ORDERS_SQL = "(SELECT o_orderkey, o_totalprice, epoch_us(o_orderdate) / 1e6 AS day FROM orders)"


def _vectors(spark: SparkSession, sf: str, dims: int) -> DataFrame:
    return _read(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)))


def _vectors_sql(dims: int) -> str:
    return f"(SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS e{i}' for i in range(dims))} FROM embeddings)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The box around the parts of each brand."""
    rows = _read(spark, sf, "part", "p_brand", *PART)
    return rows.groupBy("p_brand").agg(
        F.count("*").alias("n"),
        F.min("p_size").cast("double").alias("low0"),
        F.min("p_retailprice").alias("low1"),
        F.max("p_size").cast("double").alias("high0"),
        F.max("p_retailprice").alias("high1"),
    )


BOXES_SQL = """(SELECT p_brand, count(*) AS n, min(p_size)::DOUBLE AS low0, min(p_retailprice) AS low1,
  max(p_size)::DOUBLE AS high0, max(p_retailprice) AS high1 FROM part GROUP BY p_brand)"""


def _box(prefix: str = "") -> G.Box:
    return [F.col(f"{prefix}low0"), F.col(f"{prefix}low1")], [F.col(f"{prefix}high0"), F.col(f"{prefix}high1")]


def _box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = _boxes(spark, sf)
    a = b.select(*(F.col(c).alias(f"a_{c}") for c in b.columns))
    # 25 brands: pairs of them are a bounded table
    return F.broadcast(a).join(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)), F.col("a_p_brand") < F.col("b_p_brand"))


PAIRS_SQL = f"{BOXES_SQL} a JOIN {BOXES_SQL} b ON a.p_brand < b.p_brand"


# skylines


@_query(_not_dominated("p_partkey, p_size, p_retailprice", "part", PART))
def skyline_part_2d(spark, sf):
    return skyline.skyline(_part(spark, sf), PART)


@_query(_not_dominated("p_partkey, p_size, p_retailprice", "part", PART))
def skyline_part_2d_anti(spark, sf):
    return skyline.skyline(_part(spark, sf), PART, strategy="anti")


@_query(_not_dominated("p_partkey, p_size, p_retailprice", "part", PART))
def skyline_part_2d_window(spark, sf):
    return skyline.skyline(_part(spark, sf), PART, strategy="window2d")


_LINE_2D = """WITH m AS (SELECT l_quantity, min(l_extendedprice) AS p FROM lineitem GROUP BY l_quantity),
k AS (SELECT l_quantity, p FROM (SELECT *, min(p) OVER (ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m) WHERE b IS NULL OR p < b)
SELECT l.l_quantity, l.l_extendedprice FROM lineitem l JOIN k ON l.l_quantity = k.l_quantity AND l.l_extendedprice = k.p"""


@_query(_LINE_2D)
def skyline_lineitem_2d(spark, sf):
    return skyline.skyline(_read(spark, sf, "lineitem", *LINE[:2]), LINE[:2])


@_query(_LINE_2D)
def skyline_lineitem_2d_window(spark, sf):
    return skyline.skyline(_read(spark, sf, "lineitem", *LINE[:2]), LINE[:2], strategy="window2d")


@_query("SELECT DISTINCT * FROM (" + _LINE_2D + ") t")
def skyline_distinct_lineitem_2d(spark, sf):
    return skyline.skyline(_read(spark, sf, "lineitem", *LINE[:2]), LINE[:2], distinct=True)


@_query(_not_dominated_by_strong(LINE[:3], "l_quantity / 50 + l_extendedprice / 1e5 + l_discount * 10"))
def skyline_lineitem_3d(spark, sf):
    return skyline.skyline(_read(spark, sf, "lineitem", *LINE[:3]), LINE[:3])


@_query(_not_dominated_by_strong(LINE, "l_quantity / 50 + l_extendedprice / 1e5 + l_discount * 10 + l_tax * 12"))
def skyline_lineitem_4d(spark, sf):
    return skyline.skyline(_read(spark, sf, "lineitem", *LINE), LINE)


@_query(_not_dominated("p_partkey, p_size, p_retailprice", "part", PART, (1, -1)))
def skyline_maxdir_part(spark, sf):
    return skyline.skyline(_part(spark, sf), PART, {"p_retailprice": "max"})


@_query(_not_dominated("c_custkey, c_mktsegment, c_acctbal, c_nationkey", "customer", ("c_acctbal", "c_nationkey"), group="c_mktsegment"))
def skyline_by_segment(spark, sf):
    rows = _read(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return skyline.skyline(rows, ("c_acctbal", "c_nationkey"), by=["c_mktsegment"])


@_query(_not_dominated_by_strong(LINE, "l_quantity / 50 + l_extendedprice / 1e5 + l_discount * 10 + l_tax * 12"))
def skyline_lineitem_one_group(spark, sf):
    """All rows in one group: the hottest that there can be."""
    rows = _read(spark, sf, "lineitem", *LINE).withColumn("g", F.lit("all"))
    return skyline.skyline(rows, LINE, by=["g"]).drop("g")


@_query(_not_dominated("vec_id, e0, e1, e2", _vectors_sql(3), ("e0", "e1", "e2")))
def skyline_negative_embeddings(spark, sf):
    return skyline.skyline(_vectors(spark, sf, 3), ("e0", "e1", "e2"))


@_query(_not_dominated("vec_id, e0, e1, e2, e3, e4", _vectors_sql(5), tuple(f"e{i}" for i in range(5))))
def skyline_embeddings_5d(spark, sf):
    return skyline.skyline(_vectors(spark, sf, 5), tuple(f"e{i}" for i in range(5)))


@_query(_not_dominated("p_partkey, p_size, p_retailprice", "part", PART))
def skyline_idempotent(spark, sf):
    return skyline.skyline(skyline.skyline(_part(spark, sf), PART), PART)


# scores and rankings


@_query(_scores("part", "p_partkey", PART))
def dominance_score_part(spark, sf):
    return score.dominance_score(_part(spark, sf), PART, "p_partkey").withColumnRenamed("p_partkey", "id")


@_query(_scores("supplier", "s_suppkey", ("s_acctbal", "s_nationkey")))
def dominance_score_supplier(spark, sf):
    rows = _read(spark, sf, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    return score.dominance_score(rows, ("s_acctbal", "s_nationkey"), "s_suppkey").withColumnRenamed("s_suppkey", "id")


@_query(_scores("part", "p_partkey", PART, "(" + _not_dominated("*", "part", PART) + ")"))
def dominance_score_skyline_part(spark, sf):
    rows = _part(spark, sf)
    return score.dominance_score(rows, PART, "p_partkey", skyline.skyline(rows, PART)).withColumnRenamed("p_partkey", "id")


@_query(_scores(ORDERS_SQL, "o_orderkey", ("o_totalprice", "day")))
def dominance_score_orders(spark, sf):
    return score.dominance_score(_orders(spark, sf), ("o_totalprice", "day"), "o_orderkey").withColumnRenamed("o_orderkey", "id")


@_query(f"SELECT p.p_partkey AS id, count(q.p_partkey)::BIGINT AS score FROM part p LEFT JOIN part q ON {_dom('q', 'p', PART)} GROUP BY p.p_partkey")
def dominated_by_count_part(spark, sf):
    return score.dominated_by_count(_part(spark, sf), PART, "p_partkey").withColumnRenamed("p_partkey", "id")


@_query(_scores("supplier", "s_suppkey", ("s_acctbal", "s_nationkey")))
def dominance_score_by_join_supplier(spark, sf):
    rows = _read(spark, sf, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    scores = score.score_by_join(rows, ("s_acctbal", "s_nationkey"), "s_suppkey")
    every = scores.union(rows.select("s_suppkey", F.lit(0).cast("long")))  # rows that aren't points have score 0
    return every.groupBy(F.col("s_suppkey").alias("id")).agg(F.sum("score").alias("score"))


@_query(_top(_scores("part", "p_partkey", PART)))
def topk_dominating_part(spark, sf):
    return topk.topk_dominating(_part(spark, sf), 10, PART, "p_partkey").withColumnRenamed("p_partkey", "id")


@_query(_top(_scores("part", "p_partkey", PART)))
def topk_by_score_part(spark, sf):
    return topk.topk_by_score(dominance_score_part(spark, sf), 10)


@_query(_top(_scores(ORDERS_SQL, "o_orderkey", ("o_totalprice", "day"))))
def topk_dominating_orders(spark, sf):
    return topk.topk_dominating(_orders(spark, sf), 10, ("o_totalprice", "day"), "o_orderkey").withColumnRenamed("o_orderkey", "id")


@_query(_top(_scores(_vectors_sql(4), "vec_id", ("e0", "e1", "e2", "e3"))))
def topk_dominating_embeddings(spark, sf):
    return topk.topk_dominating(_vectors(spark, sf, 4), 10, ("e0", "e1", "e2", "e3"), "vec_id").withColumnRenamed("vec_id", "id")


_WIDE = tuple(f"e{i}" for i in range(64))


@_query(_top(_scores(_vectors_sql(64), "vec_id", _WIDE)))
def topk_dominating_embeddings_64d(spark, sf):
    return topk.topk_dominating(_vectors(spark, sf, 64), 10, _WIDE, "vec_id").withColumnRenamed("vec_id", "id")


@_query(_top(_scores("part", "p_partkey", PART, "(" + _not_dominated("*", "part", PART) + ")")))
def topk_skyline_part(spark, sf):
    return topk.topk_skyline(_part(spark, sf), 10, PART, "p_partkey").withColumnRenamed("p_partkey", "id")


@_query(_top(_scores("part", "p_partkey", PART, "(" + _not_dominated("*", "part", PART) + ")")))
def topk_skyline_by_scores_part(spark, sf):
    return runs.topk_skyline_by_scores(_part(spark, sf), 10, PART, "p_partkey").withColumnRenamed("p_partkey", "id")


@_query(_top(_scores(ORDERS_SQL, "o_orderkey", ("o_totalprice", "day"), "(" + _not_dominated("*", ORDERS_SQL, ("o_totalprice", "day")) + ")")))
def topk_skyline_orders(spark, sf):
    return topk.topk_skyline(_orders(spark, sf), 10, ("o_totalprice", "day"), "o_orderkey").withColumnRenamed("o_orderkey", "id")


@_query(_top(_scores(_vectors_sql(5), "vec_id", tuple(f"e{i}" for i in range(5)), "(" + _not_dominated("*", _vectors_sql(5), tuple(f"e{i}" for i in range(5))) + ")")))
def topk_skyline_embeddings(spark, sf):
    return topk.topk_skyline(_vectors(spark, sf, 5), 10, tuple(f"e{i}" for i in range(5)), "vec_id").withColumnRenamed("vec_id", "id")


# cells, boxes, distances


@_query("""SELECT (CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END)::INTEGER AS cell,
count(*)::BIGINT AS n, min(o_totalprice) AS low_o_totalprice, max(o_totalprice) AS high_o_totalprice FROM orders GROUP BY 1""")
def cell_summary_orders(spark, sf):
    return cells.cell_summary(_read(spark, sf, "orders", "o_totalprice"), ["o_totalprice"], [[100000.0, 250000.0]])


@_query(f"SELECT p_brand, n::BIGINT AS n, low0, low1, high0, high1 FROM {BOXES_SQL} b")
def mbr_by_brand(spark, sf):
    return _boxes(spark, sf)


@_query(f"""SELECT p_brand, round((high0 - low0) * (high1 - low1), 6) AS area, round(((high0 - low0) + (high1 - low1)) * 2, 6) AS perimeter,
round((low0 + high0) / 2, 6) AS centre0, round((low1 + high1) / 2, 6) AS centre1 FROM {BOXES_SQL} b""")
def mbr_area_perimeter(spark, sf):
    middle = G.centre(_box())
    return _boxes(spark, sf).select(
        "p_brand", F.round(G.area(_box()), 6).alias("area"), F.round(G.perimeter(_box()), 6).alias("perimeter"), F.round(middle[0], 6).alias("centre0"), F.round(middle[1], 6).alias("centre1")
    )


@_query(f"""SELECT a.p_brand AS a, b.p_brand AS b, a.low0 <= b.high0 AND a.high0 >= b.low0 AND a.low1 <= b.high1 AND a.high1 >= b.low1 AS meet,
a.low0 < b.low0 AND b.high0 < a.high0 AND a.low1 < b.low1 AND b.high1 < a.high1 AS holds FROM {PAIRS_SQL}""")
def mbr_overlap(spark, sf):
    a, b = _box("a_"), _box("b_")
    return _box_pairs(spark, sf).select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), G.overlaps(a, b).alias("meet"), G.contains_box(a, b).alias("holds"))


@_query(f"""SELECT a.p_brand AS a, b.p_brand AS b, round(greatest(least(a.high0, b.high0) - greatest(a.low0, b.low0), 0.0)
* greatest(least(a.high1, b.high1) - greatest(a.low1, b.low1), 0.0), 6) AS area FROM {PAIRS_SQL}""")
def mbr_overlap_area(spark, sf):
    return _box_pairs(spark, sf).select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), F.round(G.overlap_area(_box("a_"), _box("b_")), 6).alias("area"))


@_query(f"""SELECT a.p_brand AS a, b.p_brand AS b, round(least(a.low0, b.low0) - 1e-5, 6) AS low0, round(least(a.low1, b.low1) - 1e-5, 6) AS low1,
round(greatest(a.high0, b.high0) + 1e-5, 6) AS high0, round(greatest(a.high1, b.high1) + 1e-5, 6) AS high1 FROM {PAIRS_SQL}""")
def mbr_expand(spark, sf):
    low, high = G.expand(_box("a_"), _box("b_"))
    out = [*zip(("low0", "low1"), low, strict=True), *zip(("high0", "high1"), high, strict=True)]
    return _box_pairs(spark, sf).select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), *(F.round(c, 6).alias(n) for n, c in out))


@_query(f"SELECT p_partkey, b.low0 < p_size AND p_size < b.high0 AND b.low1 < p_retailprice AND p_retailprice < b.high1 AS inside FROM part p JOIN {BOXES_SQL} b ON b.p_brand = p.p_brand")
def mbr_contains(spark, sf):
    rows = _read(spark, sf, "part", "p_partkey", "p_brand", *PART).join(_boxes(spark, sf), "p_brand")
    return rows.select("p_partkey", G.contains_point(_box(), [F.col(c) for c in PART]).alias("inside"))


_V = [f"e{i}" for i in range(4)]


@_query(f"SELECT vec_id, round({' + '.join(f'abs({c})' for c in _V)}, 6) AS l1 FROM {_vectors_sql(4)} v")
def l1_norm(spark, sf):
    return _vectors(spark, sf, 4).select("vec_id", F.round(G.l1([F.col(c) for c in _V]), 6).alias("l1"))


@_query(f"SELECT vec_id, round(sqrt({' + '.join(f'({c} - 0.5) * ({c} - 0.5)' for c in _V)}), 6) AS l2 FROM {_vectors_sql(4)} v")
def l2_distance(spark, sf):
    return _vectors(spark, sf, 4).select("vec_id", F.round(G.l2([F.col(c) for c in _V], [F.lit(0.5)] * 4), 6).alias("l2"))


def _gap(low: str, x: str, high: str) -> str:
    return f"power(greatest({low} - {x}, {x} - {high}, 0.0), 2)"


@_query(f"""SELECT p_partkey, round(sqrt({_gap('20.0', 'p_size', '30.0')} + {_gap('1000.0', 'p_retailprice', '1200.0')}), 6) AS distance,
round(sqrt(power(p_size - 25.0, 2) + power(p_retailprice - 1100.0, 2)), 6) AS from_centre FROM part""")
def rect_point_distance(spark, sf):
    box = ([F.lit(20.0), F.lit(1000.0)], [F.lit(30.0), F.lit(1200.0)])
    p = [F.col(c).cast("double") for c in PART]
    return _part(spark, sf).select("p_partkey", F.round(G.l2_to_box(p, box), 6).alias("distance"), F.round(G.distance_from_centre(p, box), 6).alias("from_centre"))


@_query(f"""SELECT s.s_suppkey AS id, b.p_brand, s.s_nationkey <= b.low0 AND s.s_acctbal <= b.low1 AND (s.s_nationkey < b.low0 OR s.s_acctbal < b.low1) AS whole,
NOT (s.s_nationkey <= b.low0 AND s.s_acctbal <= b.low1 AND (s.s_nationkey < b.low0 OR s.s_acctbal < b.low1))
AND s.s_nationkey <= b.high0 AND s.s_acctbal <= b.high1 AND (s.s_nationkey < b.high0 OR s.s_acctbal < b.high1) AS part FROM supplier s, {BOXES_SQL} b""")
def partial_dominance_pairs(spark, sf):
    rows = _read(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").join(F.broadcast(_boxes(spark, sf)), F.lit(True))  # a row a brand
    p = [F.col("s_nationkey").cast("double"), F.col("s_acctbal")]
    low, high = _box()
    return rows.select(F.col("s_suppkey").alias("id"), "p_brand", dominates(p, low).alias("whole"), partly_dominates(p, low, high).alias("part"))


@_query(f"SELECT vec_id, {' AND '.join(f'{c} <= 0.0' for c in _V)} AND ({' OR '.join(f'{c} < 0.0' for c in _V)}) AS better FROM {_vectors_sql(4)} v")
def dominance_of_arrays(spark, sf):
    rows = _vectors(spark, sf, 4)
    return rows.select("vec_id", dominates_array(F.array(*_V), F.array(*[F.lit(0.0)] * 4)).alias("better"))


@_query("SELECT p_partkey, concat_ws(',', p_partkey, p_size::DOUBLE, p_retailprice) AS text, p_partkey AS back_id, p_retailprice AS back_price FROM part")
def point_text_part(spark, sf):
    written = _part(spark, sf).select("p_partkey", P.point_text("p_partkey", PART).alias("text"))
    back = P.parse_point_text(F.col("text"), 2)
    return written.select("p_partkey", "text", back["id"].alias("back_id"), back["x"][1].alias("back_price"))


@_query(f"SELECT p_brand, concat_ws(',', p_brand, n, low0, low1, high0, high1) AS text, n::BIGINT AS back_n, high1 AS back_high1 FROM {BOXES_SQL} b")
def box_text_by_brand(spark, sf):
    written = _boxes(spark, sf).select("p_brand", P.box_text("p_brand", "n", ["low0", "low1"], ["high0", "high1"]).alias("text"))
    back = P.parse_box_text(F.col("text"), 2)
    return written.select("p_brand", "text", back["n"].alias("back_n"), back["high"][1].alias("back_high1"))


@_query("""SELECT s_nationkey, concat_ws('|', s_nationkey, 1, count(*), string_agg(concat_ws(',', s_suppkey, s_acctbal), '|' ORDER BY s_suppkey)) AS text,
count(*)::BIGINT AS back_n, sum(s_suppkey)::BIGINT AS back_ids FROM supplier GROUP BY s_nationkey""")
def node_text_by_nation(spark, sf):
    entry = P.point_text("s_suppkey", ["s_acctbal"])
    rows = _read(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select("s_nationkey", F.struct("s_suppkey", entry.alias("e")).alias("e"))
    nodes = rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("e")).alias("es")).withColumn("leaf", F.lit(True))
    written = nodes.select("s_nationkey", P.node_text("s_nationkey", "leaf", "n", F.concat_ws("|", F.col("es.e"))).alias("text"))
    back = P.parse_node_text(F.col("text"), 1)
    return written.select("s_nationkey", "text", back["n"].alias("back_n"), F.aggregate(back["points"], F.lit(0).cast("long"), lambda s, p: s + p["id"]).alias("back_ids"))


@_query(f"""SELECT s.s_suppkey AS id, b.p_brand, b.low0 <= s.s_nationkey AND b.low1 <= s.s_acctbal AND (b.low0 < s.s_nationkey OR b.low1 < s.s_acctbal) AS may
FROM supplier s, {BOXES_SQL} b""")
def box_dominates_point(spark, sf):
    rows = _read(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").join(F.broadcast(_boxes(spark, sf)), F.lit(True))  # a row a brand
    return rows.select(F.col("s_suppkey").alias("id"), "p_brand", box_dominates(_box()[0], [F.col("s_nationkey").cast("double"), F.col("s_acctbal")]).alias("may"))


@_query(f"SELECT a.p_brand AS a, b.p_brand AS b, a.low0 <= b.low0 AND a.low1 <= b.low1 AND (a.low0 < b.low0 OR a.low1 < b.low1) AS may FROM {PAIRS_SQL}")
def box_dominates_box(spark, sf):
    return _box_pairs(spark, sf).select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), box_dominates_other(_box("a_")[0], _box("b_")[0]).alias("may"))


@_query(f"SELECT p.p_partkey AS id FROM part p WHERE (SELECT count(*) FROM part q WHERE {_dom('q', 'p', PART)}) = 0")
def skyline_by_counts_part(spark, sf):
    """The skyline as the points that no point is counted to dominate."""
    return score.dominated_by_count(_part(spark, sf), PART, "p_partkey").where("score = 0").select(F.col("p_partkey").alias("id"))


@_query(f"""SELECT a.p_brand AS a, b.p_brand AS b, CASE WHEN m THEN greatest(a.low0, b.low0) END AS low0, CASE WHEN m THEN greatest(a.low1, b.low1) END AS low1,
CASE WHEN m THEN least(a.high0, b.high0) END AS high0, CASE WHEN m THEN least(a.high1, b.high1) END AS high1
FROM {PAIRS_SQL}, LATERAL (SELECT a.low0 <= b.high0 AND a.high0 >= b.low0 AND a.low1 <= b.high1 AND a.high1 >= b.low1 AS m) x""")
def mbr_overlap_box(spark, sf):
    both = G.overlap_box(_box("a_"), _box("b_"))
    return _box_pairs(spark, sf).select(
        F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), *(both[e][i].alias(f"{e}{i}") for e in ("low", "high") for i in range(2))
    )


@_query("SELECT p_partkey, 1.7976931348623157e308 AS high, p_size::DOUBLE AS low0, p_retailprice AS low1, concat_ws(',', p_size::DOUBLE, p_retailprice) AS key FROM part")
def dominance_area_part(spark, sf):
    low, high = G.dominance_area([F.col(c).cast("double") for c in PART])
    return _part(spark, sf).select("p_partkey", high[0].alias("high"), low[0].alias("low0"), low[1].alias("low1"), P.coordinate_key(PART).alias("key"))


# generators: number, ranges, moments and correlations of the points, within what their number allows


def _moments(kind: str, dims: int, mean: float | None, std: float, low: float, corr: float, rho: float = 0.5) -> Query:
    def query(spark, sf):
        rows = generators.generate(spark, kind, 20_000, dims, 42, rho=rho, partitions=4)
        names = [f"Dim_{i}" for i in range(dims)]
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        near = lambda c, x, by: F.abs(c - F.lit(x)) < by
        every = lambda cs: reduce(and_, cs)
        means = [near(F.avg(c), mean, 0.04) for c in names] if mean is not None else [F.abs(F.avg(a) - F.avg(b)) < 0.04 for a, b in pairs]
        return rows.agg(
            F.count("*").alias("n"),
            F.countDistinct("id").alias("ids"),
            every(means).alias("means"),
            every([near(F.stddev(c), std, 0.02) for c in names]).alias("deviations"),
            every([F.min(c) >= low for c in names]).alias("ranges"),
            every([near(F.corr(a, b), corr, 0.03) for a, b in pairs]).alias("correlations"),
        )

    return query


for _kind, _settings in {
    "normal": (0.0, 1.0, -9.0, 0.0),
    "uniform": (0.5, 12**-0.5, 0.0, 0.0),
    "correlated": (None, 1.0, 0.0, 0.5),
    "anticorrelated": (None, 1.0, 0.0, -0.45, 0.45),
}.items():
    _queries[f"generate_{_kind}"] = _moments(_kind, 3, *_settings)
    _sql[f"generate_{_kind}"] = "SELECT 20000 AS n, 20000 AS ids, true AS means, true AS deviations, true AS ranges, true AS correlations"


@_query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey FROM part")
def row_ids_part(spark, sf):
    return P.with_row_ids(_read(spark, sf, "part", "p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey"))


@_query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size::DOUBLE AS Dim_0, p_retailprice AS Dim_1 FROM part")
def csv_round_trip_part(spark, sf):
    """Written as CSV files in the order of the keys, and read again with the places as ids."""
    rows = _part(spark, sf).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    path = new_path(spark, "points-csv")
    P.write_points_csv(rows, path, PART)
    return P.read_points_csv(spark, path)


@_query(f"""SELECT c.cell, c.n, c.low, c.high FROM (SELECT (CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END)::INTEGER AS cell,
count(*)::BIGINT AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1) c WHERE c.low <= 150000 AND c.high >= 120000""")
def stored_cells_orders(spark, sf):
    """A summary written, reused, filtered by a box, deleted: its rows as read back."""
    rows = _read(spark, sf, "orders", "o_totalprice")
    index = cells.CellIndex(spark, new_path(spark, "cell-index"))
    index.save(rows, ["o_totalprice"], [[100000.0, 250000.0]])
    index.load_or_build(rows, ["o_totalprice"])
    found = index.within([120000.0], [150000.0]).collect()  # at most a row a cell
    index.delete()
    return spark.createDataFrame([(r["cell"], r["n"], r["low_o_totalprice"], r["high_o_totalprice"]) for r in found], "cell int, n long, low double, high double")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
