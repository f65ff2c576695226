"""Shards of near equal bytes by the minimax contiguous partition of ordered atomic groups.

The groups (equal texts) are ordered by a hash of the text. The least capacity with which so many
contiguous shards hold everything is found by binary search; each trial fills shards greedily. The
driver never holds the groups: it starts from sums over ranges of the hash and asks for finer sums only
of the ranges in which a cut falls, until every cut lies between two groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, materialise, require
from .sql_hashes import crc32, xxh64

SHARDS = 8
#: Ranges of the hash (as a power of two) at first, and parts into which a range is cut when it has to be.
FIRST_BITS, MORE_BITS = 13, 10
#: Parts of a shard within which slots are given out one after the other (a power of two), and rows made at a time.
SLOT_PARTS, ROWS_AT_ONCE = 1024, 4096


@dataclass
class Range:
    """Groups whose key, shifted right by 64 - bits, is prefix: their sum, largest one and number."""

    bits: int
    prefix: int
    total: int
    largest: int
    groups: int

    @property
    def first(self) -> int:
        return self.prefix << (64 - self.bits)


def fill(ranges: list[Range], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Greedy filling: index of the range in which each cut falls, or None if more shards would be needed.

    A cut lies before its range, or, if divisible and the range has several groups, anywhere in it."""
    cuts, room = [], capacity
    for i, r in enumerate(ranges):
        if r.largest > capacity:
            return None
        left = r.total
        while left > room:
            if divisible and r.groups > 1:
                left -= room
            elif left > capacity:
                return None
            cuts.append(i)
            if len(cuts) >= shards:
                return None
            room = capacity
        room -= left
    return cuts


def least_capacity(ranges: list[Range], shards: int, divisible: bool) -> int:
    low = max([0, *(r.largest for r in ranges)], default=0)
    high = sum(r.total for r in ranges)
    low = max(low, -(-high // shards))
    while low < high:
        mid = (low + high) // 2
        if fill(ranges, mid, shards, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _sums(groups: DataFrame, bits: int, inside: list[Range] | None) -> list[Range]:
    prefix = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
    if inside is not None:
        by_bits: dict[int, list[int]] = {}
        for r in inside:
            by_bits.setdefault(r.bits, []).append(r.prefix)
        wanted = F.lit(False)
        for b, prefixes in by_bits.items():
            wanted = wanted | F.shiftright("key", 64 - b).isin(prefixes)
        groups = groups.where(wanted)
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("t"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()
    return [Range(bits, r["p"], r["t"], r["m"], r["n"]) for r in rows]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[int, list[int]]:
    """(least capacity, first key of each shard but the first). groups: (key long, distinct; bytes long).

    Trailing shards may be empty if there are fewer groups than shards."""
    ranges = sorted(_sums(groups, first_bits, None), key=lambda r: r.first)
    while True:
        low, high = least_capacity(ranges, shards, True), least_capacity(ranges, shards, False)
        # cuts between the bounds move, so both ends' ranges are opened
        opened = {i for c, d in ((low, True), (high, True), (high, False)) for i in fill(ranges, c, shards, d) or [] if ranges[i].groups > 1}
        if not opened:
            break
        finer: dict[int, list[Range]] = {}
        for i in opened:
            finer.setdefault(min(64, ranges[i].bits + more_bits), []).append(ranges[i])
        new = [r for bits, inside in finer.items() for r in _sums(groups, bits, inside)]
        ranges = sorted([r for i, r in enumerate(ranges) if i not in opened] + new, key=lambda r: r.first)
    cuts = fill(ranges, high, shards, False) or []
    return high, [ranges[i].first for i in cuts]


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Rows with equal texts are one atomic group
    and share a shard; null counts as the empty text here. law is `bytes`: the largest shard is as small
    as contiguous groups in order of the text's hash allow. slot runs gapless from 0 in each shard,
    grown_shard is null. Rows that repeat and rows without an id get their own slots, next to each other. An empty
    table gives an empty result.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = Table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups.df, shards)
    groups.drop()
    number: Column = F.lit(0)
    for key in cuts:
        number = number + (F.col("key") >= F.lit(key).cast("long")).cast("int")
    # rows of one id and one text are alike, so a row each with their number will do to give out slots, however many
    alike = rows.groupBy("id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    name = F.concat(F.lit("slot "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.col("key").cast("string"))
    part = F.pmod(F.xxhash64(name), F.lit(SLOT_PARTS)).cast("int")
    placed = materialise(alike.select("*", number.alias("shard"), part.alias("part")), "shard-placed")
    sizes = placed.groupBy("shard", "part").agg(F.sum("n").alias("n"))  # shards * SLOT_PARTS rows at most
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(earlier(W.partitionBy("shard").orderBy("part"))), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("n").over(earlier(W.partitionBy("shard", "part").orderBy("id", "key", "size", "text_crc32"))), F.lit(0))
    begun = placed.withColumn("within", within).join(F.broadcast(offsets), ["shard", "part"])
    pieces = begun.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ROWS_AT_ONCE))))
    first = F.col("piece") * ROWS_AT_ONCE
    numbered = pieces.withColumn("k", F.explode(F.sequence(first, F.least(first + ROWS_AT_ONCE, F.col("n")) - 1)))
    return numbered.select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _oracle() -> str:
    """DuckDB SQL for the rows of the registered query: the least capacity by bisection over the running sums of all groups."""
    filled = f"list_reduce(range({SHARDS}), lambda z, k: list_max(list_filter(ends, lambda x: x <= z + {{0}})), 0)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, 'slot ' || coalesce(doc_id::VARCHAR, '') || ' ' AS name FROM documents),
x AS ({xxh64("d", "text")}),
y AS (SELECT s, CASE WHEN h > 9223372036854775807 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS key FROM x),
c AS ({crc32("d", "text")}),
r AS (SELECT doc_id, strlen(text) + 1 AS size, crc, key, name || key AS name FROM d JOIN y ON y.s = d.text JOIN c ON c.s = d.text),
g AS (SELECT key, sum(size)::BIGINT AS bytes, (sum(sum(size)) OVER (ORDER BY key))::BIGINT AS reach FROM r GROUP BY key),
p AS (SELECT list_append(list(reach), 0::BIGINT) AS ends, max(reach) AS total, greatest(max(bytes), (max(reach) + {SHARDS - 1}) // {SHARDS}) AS least FROM g),
b AS (SELECT least AS low, total AS high FROM p UNION ALL
      SELECT CASE WHEN holds THEN low ELSE mid + 1 END, CASE WHEN holds THEN mid ELSE high END FROM (
        SELECT low, high, (low + high) // 2 AS mid, {filled.format("(low + high) // 2")} = total AS holds FROM b, p WHERE low < high) z),
q AS (SELECT list_transform(range(1, {SHARDS}), lambda n: list_reduce(range(n), lambda z, k: list_max(list_filter(ends, lambda x: x <= z + low)), 0)) AS cuts
      FROM p, (SELECT low FROM b WHERE low = high LIMIT 1) l),
s AS (SELECT r.*, len(list_filter(q.cuts, lambda x: x <= g.reach - g.bytes)) AS shard FROM r JOIN g ON g.key = r.key, q),
h AS ({xxh64("s", "name")})
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY h & {SLOT_PARTS - 1}, doc_id NULLS FIRST, key, size, crc) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN h ON h.s = s.name
"""


ORACLE_SQL = _oracle()
