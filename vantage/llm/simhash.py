"""SimHash near-duplicates by a self-join of a binary trie over the fingerprints.

The fingerprints are put into three tries, whose first levels are three different blocks of the
64 bits. Two fingerprints at most two bits apart agree on a whole block, so in one of the tries
they lie below the same node at the end of that block. Tasks get such subtries whole and walk
pairs of their nodes together, with the bits that differ so far, and drop a pair of nodes as soon
as it has used up the error budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, materialise, require
from .components import star_components
from .sql_hashes import xxh64

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Pairs of trie nodes that are expanded at once, and fingerprints of a subtrie that a task holds; they bound its memory.
CHUNK, SUBTRIE = 1 << 18, 1 << 20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash_text(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (unsigned) of the word shingles of a text; 0 for null and for no words."""
    words = text.encode().lower().split() if text else []  # bytes: lower-cases A-Z only, splits at \x20\x09-\x0D
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist(), strict=False)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - shingle + 1)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) <= 4096:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the SimHash as a signed 64-bit number."""
    require(docs, id_col, text_col)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        out = np.fromiter((simhash_text(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def trie_links(v: np.ndarray, below: int, budget: int, link) -> None:
    """Call link(i, j) with index arrays of all pairs of v at most budget bits apart that share
    the bits from `below` up. v: sorted distinct uint64; each node of the trie is a range of it."""
    starts = np.flatnonzero(np.r_[True, (v[1:] >> np.uint64(below)) != (v[:-1] >> np.uint64(below))])
    ends = np.r_[starts[1:], len(v)]
    big = ends - starts > 1
    lo, hi = starts[big], ends[big]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), below - 1)]
    while stack:
        alo, ahi, blo, bhi, err, bit = stack.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            stack += [tuple(x[s] for x in (alo, ahi, blo, bhi, err)) + (bit,) for s in (slice(half, None), slice(half))]
            continue
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        if leaves.any():  # the rest of both paths at once
            i, j = alo[leaves], blo[leaves]
            near = np.bitwise_count(v[i] ^ v[j]) <= budget
            link(i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~leaves] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or bit < 0:
            continue
        above = np.uint64(bit)
        amid = np.searchsorted(v, (v[alo] >> above | np.uint64(1)) << above)
        bmid = np.searchsorted(v, (v[blo] >> above | np.uint64(1)) << above)
        cross = alo != blo
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            tuple(x[cross] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if live.any():
            stack.append(tuple(x[live] for x in (alo, ahi, blo, bhi, err)) + (bit - 1,))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j, pair by pair; root points to a set's smallest index."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = root[root]
            if np.array_equal(deeper, root):
                break
            root[:] = deeper


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(bits to rotate left by, bits that are left below the block) for each block."""
    cuts = [round(bits * k / parts) for k in range(parts + 1)]
    return [(a, bits - (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def subtries(distinct: DataFrame, budget: int, *keep: str) -> DataFrame:
    """(trie, v, node, cut, columns to keep), a row for every row of distinct (fp long, no nulls) and trie, dealt out and
    sorted by subtrie: v is the fingerprint with the trie's block rotated to the top, node that block. A subtrie of more
    than SUBTRIE members is cut by blocks of the bits below it in turn, of which two members agree on one at least."""
    blocks = _blocks(BITS, budget + 1)

    def rotated(turn: int):
        return F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", BITS - turn))

    tries = [
        F.struct(F.lit(k).alias("trie"), rotated(turn).alias("v"), F.shiftrightunsigned(rotated(turn), below).alias("node")) for k, (turn, below) in enumerate(blocks)
    ]
    rows = distinct.select(F.explode(F.array(*tries)).alias("x"), *keep).select("x.*", *keep)
    sizes = rows.groupBy("trie", "node").count().where(F.col("count") > SUBTRIE).select("trie", "node", F.lit(True).alias("large"))
    large = Table(sizes, "simhash-large")  # a row for SUBTRIE rows at most
    lowest = min(below for _, below in blocks)  # bits below a node, of the trie with fewest
    cut = lambda k, low, size: F.shiftleft(F.lit(k + 1).cast("long"), 40) + F.shiftrightunsigned(F.col("v"), low).bitwiseAND((1 << size) - 1)
    inner = F.array(*(cut(k, low, lowest - rest) for k, (low, rest) in enumerate(_blocks(lowest, budget + 1))))
    marked = rows.join(F.broadcast(large.df), ["trie", "node"], "left")
    cuts = F.explode(F.when(F.col("large"), inner).otherwise(F.array(F.lit(0).cast("long")))).alias("cut")
    return marked.select("trie", "v", "node", cuts, *keep).repartition(*_SUBTRIE).sortWithinPartitions(*_SUBTRIE)


_SUBTRIE = ["trie", "node", "cut"]


def whole_subtries(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(trie, rows) of whole subtries of one trie, some at a time, from batches of the rows of subtries()."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        own = batch[_SUBTRIE].to_numpy()
        last = (own == own[-1]).all(axis=1)
        kept.append(batch)
        if last.all() and (kept[0][_SUBTRIE].to_numpy()[0] == own[-1]).all():
            continue
        whole = pd.concat(kept[:-1] + [batch[~last]])
        kept = [batch[last]]
        for (trie, _), part in whole.groupby(["trie", "cut"]):
            yield trie, part
    if kept:
        for (trie, _), part in pd.concat(kept).groupby(["trie", "cut"]):
            yield trie, part


def near_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): a spanning forest, per subtrie, of the pairs of fingerprints within the budget.

    distinct has one row per fingerprint (fp long, no nulls). Each subtrie links its members by
    no more rows than it has members, so many near copies don't give all their pairs.
    """
    blocks = _blocks(BITS, budget + 1)

    def forest(trie: int, v: np.ndarray) -> pd.DataFrame:
        turn, below = blocks[trie]
        v = np.unique(v.view(np.uint64))
        root = np.arange(len(v))
        trie_links(v, below, budget, lambda i, j: _unite(root, i, j))
        at = np.flatnonzero(root != np.arange(len(v)))
        back = v if not turn else v >> np.uint64(turn) | v << np.uint64(BITS - turn)
        return pd.DataFrame({"a": back[at].view(np.int64), "b": back[root[at]].view(np.int64)})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trie, part in whole_subtries(batches):
            yield forest(trie, part["v"].to_numpy())

    return subtries(distinct, budget).mapInPandas(walk, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """One row per row of docs: id, fp (signed long), component_id (smallest id reachable).

    Fingerprints link at `budget` or fewer differing bits; equal ones link too. Null and blank texts
    have fingerprint zero and link like any other. A null id takes part but is never the smallest
    (component_id is null only if all ids of a component are). Repeated rows stay repeated. Other
    columns of docs aren't looked at. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    classes = Table(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = Table(near_links(classes.df.select("fp"), budget), "simhash-links")
    stars = star_components(links.df.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links.drop()
    named = classes.df.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # both sides of each join are written down, so that Spark can split a frequent root or fingerprint
    roots = Table(named.select("fp", "root", "least"), "simhash-roots")
    linked = Table(roots.df.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    members = materialise(roots.df.select("fp", "root").join(linked.df, "root").select("fp", "component_id"), "simhash-members")
    for table in (classes, roots, linked):
        table.drop()
    return prints.join(members, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp):
    """The unsigned value of a signed 64-bit column as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _oracle() -> str:
    """DuckDB SQL for the rows of the registered query: all pairs of fingerprints, and all that is reachable."""
    ones = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(BITS))
    fp = " + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(BITS))
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM d),
x AS ({xxh64("g", "s", SEED)}),
b AS (SELECT r, count(*) AS n, {ones} FROM g JOIN x ON x.s = g.s GROUP BY r),
f AS (SELECT doc_id, coalesce({fp}, 0) AS fp FROM d LEFT JOIN b ON b.r = d.r),
u AS (SELECT DISTINCT fp FROM f),
e AS (SELECT p.fp AS a, q.fp AS b FROM u p JOIN u q ON bit_count(xor(p.fp, q.fp)) <= {BUDGET}),
c AS (SELECT fp AS a, fp AS b FROM u UNION SELECT e.b, c.b FROM c JOIN e ON e.a = c.a),
m AS (SELECT c.a AS fp, min(f.doc_id) AS component_id FROM c JOIN f ON f.fp = c.b GROUP BY c.a)
SELECT f.doc_id, lpad(lower(hex(f.fp)), 16, '0') AS fingerprint, m.component_id FROM f JOIN m ON m.fp = f.fp
"""


ORACLE_SQL = _oracle()
