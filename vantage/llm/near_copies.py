"""Near copies at a similarity of five-word shingles, by SimHash: the trie self-join of `simhash` over a wider signature.

A document has two signatures. The 64 bits of its distinct words change little when a few words do, and are joined by the
tries with an error budget; the pairs that the tries find are judged by 256 bits of its distinct five-word shingles, whose
expected share of different bits is the angle between the two sets of shingles. Judging takes place where the
pairs are found, and only a spanning forest of the pairs that hold leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Table, materialise, require
from .components import star_components

SHINGLE, SIMILARITY, WORD_BUDGET = 5, 0.8, 5
#: 64-bit words of the shingles' signature, and standard deviations that a pair at the similarity may lie off.
WIDE, MARGIN = 4, 0.5
_S = [f"s{k}" for k in range(WIDE)]
_GOLDEN = 0x9E3779B97F4A7C15


def most_different(similarity: float = SIMILARITY, bits: int = 64 * WIDE, margin: float = MARGIN) -> int:
    """Different bits that two signatures may have: sets of one size and this Jaccard similarity have the cosine
    2 s / (1 + s), and each bit differs with the probability angle / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash, by the finaliser of splitmix64."""
    z = h + np.uint64(k * _GOLDEN % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(octets), 4096):
        ones += np.unpackbits(octets[a : a + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def signatures_of(text: str | None) -> list[int]:
    """Unsigned 64-bit numbers: that of the words, then those of the shingles. All 0 for null and for no words."""
    words = text.encode().lower().split() if text else []
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return [0] * (1 + WIDE)
    own = np.fromiter((digest(w, simhash.SEED) for w in set(words)), np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        h = np.array([digest(joined, simhash.SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        spans = zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)
        h = np.unique(np.fromiter((digest(joined[a:b], simhash.SEED) for a, b in spans), np.uint64, n - SHINGLE + 1))
    return [_majority(own), *(_majority(_mixed(h, k + 1)) for k in range(WIDE))]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w, s0, s1, ...) as signed numbers."""
    require(docs, id_col, text_col)
    names = ["w", *_S]

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([signatures_of(t) for t in texts], np.uint64).reshape(-1, len(names))
        return pd.DataFrame(dict(zip(names, rows.view(np.int64).T, strict=True)))

    return docs.select(F.col(id_col).alias("id"), both(F.col(text_col)).alias("x")).select("id", *(F.col("x")[c].alias(c) for c in names))


class Forest:
    """Sets of the members of a subtrie, joined as pairs of them prove to be near. Members are sorted by their words'
    signature; those that share one are a group. The trie gives pairs of groups, whose members are compared unless
    they are in one set already: with many copies that is soon so."""

    def __init__(self, v: np.ndarray, s: np.ndarray, limit: int):
        self.s, self.limit, self.root = s, limit, np.arange(len(v))
        self.low = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        self.high = np.r_[self.low[1:], len(v)]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.s[i] ^ self.s[j]).sum(axis=1, dtype=np.int64) <= self.limit

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare the members of the groups a[k] and b[k], for every k."""
        single = (self.high[a] - self.low[a] == 1) & (self.high[b] - self.low[b] == 1)
        i, j = self.low[a[single]], self.low[b[single]]
        i, j = (x[self.root[i] != self.root[j]] for x in (i, j))
        close = self.near(i, j)
        simhash._unite(self.root, i[close], j[close])
        least, most = np.minimum.reduceat(self.root, self.low), np.maximum.reduceat(self.root, self.low)
        one = ~single & ~((least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]))
        for x, y in zip(a[one].tolist(), b[one].tolist(), strict=True):
            self.cross(np.arange(self.low[x], self.high[x]), np.arange(self.low[y], self.high[y]))

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare every member of a with every one of b that isn't in its set; each with the first of b beforehand."""
        first = np.full(len(a), b[0])
        close = self.near(a, first) & (a != first)
        simhash._unite(self.root, a[close], first[close])
        ra, rb = self.root[a], self.root[b]
        values, counts = np.unique(np.r_[ra, rb], return_counts=True)
        main = values[counts.argmax()]
        for x, y in ((a[ra != main], b), (a[ra == main], b[rb != main])):
            step = max(1, simhash.CHUNK // max(1, len(y)))
            for k in range(0, len(x) if len(y) else 0, step):
                part = x[k : k + step]
                i, j = np.repeat(part, len(y)), np.tile(y, len(part))
                open_ = self.root[i] != self.root[j]
                i, j = i[open_], j[open_]
                close = self.near(i, j)
                simhash._unite(self.root, i[close], j[close])


def near_links(classes: DataFrame, limit: int, budget: int = WORD_BUDGET) -> DataFrame:
    """(u, v): a spanning forest, per subtrie, of the classes (cid, w, s0, ..) whose words' signatures differ in at most
    `budget` bits and whose shingles' signatures in at most `limit`."""
    blocks = simhash._blocks(simhash.BITS, budget + 1)
    rows = simhash.subtries(classes.withColumnRenamed("w", "fp"), budget, "cid", *_S)

    def forest(trie: int, part: pd.DataFrame) -> pd.DataFrame:
        _, below = blocks[trie]
        v = part["v"].to_numpy().view(np.uint64)
        by = np.argsort(v, kind="stable")
        v, s, cid = v[by], part[_S].to_numpy().view(np.uint64)[by], part["cid"].to_numpy()[by]
        f = Forest(v, s, limit)
        for k in np.flatnonzero(f.high - f.low > 1).tolist():
            f.cross(*[np.arange(f.low[k], f.high[k])] * 2)
        simhash.trie_links(v[f.low], below, budget, f.link)
        at = np.flatnonzero(f.root != np.arange(len(v)))
        return pd.DataFrame({"u": cid[at], "v": cid[f.root[at]]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trie, part in simhash.whole_subtries(batches):
            yield forest(trie, part)

    return rows.mapInPandas(walk, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, budget: int = WORD_BUDGET) -> DataFrame:
    """One row per row of docs: id, component_id (smallest id reachable).

    Two texts link if their sets of five-word shingles have about the Jaccard similarity or more, as 256 bits tell
    (a pair at it links two times in three, one clearly below doesn't), and the signatures of their words differ in at
    most `budget` bits. Words are lower-cased (A-Z); fewer than five words are one shingle. Null and blank texts link
    with each other. A null id takes part but is never the smallest (component_id is null only if all ids of a
    component are). Repeated rows stay repeated. Other columns of docs aren't looked at. An empty table gives an
    empty result.
    """
    prints = materialise(signatures(docs, id_col, text_col), "copies-prints")
    keys = ["w", *_S]
    classes = Table(prints.groupBy(*keys).agg(F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "copies-classes")
    links = Table(near_links(classes.df.select("cid", *keys), most_different(similarity), budget), "copies-links")
    stars = star_components(links.df)
    links.drop()
    named = classes.df.join(stars.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    # both sides of each join are written down, so that Spark can split a frequent root or signature
    roots = Table(named.select(*keys, "root", "least"), "copies-roots")
    linked = Table(roots.df.groupBy("root").agg(F.min("least").alias("component_id")), "copies-components")
    members = materialise(roots.df.join(linked.df, "root").select(*keys, "component_id"), "copies-members")
    for table in (classes, roots, linked):
        table.drop()
    return prints.join(members, keys).select("id", "component_id")
