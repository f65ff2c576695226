"""Benchmark decontamination by a positional inverted index over the training documents.

The index is partitioned by document: each row is a block of whole documents with, for every term,
the ascending positions at which it stands in the block. Documents of a block are one unused position
apart, so no phrase spans two of them. A phrase is found by taking the posting list of its rarest term
(postings over all blocks), shifting it by the term's offset, and intersecting it with the shifted lists of
the next rarer terms until it is empty or every term has been matched; all phrases of a turn at once, one
array operation for each place in the order of rarity.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, require

WINDOW = 13
#: Words of a block of the index, give or take a document.
BLOCK_WORDS = 1 << 20
#: Most test items, and bytes of them, that are matched, and broadcast, at a time; more are matched in turns.
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 20_000, 16 << 20
#: Candidate places that are looked at together; bounds a task's memory.
CHUNK = 1 << 20
#: Most test terms that an index is restricted to; beyond, it holds every term.
RESTRICT_TERMS = 1_000_000

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cases A-Z, then words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in UTF-8."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_WORD_BYTES).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: set[bytes] | None = None) -> DataFrame:
    """Positional index of docs: block, ids, n_words (both by document), terms, counts, positions.

    terms restricts the postings to a test vocabulary; None stores all terms. positions holds int32
    values, the lists of the terms one after the other. Every row of docs has its entry, with null and
    empty texts as zero words; ids may be null or repeat.
    """
    require(docs, id_col, text_col)
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.BinaryType()),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        names = list(known) if known is not None else None

        def fresh() -> tuple:
            local = known
            if local is None:
                local = defaultdict()
                local.default_factory = local.__len__
            return local, [], [], [], [], 0

        def row() -> pa.RecordBatch:
            t = np.concatenate(found) if found else np.empty(0, np.int64)
            p = np.concatenate(at) if at else np.empty(0, np.int64)
            order = np.argsort(t, kind="stable")
            counts = np.bincount(t, minlength=1) if len(t) else np.empty(0, np.int64)
            there = np.flatnonzero(counts)
            spelled = names if names is not None else list(local)
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | made], pa.int64()),
                    pa.array([ids], pa.list_(ids_type)),
                    pa.array([sizes], kind),
                    pa.array([[spelled[i].decode() for i in there.tolist()]], pa.list_(pa.string())),
                    pa.array([counts[there].tolist()], kind),
                    pa.array([p[order].astype("<i4").tobytes()], pa.binary()),
                ],
                ["block", "ids", "n_words", "terms", "counts", "positions"],
            )

        local, ids, sizes, found, at, base = fresh()
        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                if words and known is None:
                    found.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                    at.append(np.arange(base, base + len(words)))
                elif words:
                    t = np.array([known.get(w, -1) for w in words], np.int64)
                    stands = np.flatnonzero(t >= 0)
                    found.append(t[stands])
                    at.append(stands + base)
                ids.append(doc_id)
                sizes.append(len(words))
                base += len(words) + 1
                if base >= BLOCK_WORDS:
                    yield row()
                    made += 1
                    local, ids, sizes, found, at, base = fresh()
        if ids:
            yield row()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(blocks, schema)


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, postings) over all blocks."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").cast("long").alias("postings"))


@dataclass
class Phrases:
    """Windows of test items over a numbered vocabulary, in order of their rarest terms."""

    names: list[str]  #: ids of the items
    vocabulary: dict[bytes, int]
    rarity: np.ndarray  #: by term: its postings in the whole index
    words: np.ndarray  #: term numbers of all items, one after the other
    first: np.ndarray  #: by window: its first word in words
    length: np.ndarray
    owner: np.ndarray  #: by window: number of its item
    rarest: np.ndarray  #: by window: its rarest term
    shift: np.ndarray  #: by window: where that stands in it


def item_words(items: list[tuple[str, str]]) -> tuple[dict[str, int], dict[bytes, int], list[tuple[int, np.ndarray]]]:
    """(numbers of the items' ids, numbers of the terms, (item, terms) of every item with words)"""
    names: dict[str, int] = {}
    vocabulary: dict[bytes, int] = {}
    found = []
    for name, text in items:
        n = names.setdefault(name, len(names))
        w = words_of(text)
        if w:
            found.append((n, np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int32)))
    return names, vocabulary, found


def compile_phrases(names: dict[str, int], vocabulary: dict[bytes, int], found: list[tuple[int, np.ndarray]], postings: dict[bytes, int], length: int = WINDOW) -> Phrases:
    """Windows with a term that has no postings are left out: they stand nowhere."""
    rarity = np.array([postings.get(t, 0) for t in vocabulary], np.int64)
    parts, base = [], 0
    for n, w in found:
        size = min(length, len(w))
        runs = np.lib.stride_tricks.sliding_window_view(rarity[w], size)
        shift, first = runs.argmin(axis=1), np.arange(len(runs))
        there = np.flatnonzero(runs.min(axis=1) > 0)
        full = lambda x, k=len(there): np.full(k, x, np.int32)
        parts.append([x.astype(np.int32) for x in (first[there] + base, full(size), full(n), w[first[there] + shift[there]], shift[there])])
        base += len(w)
    first, size, owner, rarest, shift = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int32)] * 5
    by = np.argsort(rarest, kind="stable")
    words = np.concatenate([w for _, w in found]) if found else np.empty(0, np.int32)
    return Phrases(list(names), vocabulary, rarity, words, first[by], size[by], owner[by], rarest[by], shift[by])


@dataclass
class Block:
    """Posting lists of the test terms in a block, in order of the terms, and the term at every position."""

    begins: np.ndarray  #: by term: where its list begins
    places: np.ndarray
    at: np.ndarray


def _block(phrases: Phrases, terms: list[str], counts: np.ndarray, positions: bytes, size: int) -> Block:
    numbers = np.array([phrases.vocabulary.get(t.encode(), -1) for t in terms], np.int64)
    owner, places = np.repeat(numbers, counts), np.frombuffer(positions, "<i4")
    known = owner >= 0
    owner, places = owner[known], places[known]
    at = np.full(size, -1, np.int32)
    at[places] = owner
    by = np.argsort(owner, kind="stable")  # lists stay ascending
    return Block(np.searchsorted(owner[by], np.arange(len(phrases.vocabulary) + 1)), places[by].astype(np.int64), at)


def _candidates(phrases: Phrases, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, places of their rarest term) for all places of the rarest term, some CHUNK of them at a time."""
    counts = np.diff(block.begins)[phrases.rarest] if len(phrases.rarest) else np.empty(0, np.int64)
    live = np.flatnonzero(counts)
    ends = np.cumsum(counts[live])
    a = 0
    while a < len(live):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        k = live[a:b]
        n, before = counts[k], (ends[a - 1] if a else 0)
        inside = np.arange(ends[b - 1] - before) - np.repeat(ends[a:b] - n - before, n)
        places = block.places[np.repeat(block.begins[phrases.rarest[k]], n) + inside]
        for c in range(0, len(places), 4 * CHUNK):  # one term may have more than a chunk
            yield np.repeat(k, n)[c : c + 4 * CHUNK], places[c : c + 4 * CHUNK]
        a = b


def _terms_by_rarity(phrases: Phrases, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, offsets) of windows of one size, rarest first."""
    terms = phrases.words[phrases.first[windows][:, None] + np.arange(size)]
    by = np.argsort(phrases.rarity[terms], axis=1, kind="stable")
    return np.take_along_axis(terms, by, axis=1), by


def _exact(phrases: Phrases, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, starts) of the windows that occur in a block."""
    for windows_, places in _candidates(phrases, block):
        starts = places - phrases.shift[windows_]
        for size in np.unique(phrases.length[windows_]).tolist():
            mine = (phrases.length[windows_] == size) & (starts >= 0) & (starts + size <= len(block.at))
            k, s = windows_[mine], starts[mine]
            distinct, which = np.unique(k, return_inverse=True)
            terms, offsets = _terms_by_rarity(phrases, distinct, size)
            for j in range(1, size):
                if not len(k):
                    break
                holds = block.at[s + offsets[which, j]] == terms[which, j]
                k, s, which = k[holds], s[holds], which[holds]
            if len(k):
                yield k, s


def _near(phrases: Phrases, block: Block, slack: int, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, starts of least spans) where all terms stand, in any order, within length + slack words."""
    owner = np.repeat(np.arange(len(block.begins) - 1), np.diff(block.begins))
    keys = owner << 32 | block.places
    for windows_, places in _candidates(phrases, block):
        for size in np.unique(phrases.length[windows_]).tolist():
            mine, span = phrases.length[windows_] == size, size + slack
            k, c = windows_[mine], places[mine]
            distinct, which = np.unique(k, return_inverse=True)
            terms, _ = _terms_by_rarity(phrases, distinct, size)
            for j in range(1, size):  # the rarest term's places that have each other term within a span
                t = terms[which, j].astype(np.int64)
                i = np.searchsorted(keys, t << 32 | c)
                after, before = np.minimum(i, len(keys) - 1), np.maximum(i - 1, 0)
                close = (owner[after] == t) & (block.places[after] >= c) & (block.places[after] - c < span)
                close |= (owner[before] == t) & (block.places[before] < c) & (c - block.places[before] < span)
                k, c, which = k[close], c[close], which[close]
            found: set[tuple[int, int]] = set()
            for w, centre, row in zip(k.tolist(), c.tolist(), which.tolist(), strict=True):
                need = set(terms[row].tolist())
                d = int(np.searchsorted(begins, centre, "right"))
                first, end = max(centre - span + 1, int(begins[d - 1])), min(centre + span, int(begins[d]) if d < len(begins) else centre + span)
                here = block.at[first:end].tolist()
                for a in range(first, centre + 1):
                    if here[a - first] in need and need <= set(here[a - first : a - first + span]):
                        found.add((w, a))
            if found:
                rows = np.array(sorted(found))
                yield rows[:, 0], rows[:, 1]


#: Binary int32 lists of a block's matches.
LISTS = ("starts", "lengths", "docs", "items")


def _covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Whether each of the positions lies in one of the stretches."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(np.minimum(starts + lengths, size), minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def _matches(index: DataFrame, phrases: Phrases, slack: int | None, places: bool) -> DataFrame:
    """(block, ids, n_words, LISTS, item names), written down, so that the broadcast phrases are needed no more.

    With places, a start, a length, a document's number and an item's number for every match. Else the stretches of hit
    words, and each pair of a document and an item once: no more than the block has words, and pairs."""
    spark = index.sparkSession
    held = spark.sparkContext.broadcast(phrases)
    schema = T.StructType(
        [index.schema["block"], index.schema["ids"], index.schema["n_words"]]
        + [T.StructField(n, T.BinaryType()) for n in LISTS]
        + [T.StructField("names", T.ArrayType(T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph: Phrases = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r] for n in batch.schema.names}
                sizes = x["n_words"].values.to_numpy(zero_copy_only=False)
                block = _block(ph, x["terms"].as_py(), x["counts"].values.to_numpy(zero_copy_only=False).astype(np.int64), x["positions"].as_py(), int(sizes.sum()) + len(sizes))
                found = list(_exact(ph, block) if slack is None else _near(ph, block, slack, _document_starts(sizes)))
                k = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
                starts = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
                used, codes = np.unique(ph.owner[k], return_inverse=True)
                begins, lengths = _document_starts(sizes), ph.length[k].astype(np.int64) + (slack or 0)
                docs = np.searchsorted(begins, starts, "right") - 1
                if not places:
                    edges = np.flatnonzero(np.diff(_covered(starts, lengths, len(block.at)).astype(np.int8), prepend=0, append=0))
                    starts, lengths = edges[::2], edges[1::2] - edges[::2]
                    docs, codes = np.divmod(np.unique(docs * max(1, len(used)) + codes), max(1, len(used)))
                flat = (starts, lengths, docs, codes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(r, 1) for n in ("block", "ids", "n_words")]
                    + [pa.array([b.astype("<i4").tobytes()], pa.binary()) for b in flat]
                    + [pa.array([[ph.names[i] for i in used]], pa.list_(pa.string()))],
                    schema.fieldNames(),
                )

    out = materialise(index.mapInArrow(run, schema), "index-matches")
    held.destroy()
    return out


def _document_starts(n_words: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n_words + 1)[:-1]].astype(np.int64)


def _decode(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(x[n], "<i4").astype(np.int64) for n in LISTS)


def _turns(index: DataFrame, counts: DataFrame, items: DataFrame, id_col: str, text_col: str, length: int) -> Iterator[Phrases]:
    """The test items, as many at a time as may be broadcast, with the postings of their terms. The driver holds one
    turn and the partition of items it comes from. Items without an id or words are none."""
    spark = index.sparkSession

    def compiled(held: list[tuple[str, str]]) -> Phrases:
        names, vocabulary, found = item_words(held)
        wanted = spark.createDataFrame([(t.decode(),) for t in vocabulary], "term string")  # of a bounded number of bytes
        postings = {r["term"].encode(): r["postings"] for r in counts.join(F.broadcast(wanted), "term").collect()}
        return compile_phrases(names, vocabulary, found, postings, length)

    rows = items.select(F.col(id_col).cast("string"), F.col(text_col)).dropna()
    held: list[tuple[str, str]] = []
    room = ITEM_BYTES_AT_ONCE
    for name, text in rows.toLocalIterator():
        if held and (len(held) >= ITEMS_AT_ONCE or len(text) > room):
            yield compiled(held)
            held, room = [], ITEM_BYTES_AT_ONCE
        held.append((name, text))
        room -= len(text)
    yield compiled(held)


def test_terms(items: DataFrame, text_col: str = "text", most: int = RESTRICT_TERMS) -> set[bytes] | None:
    """The vocabulary of the test items, or None (no restriction) if it has over `most` terms."""
    lowered = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.explode(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("t")).where("t <> ''").distinct()
    found = [r[0].encode() for r in terms.limit(most + 1).collect()]
    return set(found) if len(found) <= most else None


def matched_blocks(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, length: int = WINDOW, slack: int | None = None, places: bool = False
) -> DataFrame:
    require(items, item_id_col, item_text_col)
    terms = test_terms(items, item_text_col)
    index = materialise(build_index(docs, id_col, text_col, terms), "positional-index")
    counts = materialise(document_frequency(index), "index-postings")
    parts = [_matches(index, p, slack, places) for p in _turns(index, counts, items, item_id_col, item_text_col, length)]
    return parts[0] if len(parts) == 1 else _merged(reduce(DataFrame.unionByName, parts))


def _merged(parts: DataFrame) -> DataFrame:
    """One row per block from those of several turns."""
    schema = parts.schema

    def join(table: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        lists: tuple[list, ...] = tuple([] for _ in LISTS)
        rows = table.to_pylist()
        for x in rows:
            *plain, i = _decode(x)
            code = np.array([names.setdefault(k, len(names)) for k in x["names"]] or [0])
            for held, new in zip(lists, (*plain, code[i]), strict=True):
                held.append(new)
        flat = {k: np.concatenate(v).astype("<i4").tobytes() for k, v in zip(LISTS, lists, strict=True)}
        return pa.Table.from_pylist([rows[0] | flat | {"names": list(names)}], table.schema)

    return parts.groupBy("block").applyInArrow(join, schema)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    length: int = WINDOW,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted ids, as strings, of the test items that
    have a window in the text), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A window is `length` consecutive words of an item, or a shorter item whole. A word is hit if it stands
    in any occurrence of a window. Null and empty texts have no words and are never contaminated; items
    with a null id, a null text or no words have no windows; items that repeat an id count once. An empty
    docs gives an empty result, an empty items no hits.
    """
    blocks = matched_blocks(docs, items, id_col, text_col, item_id_col, item_text_col, length)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                n = np.array(x["n_words"], np.int64)
                begins = _document_starts(n)
                starts, lengths, docs_, items_ = _decode(x)
                hit = np.r_[0, np.cumsum(_covered(starts, lengths, int(begins[-1] + n[-1] + 1)))]
                found: list[set[str]] = [set() for _ in n]
                for d, i in zip(docs_.tolist(), items_.tolist(), strict=True):
                    found[d].add(x["names"][i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x["ids"], batch.schema.field("ids").type.value_type),
                        pa.array(n),
                        pa.array(hit[begins + n] - hit[begins]),
                        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                    ],
                    ["id", "n_words", "n_hit", "items"],
                )

    out = blocks.mapInArrow(run, schema)
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    length: int = WINDOW,
    slack: int | None = None,
) -> DataFrame:
    """(id, item, start, n_words): places of the windows of the items, start counted in words from 0.

    With slack None the phrase stands there exactly. Else all its distinct words stand, in any order,
    within length + slack words from start.
    """
    blocks = matched_blocks(docs, items, id_col, text_col, item_id_col, item_text_col, length, slack, places=True)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                begins = _document_starts(np.array(x["n_words"], np.int64))
                starts, lengths, doc, items_ = _decode(x)
                if not len(starts):
                    continue
                rows = np.unique(np.stack([doc, items_, starts - begins[doc], lengths]), axis=1)
                ends = np.array(x["n_words"], np.int64)[rows[0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["ids"][d] for d in rows[0]], batch.schema.field("ids").type.value_type),
                        pa.array([x["names"][i] for i in rows[1]], pa.string()),
                        pa.array(rows[2]),
                        pa.array(np.minimum(rows[3], ends - rows[2])),
                    ],
                    ["id", "item", "start", "n_words"],
                )

    return blocks.mapInArrow(run, schema)


def _oracle() -> str:
    """DuckDB SQL for the rows of the registered query: n-grams of the documents joined to the items' windows."""
    words = lambda c: f"""regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""  # noqa: E731
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT q, item, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM (SELECT row_number() OVER () AS q, * FROM b) y),
s AS (SELECT DISTINCT item, k, array_to_string(run, ' ') AS gram
      FROM (SELECT item, least(n, {WINDOW}) AS k, list(x) OVER (PARTITION BY q ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS run FROM v) y
      WHERE len(run) = k),
e AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS run
      FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) y),
g AS (SELECT r, i, k, array_to_string(run[1:k], ' ') AS gram FROM e, (SELECT DISTINCT k FROM s) y WHERE len(run) >= k),
h AS (SELECT g.r, g.i, g.k, s.item FROM g JOIN s ON s.k = g.k AND s.gram = g.gram),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) x GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) x GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
"""


ORACLE_SQL = _oracle()
