"""Removal of repeated runs of lines by winnowing over line hashes. DataFrame operations only.

A line ends at a line break or at the end of a sentence, so that a passage inside a longer line of the file has
lines of its own. Every line begins a window, the shortest run of lines with `min_words` words or more (or
MOST_LINES lines, if those have fewer). The fingerprint of a window is the least hash of its lines: equal windows
have equal fingerprints at equal places, and neighbouring windows mostly share theirs, so a few selected lines
stand for all. The positions of the fingerprints are joined: those that stand at two places or more are the seeds of
matches. From a seed a match is extended both ways, by the windows before and after that hold the seed: each is
joined to the earliest position of the same lines. What isn't the earliest goes; overlapping windows form one run.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, Table, let, require

#: A repeated run of so many words goes, or of so many lines.
MIN_WORDS, MOST_LINES = 25, 8
#: Lines of fewer words are fingerprints only of windows without a longer line: they stand in too many texts.
SHORT = 4
#: What ends a line, with the signs and the white space after it; a line with its end.
END = rf"[.!?\n][.!?{SPACE_CLASS}]*"
PIECE = rf"[^.!?\n]*{END}|[^.!?\n]+"
#: Bits of a fingerprint that hold the words of its line, as far as they matter.
_WORD_BITS = 6


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.col(id_col).isNull(), F.col(text_col))


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends and the white space around them; those without any sign are none."""
    return F.array_remove(F.transform(F.split(text, END), lambda s: F.btrim(s, F.lit(SPACES))), F.lit(""))


def _fingerprint(line: Column) -> Column:
    """What the least is taken of: a flag for short lines, a hash, the number of words (single spaces plus 1)."""
    words = F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1, F.lit((1 << _WORD_BITS) - 1))
    hashed = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(1), line), 2 + _WORD_BITS), _WORD_BITS)
    return let(words, lambda w: hashed + w + F.when(w < SHORT, F.lit(1 << 62)).otherwise(F.lit(0).cast("long")))


def window_table(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, id, first, lines, fingerprint, at, content): the window of so many lines that begins with line number
    first; line number at has the fingerprint, content is a hash of the window's lines that doesn't depend on it."""
    if not 0 < min_words < 1 << _WORD_BITS:
        raise ValueError(f"min_words is at least 1 and below {1 << _WORD_BITS}")
    span = range(MOST_LINES)
    cut = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), lines_of(F.col(text_col)).alias("s"))
    hashed = cut.select("key", "id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"), F.transform("s", _fingerprint).alias("v"))
    ahead = [F.slice(c, F.lit(j + 1), F.greatest(F.size("h") - j, F.lit(0))).alias(f"{c}{j}") for c in "hv" for j in span]
    rows = hashed.select("key", "id", F.posexplode(F.arrays_zip(*ahead)).alias("first", "x")).select("key", "id", "first", "x.*")
    v, h = ([F.col(f"{c}{j}") for j in span] for c in "vh")
    words = [x.bitwiseAND((1 << _WORD_BITS) - 1) for x in v]

    def case(value) -> Column:
        """value(number of lines) of the shortest window; null where the text ends before it."""
        out = F.when(v[-1].isNotNull(), value(MOST_LINES))
        for n in range(MOST_LINES - 1, 0, -1):
            out = F.when(reduce(add, words[:n]) >= min_words, value(n)).otherwise(out)
        return out

    least = case(lambda n: F.least(*v[:n]) if n > 1 else v[0])
    at: Column = F.lit(MOST_LINES - 1)
    for j in range(MOST_LINES - 2, -1, -1):
        at = F.when(v[j] == least, j).otherwise(at)
    total = reduce(add, [F.coalesce(w, F.lit(0)) for w in words])
    whole = rows.where(v[-1].isNotNull() | (total >= min_words))
    return whole.select("key", "id", "first", case(F.lit).alias("lines"), least.alias("fingerprint"), (F.col("first") + at).alias("at"), case(lambda n: F.xxhash64(*h[:n])).alias("content"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, runs): runs is the ascending array of (first, last) line numbers, from 0, that go."""
    # the projection is too large a method for the JIT compiler if it is one with what surrounds it
    windows = Table(window_table(docs, id_col, text_col, min_words), "line-windows", {"spark.sql.codegen.hugeMethodLimit": "8000"})
    place = F.xxhash64("key", "at")
    # seeds and first places are written down, as Spark splits a frequent key of a join only without an aggregation in its stage
    seeds = Table(windows.df.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint"), "line-seeds")
    around = Table(windows.df.drop("at").join(seeds.df.hint("merge"), "fingerprint"), "line-matches")
    windows.drop()
    seeds.drop()

    position = F.struct("id", "key", "first")
    repeated = around.df.groupBy("fingerprint", "content").agg(F.min(position).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = Table(repeated, "line-first-places")
    joined = around.df.join(found.df.hint("merge"), ["fingerprint", "content"])
    later = joined.where(~position.eqNullSafe(F.col("earliest"))).select("key", "first", (F.col("first") + F.col("lines")).alias("end"))
    before = W.partitionBy("key").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    opened = later.withColumn("opens", F.coalesce((F.col("first") > F.max("end").over(before)).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("opens").over(W.partitionBy("key").orderBy("first")))
    runs = numbered.groupBy("key", "run").agg(F.min("first").alias("first"), (F.max("end") - 1).alias("last"))
    cut = Table(runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-runs")
    around.drop()
    found.drop()
    return cut.df


def _kept_text(text: Column, runs: Column) -> Column:
    """text without the lines of the runs and their ends; where a run ends a line of the file that begins before it,
    the line break stays."""

    def rebuilt(pieces: Column) -> Column:
        blank = F.when(F.rlike(pieces[0], F.lit(rf"[^.!?{SPACE_CLASS}]")), 0).otherwise(1)  # only a text's first piece can be no line

        def joined(shift: Column) -> Column:
            begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1 + shift))
            ends = F.concat(F.transform(runs, lambda r: r["first"] + shift), F.array(F.size(pieces)))
            broken = lambda i: F.contains(F.get(pieces, i), F.lit("\n"))

            def stretch(x: Column) -> Column:
                kept = F.array_join(F.slice(pieces, x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0))), "")
                closes = (x["b"] > 0) & (x["b"] < F.size(pieces)) & ~broken(x["b"] - 1) & broken(x["next"] - 1)
                return F.when(F.coalesce(closes, F.lit(False)), F.concat(kept, F.lit("\n"))).otherwise(kept)

            following = F.concat(F.slice(begins, F.lit(2), F.size(begins) - 1), F.array(F.lit(0)))
            return F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b"), following.alias("next")), stretch), "")

        return let(blank, joined)

    return let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), rebuilt)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text, runs, n_deleted) per row of docs: text without the runs of whole lines (numbers of the first and
    the last, from 0) that an earlier place has too; n_deleted counts the lines that went.

    A run is min_words words or more, or MOST_LINES lines. Places are ordered by id (nulls first), then line; texts
    that share an id by a hash of the text. Lines are compared without the signs that end them and the white space
    around them, windows by a 64-bit hash of all their lines and 56 bits of another
    hash of the line that is the fingerprint; words are single spaces plus 1. A null text stays null;
    texts without a line stay. Rows that repeat both id and text are one document and get the same result. An
    earlier occurrence may overlap the later one, so a line repeated on and on shrinks to its beginning. Work is
    in proportion to the lines, however long a text or frequent a line. Other columns of docs aren't looked at. An
    empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    runs = repeated_runs(docs, id_col, text_col, min_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _key(id_col, text_col).alias("key"))
    joined = rows.join(runs.hint("merge"), "key", "left")
    gone = F.aggregate("runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1)
    return joined.select(
        "id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(_kept_text(F.col("text"), F.col("runs"))).alias("text"),
        F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("runs"),
        F.coalesce(gone, F.lit(0)).alias("n_deleted"),
    )


_S = "\\x20\\x09-\\x0D"
#: DuckDB SQL for the rows of the registered query; windows are compared by their lines, not by hashes.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n][.!?{_S}]*|[^.!?\\n]+') AS p FROM documents),
a AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM d),
l AS (SELECT *, regexp_replace(piece, '^[{_S}]+|[.!?{_S}]+$', '', 'g') AS line FROM a WHERE regexp_matches(piece, '[^.!?{_S}]')),
c AS (SELECT doc_id, k, list(line) OVER w AS ls, list(len(line) - len(replace(line, ' ', '')) + 1) OVER w AS ws
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {MOST_LINES - 1} FOLLOWING)),
n AS (SELECT *, CASE {" ".join(f"WHEN len(ws) >= {i} AND list_sum(ws[1:{i}]) >= {MIN_WORDS} THEN {i}" for i in range(1, MOST_LINES))}
      WHEN len(ws) = {MOST_LINES} THEN {MOST_LINES} END AS n FROM c),
f AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY array_to_string(ls[1:n], chr(10)) ORDER BY doc_id, k) AS nth FROM n WHERE n IS NOT NULL),
g AS (SELECT a.*, coalesce(max(f.k + f.n) OVER (PARTITION BY a.doc_id ORDER BY a.k) > a.k, false) AS gone
      FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.k = a.k AND f.nth > 1),
h AS (SELECT *, lead(gone) OVER w AS goes_on, last_value(CASE WHEN NOT gone THEN piece END IGNORE NULLS) OVER
      (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(CASE WHEN NOT gone THEN piece WHEN NOT coalesce(goes_on, false)
      AND contains(piece, chr(10)) AND NOT contains(prior, chr(10)) THEN chr(10) ELSE '' END, '' ORDER BY k) AS text FROM h GROUP BY doc_id)
SELECT o.doc_id, coalesce(t.n, 0)::INTEGER AS n_deleted, length(CASE WHEN t.n > 0 THEN t.text ELSE o.text END)::INTEGER AS n_chars,
       md5(CASE WHEN t.n > 0 THEN t.text ELSE o.text END) AS text_md5
FROM documents o LEFT JOIN t ON t.doc_id = o.doc_id
"""
