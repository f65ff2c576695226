"""Quality rules: a threshold table compiled into one projection of native functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, require, words_sql

# Frequent short words of four languages.
STOP_WORDS = (
    "the of and to in is was that it for on with as at be a "
    "der die das und den von mit auf für ist zu ein eine nicht "
    "de la le les des un une et que qui est dans pour du en "
    "el los las y por para con no se del su lo es"
)


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high; a rule holds where the denominator is 0."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        top, bottom = F.col(self.numerator).cast("double"), F.col(self.denominator).cast("double")
        checks = F.lit(True)
        if self.low is not None:
            checks = checks & (top >= self.low * bottom)
        if self.high is not None:
            checks = checks & (top <= self.high * bottom)
        return (bottom == 0) | checks


#: The threshold table. Columns: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_upper, n_bangs.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.005, None),
    Rule("capitals", "n_upper", "word_chars", None, 0.3),
    Rule("exclamations", "n_bangs", "n_words", None, 0.1),
)
#: Base rules of the contract: fewest words, and the largest percentage of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def repeated_words(grams: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, from `sorted`, the (hash, place) of all windows in order."""
    n = F.size(grams)
    twice = F.filter(
        grams,
        lambda x, i: ((i > 0) & (F.get(grams, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(grams, i + 1)["h"] == x["h"])),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        places,
        start,
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["to"])).alias("n"), (i + 3).alias("to")),
        lambda s: s["n"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id and the columns of the threshold table, long) per row of docs; a null text has no words.

    3-word windows are compared by a 64-bit hash of their words.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), words_sql(F.col(text_col)).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stops = sorted({w for s in STOP_WORDS.split() for w in (s, s.capitalize())})
    only = lambda kind: F.char_length(F.regexp_replace("t", f"[^{kind}]+", ""))
    grams = let(
        F.col("words"),
        lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    first = rows.select(
        "id",
        F.size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        only("!").alias("n_bangs"),
        only("\\p{Lu}").alias("n_upper"),
        lines.alias("lines"),
        F.size(F.filter("words", lambda w: w.isin(stops))).alias("n_stop_words"),
        F.when(F.size("words") >= 3, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    # only texts with some window twice are sorted
    pairs = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    second = first.withColumn("pairs", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), pairs))
    repeated = F.coalesce(F.when(F.col("pairs").isNotNull(), let(F.col("pairs"), repeated_words)), F.lit(0))
    found = {
        **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_bangs", "n_upper", "n_stop_words")},
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated,
    }
    # filters on the measures stay above the explode; pushed below, they would compute every array again
    one = F.explode(F.array(F.struct(*(c.cast("long").alias(n) for n, c in found.items()))))
    return second.select("id", one.alias("m")).select("id", "m.*")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() and base_failed, failed (names of the rules of the table that don't hold), kept.

    kept: neither a base rule nor a rule of the table fails. Null, empty and short texts fail the base
    rules; null ids and repeated rows stay.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in rules)))
    judged = measures(docs, id_col, text_col).withColumns({"base_failed": base, "failed": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def _oracle() -> str:
    """DuckDB SQL for the rows of the registered query, from the same threshold table."""
    word = r"[^\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS.split() for w in (s, s.capitalize())}))
    checks = []
    for r in RULES:
        low = f"{r.numerator} >= {r.low}::DOUBLE * {r.denominator}" if r.low is not None else "true"
        high = f"{r.numerator} <= {r.high}::DOUBLE * {r.denominator}" if r.high is not None else "true"
        checks.append(f"({r.denominator} = 0 OR ({low} AND {high}))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) x WHERE n > 1),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) x GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
         length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN p ON p.r = d.r),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept
FROM b
"""


ORACLE_SQL = _oracle()
