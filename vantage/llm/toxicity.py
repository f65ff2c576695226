"""Toxicity by multiple-instance learning: a document is a bag of sentences, labelled as a whole.

A sentence is toxic with the probability by which its terms raise logistic(bias + weights of its terms) above
logistic(bias): a sentence without a term of the model has none, so a long text of such sentences is no more
toxic than a short one. A document is toxic with the noisy-or of its sentences and of a background that it has
once, whatever its length. Fitted on document labels, the model then locates the offending sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require
from .labelled import held_out, training_rows

#: Most labelled rows of either class in the fit, and terms of the model.
PER_CLASS, TERMS = 5_000, 400
#: Rows with a term, and its G-squared against the label (1 in 10,000 by chance), for it to count.
LEAST_DOCS, LEAST_G2 = 8, 15.1
#: Precision of the prior on the weights.
PRIOR = 0.04

_ENDS = b".!?\n"
_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in _ENDS else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence (ended by . ! ? or a line end) that has any."""
    if not text:
        return []
    return [w for s in text.encode().translate(_BYTES).split(b"\n") if (w := s.split())]


def _bag(text: str | None, vocabulary: dict[bytes, int]) -> list[list[int]]:
    """Term numbers of each sentence that has a term of the model."""
    if not text:
        return []
    raw = text.encode().translate(_BYTES)
    if vocabulary.keys().isdisjoint(raw.split()):
        return []
    return [hit for s in raw.split(b"\n") if (hit := sorted({vocabulary[w] for w in s.split() if w in vocabulary}))]


@dataclass
class NoisyOr:
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bias: float
    background: float  #: log-odds of a document without any term

    def hazard(self, z: np.ndarray | float) -> np.ndarray | float:
        """-log(1 - p) of sentences, from their sums of weights and the bias."""
        return np.maximum(0.0, np.logaddexp(0, z) - np.logaddexp(0, self.bias))

    def document(self, text: str | None) -> tuple[float, int, int | None]:
        """(probability, offending sentences, the first one's number from 0 among those with words)"""
        hits = _bag(text, self.vocabulary)
        own = self.hazard(np.array([self.weights[h].sum() for h in hits]) + self.bias)
        worst = int((own > np.log(2)).sum())
        first = None
        if worst:
            first = next(i for i, s in enumerate(sentences(text)) if self.sentence(s) > 0.5)
        return float(-np.expm1(-own.sum() - np.logaddexp(0, self.background))), worst, first

    def sentence(self, words: list[bytes]) -> float:
        known = sorted({self.vocabulary[w] for w in words if w in self.vocabulary})
        return float(-np.expm1(-self.hazard(self.bias + self.weights[known].sum()))) if known else 0.0


def fit(bags: list[list[list[int]]], y: np.ndarray, weight: np.ndarray, terms: int, prior: float = PRIOR, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float, float]:
    """Weights, bias and background with the least weighted negative log-likelihood of the document labels, by Adam.

    prior is the precision of a Gaussian prior on each weight; its share falls with the number of documents."""
    l2 = prior / max(1, len(bags))
    owner = np.repeat(np.arange(len(bags)), [len(h) for h in bags]).astype(np.int64)
    sizes = np.array([len(s) for h in bags for s in h], np.int64)
    flat = np.array([t for h in bags for s in h for t in s], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.zeros(terms + 2)
    theta[-2:] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        w, b, background = theta[:-2], theta[-2], theta[-1]
        z = np.bincount(row, w[flat], minlength=len(sizes)) + b
        above = z >= b
        hazard = np.where(above, np.logaddexp(0, z) - np.logaddexp(0, b), 0.0)
        total = np.bincount(owner, hazard, minlength=len(bags)) + np.logaddexp(0, background)
        # d loss / d total: 1 for label 0, -1 / (exp(total) - 1) for label 1
        slope = weight * np.where(y == 1, -1 / np.maximum(np.expm1(total), 1e-9), 1.0)
        own = np.where(above, slope[owner], 0.0)
        gz = own * logistic(z)
        gradient = np.zeros_like(theta)
        gradient[:-2] = np.bincount(flat, gz[row], minlength=terms) + l2 * w
        gradient[-2] = gz.sum() - own.sum() * logistic(b)
        gradient[-1] = slope.sum() * logistic(background)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, terms: int = TERMS) -> NoisyOr:
    """Fits on at most per_class labelled rows of either class: the terms with the highest G-squared against
    the label are chosen in Spark; the driver gets term numbers only."""
    require(docs, id_col, text_col)
    chosen, counts = training_rows(labels, label_col, per_class, id_col)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").cache()  # bounded: 2 * per_class rows
    try:
        n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        if not n.get(0) or not n.get(1):
            return NoisyOr({}, np.zeros(0), -12.0, -12.0)
        distinct = F.pandas_udf(lambda t: pd.Series([sorted(x.decode() for x in {w for s in sentences(d) for w in s}) for d in t]), "array<string>")
        seen = sample.select("y", F.explode(distinct("text")).alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        a, b, n1, n0 = F.col("a"), F.col("b"), float(n[1]), float(n[0])
        df = a + b
        total = n1 + n0
        g2 = cell(a, df * n1 / total) + cell(b, df * n0 / total) + cell(n1 - a, (total - df) * n1 / total) + cell(n0 - b, (total - df) * n0 / total)
        more = a / n1 > b / n0  # than expected; other terms can't make a sentence toxic
        top = seen.where((df >= LEAST_DOCS) & more).select("term", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "term").limit(terms).collect()
        vocabulary = {r["term"].encode(): i for i, r in enumerate(top)}

        bags = F.pandas_udf(lambda texts: pd.Series([_bag(t, vocabulary) for t in texts]), "array<array<int>>")
        got = sample.select("id", "y", bags("text").alias("hits")).collect()
    finally:
        sample.unpersist()
    got.sort(key=lambda r: (str(r["id"]), r["y"], str(r["hits"])))
    y = np.array([r["y"] for r in got])
    share = np.array([counts[0], counts[1]], float) / (counts[0] + counts[1])
    weight = share[y] / np.array([n[0], n[1]])[y]
    return NoisyOr(vocabulary, *fit([r["hits"] for r in got], y, weight, len(vocabulary)))


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, n_offending, first_offending) per row of docs, from the whole text.

    n_offending counts sentences whose own probability is over one half, first_offending is the number of
    the first (null if none). Null and blank texts, and texts of any length without a term of the model, score the
    background, which is small. Null ids and repeated rows stay. Without labels of both classes nothing is called
    toxic.
    """
    require(docs, id_col, text_col)

    def batch(texts: pd.Series) -> pd.DataFrame:
        rows = [model.document(t) for t in texts]
        return pd.DataFrame(
            {
                "score": np.array([r[0] for r in rows], float),
                "n_offending": np.array([r[1] for r in rows], np.int64),
                "first_offending": pd.array([r[2] for r in rows], dtype="Int64"),
            }
        )

    scored = docs.select(F.col(id_col).alias("id"), F.pandas_udf(batch, "score double, n_offending long, first_offending long")(text_col).alias("s"))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_offending", "s.first_offending")


def offending_sentences(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, sentence, score, words): each sentence whose own probability is over `least`."""
    require(docs, id_col, text_col)

    def find(text: str | None) -> list[tuple[int, float, str]]:
        scored = ((i, model.sentence(s), b" ".join(s).decode()) for i, s in enumerate(sentences(text)))
        return [x for x in scored if x[1] > least]

    udf = F.pandas_udf(
        lambda t: pd.Series([[{"sentence": i, "score": p, "words": w} for i, p, w in find(x)] for x in t]),
        "array<struct<sentence: long, score: double, words: string>>",
    )
    return docs.select(F.col(id_col).alias("id"), F.explode(udf(text_col)).alias("s")).select("id", "s.*")
