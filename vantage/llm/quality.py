"""Quality scores by Bradley-Terry ranking: pairs of a better and a worse document, logistic loss on the
difference of their features, and a threshold at a quantile of the scores."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require
from .labelled import held_out, training_rows

#: Most labelled rows of either class that the ranking is fitted on, and preference pairs drawn from them.
PER_CLASS, PAIRS = 8_000, 100_000
#: The score at the threshold.
CUT = 0.3
FEATURES = ("length", "word_length", "symbols", "bars", "exclamations", "capitals", "runs", "repeats", "lines", "non_ascii", "digits", "stops")
_DIGITS = str.maketrans("", "", "0123456789")


def features(text: str | None) -> list[float]:
    """Whole-text features; null and blank texts have all zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda k: float(np.log1p(100.0 * k / n))
    lines = [x for x in text.split("\n") if x]
    count = text.count
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / n)),
        share(sum(map(count, "#*$%&<>"))),
        share(count("|")),
        share(count("!")),
        share(sum(map(str.isupper, words))),
        share(sum(map(eq, words, words[1:]))),
        share(n - len(set(words))),
        float(np.log1p(100.0 * (len(lines) - len(set(lines))) / max(1, len(lines)))),
        float(np.log1p(100.0 * (len(text.encode()) - len(text)) / len(text))),
        share(len(text) - len(text.translate(_DIGITS))),
        share(count(".")),
    ]


@dataclass
class Ranking:
    """score = logistic(scale * (weights . standardised features - threshold) + logit(CUT))"""

    centre: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ np.asarray(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scale * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def bradley_terry(better: np.ndarray, worse: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-w . (better - worse))) + l2 |w|^2 / 2, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(p @ d) / len(d) + l2 * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Midpoint of the two neighbouring values between which the weight passes q."""
    order = np.argsort(values, kind="stable")
    v, below = values[order], np.cumsum(weights[order]) / weights.sum()
    i = int(np.argmin(np.abs(below - q)))
    return float((v[i] + v[min(i + 1, len(v) - 1)]) / 2)


def fit_ranking(x: np.ndarray, y: np.ndarray, prevalence: float, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """prevalence: share of label 0 in the whole labelled table; the threshold is that quantile of the scores."""
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / spread, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):  # nothing to prefer: every document stays
        return Ranking(centre.tolist(), spread.tolist(), [0.0] * x.shape[1], -1.0, 1.0)
    rng = np.random.default_rng(seed)
    w = bradley_terry(good[rng.integers(len(good), size=pairs)], bad[rng.integers(len(bad), size=pairs)])
    raw = z @ w
    weights = np.where(y == 1, (1 - prevalence) / len(good), prevalence / len(bad))
    return Ranking(centre.tolist(), spread.tolist(), w.tolist(), weighted_quantile(raw, weights, prevalence), 1.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Ranking:
    """Fits on at most per_class labelled rows of either class; the driver gets their features only."""
    require(docs, id_col, text_col)
    chosen, counts = training_rows(labels, label_col, per_class, id_col)
    measure = F.pandas_udf(lambda t: pd.Series([features(x) for x in t]), "array<double>")
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # 2 * per_class rows at most
        .select("id", "y", measure("text").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (str(r["id"]), r["y"], r["x"]))
    if not rows:
        k = len(FEATURES)
        return Ranking([0.0] * k, [1.0] * k, [0.0] * k, -1.0, 1.0)
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    return fit_ranking(x, y, counts[0] / max(1, counts[0] + counts[1]))


def score_column(model: Ranking, text_col: str) -> Column:
    """The score of a whole text, 0 to 1; null and blank texts have one too."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts])) if len(texts) else [], dtype=float)

    return F.pandas_udf(batch, "double")(text_col)


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, from the whole text only. Null and blank texts
    have a score too; null ids and repeated rows stay. Without labels of both classes all texts are kept."""
    require(docs, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("id"), score_column(model, text_col).alias("score"))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
