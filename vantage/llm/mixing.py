"""Mixing to target weights with soft memberships. DataFrame operations only.

A naive Bayes classifier fitted on a labelled table gives every document a posterior over the domains.
Projected-gradient least squares then finds nonnegative rates of the documents for which the expected
tokens of each domain match the targets. The rates stay in a table; the driver sees one number a domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, let, materialise, require

#: Most labelled rows of a domain and tokens that the classifier is fitted on; rows with a token for it to count.
PER_DOMAIN, TOKENS, LEAST_ROWS = 2_500, 48, 10
#: Most passes of the solver, its ridge as a share of all tokens, and what is left of the gradient, as a share of the targets.
STEPS, RIDGE, TOLERANCE = 200, 1e-8, 1e-8
#: Shares of all tokens: a gradient that sums of doubles can't tell from zero, one that is left where no step lowers the
#: error any more, and what posteriors leave of a domain of which there is no document.
ROUNDING, STALLED, DUST = 1e-14, 1e-9, 1e-9


def featured(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, tokens, features, and columns to keep): tokens counts words and runs of other signs, 0 for null and
    blank texts; features are their distinct kinds and two marks, for repetition and for capitals."""
    apart = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"([^\p{L}\p{N}\s]+)", " $1 "))
    rows = docs.select(F.col(id_col).alias("id"), *keep, apart.alias("apart"))
    cut = rows.select("id", *keep, "apart", F.split(F.lower("apart"), r"\s+").alias("pieces"))
    found = cut.select("id", *keep, "apart", F.when(F.col("apart") == "", 0).otherwise(F.size("pieces")).cast("long").alias("tokens"), F.array_distinct("pieces").alias("kinds"))
    tenth = lambda part, whole: F.coalesce(F.floor(10 * part / whole), F.lit(0)).cast("string")
    capitals = F.char_length(F.regexp_replace("apart", r"[^\p{Lu}]+", ""))
    marks = F.array(
        F.concat(F.lit("\x01new"), F.when(F.col("tokens") > 0, tenth(F.size("kinds"), F.col("tokens"))).otherwise("0")),
        F.concat(F.lit("\x01cap"), F.when(F.col("tokens") > 0, tenth(capitals, F.char_length("apart"))).otherwise("0")),
    )
    return found.select("id", *keep, "tokens", F.concat("kinds", marks).alias("features"))


@dataclass
class NaiveBayes:
    """log posterior of domain d = prior[d] + sum of weight[token][d] over the model's tokens in a text."""

    domains: list[str]
    prior: list[float]
    weight: dict[str, list[float]]

    def posteriors(self, features: Column) -> Column:
        """An array with a posterior for each domain; they add up to 1. The sums over a text's tokens stand once in the
        plan: its size is what executors need to compile it."""

        def shares(logs: list[Column]) -> Column:
            top = F.greatest(*logs) if len(logs) > 1 else logs[0]
            return let(F.array(*(F.exp(x - top) for x in logs)), lambda parts: F.transform(parts, lambda p: p / total(parts)))

        def total(parts: Column) -> Column:
            out = parts[0]
            for i in range(1, len(self.domains)):
                out = out + parts[i]
            return out

        if not self.weight:
            return shares([F.lit(p) for p in self.prior])
        names = list(self.weight)
        held = F.array_intersect(features, F.array(*map(F.lit, names)))
        zero = F.struct(*(F.lit(p).alias(f"d{i}") for i, p in enumerate(self.prior)))
        table = F.create_map(*(x for n in names for x in (F.lit(n), F.struct(*(F.lit(w).alias(f"d{i}") for i, w in enumerate(self.weight[n]))))))

        def add(state: Column, token: Column) -> Column:
            w = F.element_at(table, token)
            return F.struct(*((state[f"d{i}"] + w[f"d{i}"]).alias(f"d{i}") for i in range(len(self.domains))))

        return let(F.aggregate(held, zero, add), lambda summed: shares([summed[f"d{i}"] for i in range(len(self.domains))]))


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = PER_DOMAIN, tokens: int = TOKENS) -> NaiveBayes:
    """labelled: (id, domain). At most per_domain rows of each domain, by a hash of the id, are fitted on; the
    prior is the share of the domain in the whole labelled table. Rows with nulls are left out."""
    require(docs, id_col, text_col)
    require(labelled, id_col, domain_col)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).dropna()
    counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        raise ValueError("the labelled table has no usable rows")
    chosen = None
    for d in domains:
        some = rows.where(F.col("domain") == d).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_domain)
        chosen = some if chosen is None else chosen.union(some)
    wanted = docs.select(id_col, text_col).join(F.broadcast(chosen.select(F.col("id").alias(id_col), "domain")), id_col)  # per_domain rows a domain
    sample = Table(featured(wanted, id_col, text_col, "domain").select("domain", "features"), "mix-sample")
    n = {r["domain"]: r["count"] for r in sample.df.groupBy("domain").count().collect()}
    total = sum(n.values())
    seen = sample.df.select("domain", F.explode("features").alias("token")).groupBy("token").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    have = [F.col(f"n{i}") for i in range(len(domains))]
    df = have[0]
    for c in have[1:]:
        df = df + c

    def cell(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    counted = Table(seen.where((df >= LEAST_ROWS) & (F.col("token") != "")), "mix-tokens")
    best = {}
    for i, d in enumerate(domains):  # the tokens that tell the domain from all others, by G-squared
        k = float(n.get(d, 0))
        if not k or k == total:
            continue
        other = df - have[i]
        cells = [(have[i], df * k / total), (k - have[i], (total - df) * k / total), (other, df * (total - k) / total), (total - k - other, (total - df) * (total - k) / total)]
        g2 = cell(*cells[0]) + cell(*cells[1]) + cell(*cells[2]) + cell(*cells[3])
        marks = counted.df.where(have[i] * total > df * k).select("token", *have, g2.alias("g2"))
        best |= {r["token"]: r for r in marks.orderBy(F.desc("g2"), "token").limit(-(-tokens // len(domains))).collect()}
    counted.drop()
    sample.drop()
    every = sum(counts.values())
    prior = [math.log(counts[d] / every) for d in domains]
    weight: dict[str, list[float]] = {}
    for _, r in sorted(best.items()):
        logit = []
        for i, d in enumerate(domains):
            p = (r[f"n{i}"] + 0.5) / (n.get(d, 0) + 1.0)
            prior[i] += math.log1p(-p)
            logit.append(math.log(p) - math.log1p(-p))
        weight[r["token"]] = logit
    return NaiveBayes(domains, prior, weight)


def memberships(docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p0, p1, ...): posteriors in the order of model.domains."""
    rows = featured(docs, id_col, text_col)
    return rows.select("id", "tokens", model.posteriors(F.col("features")).alias("p")).select(
        "id", "tokens", *(F.col("p")[i].alias(f"p{i}") for i in range(len(model.domains)))
    )


def rate_column(domains: int, push: list[float]) -> Column:
    """The rate of a document for one push a domain: a projected gradient step of that length from rate 1."""
    moved = F.lit(1.0)
    for i, x in enumerate(push):
        moved = moved + F.col(f"p{i}") * F.lit(float(x))
    return F.greatest(F.lit(0.0), moved)


def fit_rates(held: DataFrame, domains: int, targets: list[float], steps: int = STEPS) -> DataFrame:
    """The rows of held (tokens, p0, p1, ...) with the column rate >= 0: sum(rate * tokens * p[d]) over all rows is as
    near to targets[d], in squared error summed over the domains, as nonnegative rates can bring it.

    The gradient of the squared error for a rate is tokens * (p . off), where off is how much each domain has too
    much. A document's rate is the projection max(0, 1 + p . push) of a step from rate 1 (scaled by 1 / tokens, so that
    the length of a text doesn't matter), where push gathers the steps made so far, -off times their lengths. A length
    for each direction comes from the curvature sum(tokens * p * p') over the documents with a positive rate, and is
    quartered until the objective falls; with one length for all, hundreds of passes were needed. In the limit push
    is -off / ridge, so every rate fulfils the condition for the least error; of all rates that do, these are nearest to
    1. One aggregation a pass, nothing else is kept; an error if the gradient hasn't vanished after `steps` passes, as
    far as sums of doubles can tell.
    """
    p = [F.col(f"p{i}") for i in range(domains)]
    pairs = [(i, j) for i in range(domains) for j in range(i, domains)]
    target = np.array(targets, float)
    size = max(float(np.abs(target).sum()), 1e-300)

    def look(push: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, curvature and value of the objective at push."""
        rate = rate_column(domains, push.tolist())
        rated = held.select("tokens", *(f"p{i}" for i in range(domains)), rate.alias("rate"))
        free = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        r = rated.agg(
            *(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * c), F.lit(0.0)) for c in p),
            *(F.coalesce(F.sum(free * p[i] * p[j]), F.lit(0.0)) for i, j in pairs),
            F.coalesce(F.sum(F.col("rate") * F.col("rate") * F.col("tokens")), F.lit(0.0)),
        ).first()
        curvature = np.zeros((domains, domains))
        for (i, j), x in zip(pairs, r[domains:-1], strict=True):
            curvature[i, j] = curvature[j, i] = x
        curvature += ridge * np.eye(domains)
        return np.array(r[:domains]) - target + ridge * push, curvature, float(r[-1] / 2 - target @ push + ridge / 2 * push @ push)

    every = held.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ridge, push = RIDGE * max(float(every), 1e-300), np.zeros(domains)
    if not every:
        return held.withColumn("rate", F.lit(1.0))
    gradient, curvature, value = look(push)
    part, passes = 1.0, 1
    while np.linalg.norm(gradient) > max(TOLERANCE * size, ROUNDING * float(every)):
        if (passes >= steps or part < 1e-9) and np.linalg.norm(gradient) <= STALLED * float(every):
            break
        if passes >= steps:
            raise RuntimeError(f"the rates did not settle in {steps} passes")
        move = -np.linalg.solve(curvature, gradient)
        tried = push + part * move
        new = look(tried)
        passes += 1
        if new[2] <= value + 1e-4 * part * float(gradient @ move) + 1e-13 * abs(value):
            push, part = tried, 1.0
            gradient, curvature, value = new
        elif part < 1e-9 and np.linalg.norm(gradient) > STALLED * float(every):
            raise RuntimeError("the rates did not settle: no step lowers the error")
        else:
            part /= 4
    return held.withColumn("rate", rate_column(domains, push.tolist()))


def totals(rated: DataFrame, domains: int) -> list[float]:
    """Expected tokens of each domain under the rates."""
    return list(rated.agg(*(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)) for i in range(domains))).first())


def target_totals(weights: dict[str, float], domains: list[str], available: list[float], budget: float | None) -> list[float]:
    """Tokens wanted of each domain. Without a budget, the most for which no domain needs more than it has. A domain that
    has no more than DUST limits no other, and its target is what it has."""
    unknown = sorted(d for d, w in weights.items() if w > 0 and d not in domains)
    if unknown:
        raise ValueError(f"no labelled rows for the target domains {unknown}; there are {domains}")
    share = [max(0.0, weights.get(d, 0.0)) for d in domains]
    if not sum(share):
        raise ValueError("no domain has a positive target weight")
    share = [s / sum(share) for s in share]
    dust = DUST * sum(available)
    if budget is None:
        budget = min((a / s for a, s in zip(available, share, strict=True) if s and a > dust), default=0.0)
    return [budget * s if a > dust else min(budget * s, a) for a, s in zip(available, share, strict=True)]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", budget: float | None = None, whole: DataFrame | None = None, filtered: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """((id, tokens, p0.., rate) per row of docs, the domains in the order of p0..).

    weights: target share of the tokens by domain; a domain without a weight gets none, a weight of a domain that
    isn't labelled is an error. Targets that can't be met are met with the least squared error. Null and blank texts
    have 0 tokens and weigh nothing, their rate follows their posterior. Null ids and repeated rows stay, each with
    its rate. Empty docs give an empty result.

    whole: the documents that docs was filtered from. The classifier is fitted on them, as a domain that is
    nearly gone from docs can't be learned there. What a filter took from the filtered domains limits neither the
    budget nor the others: they get their share as far as docs still has it.
    """
    every = docs if whole is None else whole
    model = fit_classifier(every, labelled, id_col, text_col, domain_col)
    held, n = materialise(memberships(docs, model, id_col, text_col), "mix-memberships"), len(model.domains)
    available = totals(held.withColumn("rate", F.lit(1.0)), n)
    gone = [whole is not None and d in filtered for d in model.domains]
    before = available
    if any(gone):
        once = Table(memberships(whole, model, id_col, text_col).drop("id").withColumn("rate", F.lit(1.0)), "mix-whole")  # in an aggregation each sum would compute the posteriors anew
        before = totals(once.df, n)
        once.drop()
    wanted = target_totals(weights, model.domains, [b if g else a for g, a, b in zip(gone, available, before, strict=True)], budget)
    return fit_rates(held, n, [min(t, a) if g else t for g, t, a in zip(gone, wanted, available, strict=True)]), model.domains


def copies(rate: Column, row_id: Column) -> Column:
    """How often a row is taken: its rate, rounded up or down by a hash of the id so that the mean is the rate."""
    u = F.pmod(F.xxhash64(F.lit("copies"), row_id.cast("string")), F.lit(1 << 24)) / float(1 << 24)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the table labels: toxic, low (quality 0) or clean. Rows that don't say are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())
