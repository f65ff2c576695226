"""Classifiers, mixing and shards: held-out accuracy, targets met, and equality with brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantage.llm import labelled, mixing, quality, sharding, toxicity

from .helpers import frame, labels, texts, words


def corpus(seed=11, n=500):
    """(doc_id, text, quality, toxic): junk is symbols or repeated words, toxic texts hold a bad word or two"""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = words(rng, rng.randrange(20, 200))
        bad, toxic = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vile", "awful", "scummy"])
        for k in range(8, len(w), 9):
            w[k] += "."
        if bad:
            w = [x + "***" for x in w] if rng.random() < 0.5 else [w[0]] * len(w) + w[:5]
        out.append((i, " ".join(w), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    docs = frame(spark, [(i, t) for i, t, _, _ in rows] + [(9000 + k, t) for k, t in enumerate(texts())] + [(None, "x")])
    return docs.cache(), labels(spark, [(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (3, None, None), (99999, 0, 1)])


def test_held_out_rule(spark):
    got = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, data, module, label, cut):
    docs, marks = data
    model = module.train(docs, marks)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {i: (q if label == "quality" else t) for i, _, q, t in corpus()}
    held = [r for r in rows if r["held_out"] and r["id"] in truth]
    assert np.mean([r["predicted"] == truth[r["id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_without_labels_or_documents(spark, module):
    none = labels(spark, [])
    model = module.train(frame(spark), none)
    rows = module.score(frame(spark), model).collect()
    assert len(rows) == len(texts()) + 2 and {r["predicted"] for r in rows} == {int(module is quality)}
    assert module.score(frame(spark, []), model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, data):
    docs, marks = data
    flipped = marks.withColumn("quality", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, marks) == quality.train(docs, flipped)


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x @ [2.0, -1.0, 0.0] > 0
    w = quality.bradley_terry(x[good][:150], x[~good][:150])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.5 * abs(w[1])


def test_offending_sentences(spark, data):
    docs, marks = data
    model = toxicity.train(docs, marks)
    one = frame(spark, [(1, "w1 w2 w3. You vile awful scummy thing! w4 w5"), (2, None)])
    found = toxicity.offending_sentences(one, model).collect()
    assert [(r["id"], r["sentence"]) for r in found] == [(1, 1)]
    assert toxicity.score(one, model).where("id = 1").first()["first_offending"] == 1


def slow_toxicity(text, model):
    """Noisy-or of the sentences and the background, by products of probabilities"""
    clean = 1 - 1 / (1 + np.exp(-model.background))
    base = 1 / (1 + np.exp(-model.bias))
    for part in re.split(r"[.!?\n]", text or ""):
        known = {w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in part)) if w.encode() in model.vocabulary}
        p = 1 / (1 + np.exp(-model.bias - sum(model.weights[model.vocabulary[w.encode()]] for w in known)))
        clean *= 1 - max(0.0, (p - base) / (1 - base)) if known else 1.0
    return 1 - clean


def test_toxicity_scores_against_brute_force(spark, data):
    docs, marks = data
    model = toxicity.train(docs, marks)
    rows = {(r["id"]): r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        if len(r["text"] or "") < 50_000:
            assert rows[r["doc_id"]] == pytest.approx(slow_toxicity(r["text"], model), abs=1e-9)


def test_long_clean_texts_stay_clean(spark, data):
    docs, marks = data
    model = toxicity.train(docs, marks)
    known = next(w.decode() for w in model.vocabulary)
    rows = [(1, "the sky is nice. " * 100_000), (2, "the sky is nice"), (3, None), (4, "clean words. " * 50_000 + "You " + " ".join(["vile", "awful", "scummy"]) + "!")]
    got = {r["id"]: r for r in toxicity.score(frame(spark, rows), model).collect()}
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] < 0.2 and known
    assert got[4]["predicted"] == 1 and got[4]["first_offending"] == 50_000


def test_quality_scores_against_brute_force(spark, data):
    docs, marks = data
    model = quality.train(docs, marks)
    rows = {r["id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = (np.array(quality.features(r["text"])) - model.centre) / model.spread
        z = model.scale * (sum(w * min(8, max(-8, v)) for w, v in zip(model.weights, x, strict=True)) - model.threshold)
        assert rows[r["doc_id"]] == pytest.approx(1 / (1 + (1 - quality.CUT) / quality.CUT * np.exp(-z)), abs=1e-9)


def test_features_against_brute_force():
    t = "One  two, two Two!\nAB | <x> 3.5\nOne\nOne\nÉ"
    words = ["One", "two,", "two", "Two!", "AB", "|", "<x>", "3.5", "One", "One", "É"]
    share = lambda k: np.log1p(100 * k / len(words))
    want = [np.log1p(11), np.log1p(sum(map(len, words)) / 11), share(2), share(1), share(1), share(2), share(1), share(2)]
    want += [np.log1p(100 * 1 / 5), np.log1p(100 / len(t)), share(2), share(1)]
    assert quality.features(t) == pytest.approx(want)


def slow_least_squares(tokens, p, targets, steps=20_000):
    """|totals - targets| of the best nonnegative rates: accelerated projected gradient, started anew where it turns"""
    a = (tokens[:, None] * p).T
    length, r, k = np.linalg.norm(a @ a.T, 2), np.ones(len(tokens)), 1.0
    z = r
    for _ in range(steps):
        new, k2 = np.maximum(0, z - a.T @ (a @ z - targets) / length), (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, k2 = (new, 1.0) if (z - new) @ (new - r) > 0 else (new + (k - 1) / k2 * (new - r), k2)
        r, k = new, k2
    return np.linalg.norm(a @ r - targets)


def rate_rows(spark, tokens, p):
    names = "tokens long, " + ", ".join(f"p{i} double" for i in range(p.shape[1]))
    return spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], names).coalesce(1).cache()


@pytest.mark.parametrize("seed", range(8))
def test_rates_have_the_least_error(spark, seed):
    """Odd seeds: mixed posteriors, whose targets can't be met."""
    rng = np.random.default_rng(seed)
    d = 2 + seed % 3
    p = rng.dirichlet([8.0 if seed % 2 else 0.3] * d, size=60 + 20 * seed)
    tokens = rng.integers(0, 500, size=len(p))
    targets = tokens.sum() * (rng.permutation([0.97] + [0.03 / (d - 1)] * (d - 1)) if seed % 2 else rng.dirichlet([2.0] * d))
    out = mixing.fit_rates(rate_rows(spark, tokens, p), d, targets.tolist())
    error, least = np.linalg.norm(np.array(mixing.totals(out, d)) - targets), slow_least_squares(tokens, p, targets)
    assert error <= least + 1e-4 * tokens.sum()
    assert seed % 2 == 0 or least > 0.01 * tokens.sum()
    assert all(x["rate"] >= 0 for x in out.collect())


def test_rates_that_are_reachable_change_least(spark):
    tokens, p = np.array([100, 50, 70]), np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    out = mixing.fit_rates(rate_rows(spark, tokens, p), 2, [135.0, 85.0])
    assert [r["rate"] for r in out.collect()] == pytest.approx([1, 1, 1], abs=1e-5)
    out = mixing.fit_rates(rate_rows(spark, tokens[:2], p[:2]), 2, [0.0, 40.0])
    assert [r["rate"] for r in out.collect()] == pytest.approx([0, 0.8], abs=1e-5)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.fit_rates(rate_rows(spark, tokens, p), 2, [1.0, 85.0], steps=1)


def test_a_domain_that_is_gone_limits_no_other(spark):
    """Posteriors are never zero: what they leave of a domain without documents is no budget for the others."""
    rng = np.random.default_rng(6)
    toxic = 1e-20 * rng.random(300)
    clean = np.where(rng.random(300) < 0.1, 1e-6, 1.0) * (1 - toxic)
    p, tokens = np.column_stack([clean, 1 - clean - toxic, toxic]), rng.integers(1, 2000, size=300)
    have, names = (tokens @ p).tolist(), ["clean", "low", "toxic"]
    targets = mixing.target_totals({"clean": 0.96, "low": 0.02, "toxic": 0.02}, names, have, None)
    out = mixing.fit_rates(rate_rows(spark, tokens, p), 3, targets)
    assert mixing.totals(out, 3) == pytest.approx([have[0], have[0] * 0.02 / 0.96, 0], abs=1e-6 * tokens.sum())
    assert max(r["rate"] for r in out.collect()) < 1.01
    for budget in (1e-3, 1e-12):  # far below what sums of the tokens can resolve
        out = mixing.fit_rates(rate_rows(spark, tokens, p), 3, [0.96 * budget, 0.02 * budget, 0.02 * budget])
        assert mixing.totals(out, 3) == pytest.approx([0, 0, 0], abs=1e-2)


def test_posteriors_against_brute_force(spark, data):
    docs, marks = data
    model = mixing.fit_classifier(docs, mixing.label_domains(marks))
    rows = {r["id"]: r for r in mixing.featured(docs, "doc_id", "text").collect()}
    for r in mixing.memberships(docs, model).collect():
        logs = list(model.prior)
        for token in set(rows[r["id"]]["features"]):
            logs = [x + w for x, w in zip(logs, model.weight.get(token, [0.0] * 3), strict=True)]
        share = np.exp(np.array(logs) - max(logs))
        assert [r["p0"], r["p1"], r["p2"]] == pytest.approx(list(share / share.sum()), abs=1e-9)


def test_posteriors_stand_once_in_the_plan(spark, data):
    """With a copy of the sums in each place they are used, executors took over a GB to compile them."""
    docs, marks = data
    found = mixing.memberships(docs, mixing.fit_classifier(docs, mixing.label_domains(marks)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("array_intersect(") == 1


def test_mixing_of_documents(spark, data):
    docs, marks = data
    domains = mixing.label_domains(marks)
    weights = {"clean": 0.8, "low": 0.1, "toxic": 0.1}
    out, names = mixing.mix(docs, domains, weights)
    rows = out.collect()
    assert len(rows) == docs.count() and names == ["clean", "low", "toxic"]
    assert all(r["rate"] >= 0 and abs(sum(r[f"p{i}"] for i in range(3)) - 1) < 1e-9 for r in rows)
    total = np.array(mixing.totals(out, 3))
    assert total / total.sum() == pytest.approx([0.8, 0.1, 0.1], abs=1e-3)
    truth = {i: "toxic" if t else "low" if not q else "clean" for i, _, q, t in corpus()}
    right = [names[int(np.argmax([r[f"p{i}"] for i in range(3)]))] == truth[r["id"]] for r in rows if r["id"] in truth]
    assert np.mean(right) > 0.85
    empty, _ = mixing.mix(frame(spark, []), domains, weights)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        mixing.mix(docs, domains, weights | {"other": 0.1})
    with pytest.raises(ValueError, match="labelled table"):
        mixing.mix(docs, domains.where("false"), weights)


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1.3, abs=0.02) and (got[1], got[2]) == (1, 2)


def slow_capacity(sizes, shards):
    best = {0: 0}
    inf = sum(sizes) + 1
    prefix = np.r_[0, np.cumsum(sizes)]
    best = [0] + [inf] * len(sizes)
    for _ in range(shards):
        best = [min([best[j]] + [max(best[i], prefix[j] - prefix[i]) for i in range(j)]) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", [0, 1, 4])
def test_least_capacity_against_dynamic_programming(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.getrandbits(64) - 2**63: rng.choice([1, 5, 50, 400 if seed % 2 else 60]) for _ in range(60)}
    if seed == 4:  # neighbours in a few ranges
        sizes = {k >> 20: v for k, v in sizes.items()}
    groups = spark.createDataFrame(list(sizes.items()), "key long, bytes long")
    capacity, cuts = sharding.minimax_cuts(groups, 8, first_bits=2, more_bits=3)
    assert capacity == slow_capacity([sizes[k] for k in sorted(sizes)], 8)
    loads = {}
    for k, v in sizes.items():
        s = sum(k >= c for c in cuts)
        loads[s] = loads.get(s, 0) + v
    assert max(loads.values()) <= capacity and len(loads) <= 8


def test_shards_of_documents(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 40)))) for i in range(400)] + [(1000 + i, "copy of one text") for i in range(150)]
    rows += [(2000, None), (2001, ""), (None, "lost"), (5, rows[5][1]), (2002, "é")]
    got = sharding.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["id"] is not None, r["id"] or 0, r["size"], r["text_crc32"]) for r in got) == sizes
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    load = {}
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        load[s] = sum(r["size"] for r in mine)
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    by_hash = sorted(groups, key=lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64))
    assert max(load.values()) == slow_capacity([groups[t] for t in by_hash], 8)
    assert sharding.shard(frame(spark, [])).count() == 0
    assert {r["shard"] for r in sharding.shard(frame(spark, [(1, "x")])).collect()} == {0}
    many = sharding.shard(frame(spark, [(1, "x")]).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(10_000))))).collect()
    assert sorted(r["slot"] for r in many) == list(range(10_000))
