"""The pipeline's stages over planted documents, each held against a brute-force version of its decision."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from vantage.llm import mixing, quality, queries

from .helpers import words
from .test_archives_and_index import slow_contamination
from .test_models import slow_capacity, slow_least_squares
from .test_pairs_and_lines import slow_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = [(k, " ".join(words(random.Random(90 + k), 30, 5000))) for k in range(4)]


def planted(n=400):
    """[(id, text, quality, toxic)]: junk, toxic documents, copies, near copies and passages of the benchmark"""
    rng, out = random.Random(4), []
    for i in range(n):
        w = words(rng, rng.randrange(40, 90), 3000)
        low, toxic = i % 5 == 0, i % 5 == 1
        if low:
            w = [x for y in w for x in (y, "***")]
        if toxic:
            w[::15] = ["vile"] * len(w[::15])
        if i % 20 == 3:
            w[5:5] = BENCH[i % 4][1].split(" ")[3:25]
        out.append((i, " ".join(w), int(not low), int(toxic)))
    clean = [r for r in out if r[0] % 5 > 1]
    out += [(1000 + k, r[1], r[2], r[3]) for k, r in enumerate(clean[:30])]
    out += [(2000 + k, r[1].upper(), r[2], r[3]) for k, r in enumerate(clean[30:40])]
    out += [(3000 + k, r[1] + " end", r[2], r[3]) for k, r in enumerate(clean[40:90])]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder of the tables, the documents' rows)"""
    top = str(tmp_path_factory.mktemp("corpus"))
    rows = planted()
    odd = [(None, None), (None, ""), (7000, None), (3, rows[3][1]), (7001, "one"), (None, rows[2][1]), (7002, " \n")]
    docs = [(i, t, "en", "s", len(t)) for i, t, _, _ in rows] + [(i, t, None, None, None) for i, t in odd]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, [(d[0], d[1]) for d in docs]


def read(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def of(rows):
    return sorted(rows, key=str)


def test_quality_against_brute_force(spark, corpus):
    docs = read(spark, corpus)
    model = quality.train(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"))

    def score(text):
        x = (np.array(quality.features(text)) - model.centre) / model.spread
        z = model.scale * (sum(w * min(8, max(-8, v)) for w, v in zip(model.weights, x, strict=True)) - model.threshold)
        return 1 / (1 + (1 - quality.CUT) / quality.CUT * np.exp(-z))

    want = of(r for r in corpus[1] if score(r[1]) >= 0.3)
    assert kept(cp.quality_stage(spark, docs, corpus[0])) == want
    good = {i for i, _, q, _ in planted() if q}
    found = {i for i, _ in want}
    assert len(good - found) <= 0.02 * len(good) and not {i for i, _, q, _ in planted() if not q} & found


def test_near_duplicates_against_brute_force(spark, corpus):
    gone = {i for i, c in slow_copies(corpus[1]) if i != c}
    want = of(r for r in corpus[1] if r[0] not in gone)
    assert kept(cp.near_duplicate_stage(spark, read(spark, corpus), corpus[0])) == want
    assert {i for i, _ in want}.isdisjoint({*range(1000, 1030), *range(2000, 2010), None}) and (7000, None) in want
    assert len({i for i, _ in want} & {*range(3000, 3050)}) <= 3  # a word more at the end of 40 to 90
    assert {i for i in range(400)} <= {i for i, _ in want}


def test_decontamination_against_brute_force(spark, corpus):
    want = []
    for i, t in corpus[1]:
        n, hit, _ = slow_contamination(t, BENCH)
        if not (hit > 0 and 20 * hit >= n):
            want.append((i, t))
    gone = {r[0] for r in corpus[1]} - {r[0] for r in want}
    assert kept(cp.decontamination_stage(spark, read(spark, corpus), corpus[0])) == of(r for r in want if r[0] not in gone)
    assert set(range(3, 400, 20)) <= gone and all(i % 20 == 3 or i >= 1000 for i in gone)


def test_mixing_against_brute_force(spark, corpus):
    docs = read(spark, corpus)
    labelled = mixing.label_domains(spark.read.parquet(f"{corpus[0]}/labels.parquet"))
    rated, names = mixing.mix(docs, labelled, queries.MIX_WEIGHTS, whole=docs, filtered=("low",))
    rows = rated.collect()
    tokens, p = np.array([r["tokens"] for r in rows], float), np.array([[r[f"p{i}"] for i in range(3)] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    have = tokens @ p
    share = np.array([queries.MIX_WEIGHTS[d] for d in names])
    targets = share * min(have[i] / share[i] for i in range(3))
    error = np.linalg.norm((tokens * rate) @ p - targets)
    assert error <= slow_least_squares(tokens, p, targets) + 1e-4 * tokens.sum()
    times = {}
    for r in rows:  # rows that share an id are taken equally often
        u = (xxhash.xxh64_intdigest(str(r["id"]).encode(), xxhash.xxh64_intdigest(b"copies", 42)) & (1 << 24) - 1) / (1 << 24) if r["id"] is not None else None
        n = int(r["rate"]) + (u < r["rate"] - int(r["rate"])) if u is not None else None
        times[r["id"]] = max(times.get(r["id"], 0), n) if n is not None else None
    got = [r for r in kept(cp.mixing_stage(spark, docs, corpus[0])) if r[0] is not None]
    assert got == of(r for r in corpus[1] if r[0] is not None for _ in range(times[r[0]]))


@pytest.mark.parametrize("left", [0, 2])
def test_mixing_after_a_filter_keeps_the_other_domains(spark, corpus, left):
    stayed = read(spark, corpus).where(f"doc_id < 400 AND (doc_id % 5 <> 0 OR doc_id < {5 * left})")
    got = [i for i, _ in kept(cp.mixing_stage(spark, stayed, corpus[0]))]
    assert 228 <= sum(i % 5 > 1 for i in got) <= 252  # of 240
    assert 1 <= sum(i % 5 == 1 for i in got) <= 15  # of 80; 0.02 / 0.96 of 240 is 5
    assert sum(i % 5 == 0 for i in got) <= 2


def test_mixing_without_labels_or_without_a_domain(spark, corpus, tmp_path):
    docs = read(spark, corpus)
    for name, keep in (("none", "false"), ("clean", "quality = 1 AND toxic = 0")):
        top = str(tmp_path / name)
        docs.write.parquet(f"{top}/documents.parquet")
        spark.read.parquet(f"{corpus[0]}/labels.parquet").where(keep).write.parquet(f"{top}/labels.parquet")
        assert kept(cp.mixing_stage(spark, docs, top)) == of(corpus[1])


def test_sharding_against_brute_force(spark, corpus):
    rows = cp.sharding_stage(spark, read(spark, corpus), corpus[0]).collect()
    assert of(r["doc_id"] for r in rows) == of(i for i, _ in corpus[1])
    size = {}
    for _, t in corpus[1]:
        size[t or ""] = size.get(t or "", 0) + len((t or "").encode()) + 1
    in_order = sorted(size, key=lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64))
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) == slow_capacity([size[t] for t in in_order], 8)


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    docs = read(spark, corpus)
    for name, stage in cp.STAGES:
        out = stage(spark, docs.where("false"), corpus[0])
        assert out.count() == 0, name
        assert name == "sharding" or out.schema.names == docs.schema.names


def test_run_applies_the_stages_to_what_is_kept(spark, corpus):
    docs = read(spark, corpus)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus[0]).collect(), docs.schema)
    got = cp.run(spark, corpus[0])
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _ in kept(docs))
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() > 200
