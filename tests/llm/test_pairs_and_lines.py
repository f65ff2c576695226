"""Near-duplicates, line runs, quality rules and licences against brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantage.llm import components, licences, lines, near_copies, queries, rules, simhash

from .helpers import frame, texts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def slow_simhash(text):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(items):
    """items: (id, fp); returns the set of (id, fp, component)"""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    out = []
    for i, (k, fp) in enumerate(items):
        ids = [items[j][0] for j in range(len(items)) if find(j) == find(i) and items[j][0] is not None]
        out.append((k, fp, min(ids, default=None)))
    return out


def test_simhash_of_texts():
    for t in texts():
        if t is None or len(t) < 20_000:
            assert simhash.simhash_text(t) == slow_simhash(t)
    long = texts()[-2]
    assert simhash.simhash_text(long) == slow_simhash(long)


def test_near_duplicates_against_all_pairs(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, texts()[3])]
    got = simhash.near_duplicates(frame(spark)).collect()
    want = slow_components([(i, slow_simhash(t)) for i, t in rows])
    assert sorted(((r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_trie_finds_every_link(spark, monkeypatch, seed):
    rng = random.Random(seed)
    if seed == 2:  # every subtrie is cut
        monkeypatch.setattr(simhash, "SUBTRIE", 2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, 1, 2**64 - 1, 2**63, 7}
    items = [(f, f) for f in fps]
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    stars = components.star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).collect()
    root = {r["u"] % 2**64: r["v"] % 2**64 for r in stars}
    groups = {}
    for f, _, c in slow_components(items):
        groups.setdefault(c, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_trie_of_one_dense_group_in_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = random.Random(1)
    v = np.unique(np.array([5 << 50 | rng.getrandbits(12) for _ in range(300)], np.uint64))
    found = set()
    simhash.trie_links(v, 42, 2, lambda i, j: found.update(map(frozenset, zip(i.tolist(), j.tolist(), strict=True))))
    want = {frozenset((i, j)) for i in range(len(v)) for j in range(i) if (int(v[i]) ^ int(v[j])).bit_count() <= 2}
    assert found == want


def slow_signatures(text):
    """Majorities of hash bits, with whole numbers only"""
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    m = 2**64

    def split_mix(z, k):
        z = (z + k * 0x9E3779B97F4A7C15) % m
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % m
        z = (z ^ z >> 27) * 0x94D049BB133111EB % m
        return z ^ z >> 31

    def majority(h):
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    if not w:
        return [0] * 5
    shingles = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))}
    return [majority([xxhash.xxh64_intdigest(x.encode(), 42) for x in set(w)]), *(majority([split_mix(h, k) for h in shingles]) for k in range(1, 5))]


def slow_copies(rows):
    """[(id, smallest id reachable)] over all pairs of rows"""
    prints = [slow_signatures(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][0] ^ prints[j][0]).bit_count() <= 5 and sum((a ^ b).bit_count() for a, b in zip(prints[i][1:], prints[j][1:], strict=True)) <= 41:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    return [(i, least[p]) for (i, _), p in zip(rows, part, strict=True)]


def copied_rows(n=24, size=80):
    """Texts with copies in which every k-th word is another"""
    rng, rows = random.Random(12), []
    for i in range(n):
        w = [f"v{rng.randrange(3000)}" for _ in range(size)]
        rows.append((i, " ".join(w)))
        for c, every in enumerate((size, 60, 45, 20, 6)):
            x = list(w)
            x[i % 5 :: every] = [f"new{c}"] * len(x[i % 5 :: every])
            rows.append((100 + 10 * i + c, "\n".join(x)))
    return [*rows, (5000, rows[0][1].upper()), (None, rows[6][1]), (5001, None), (5002, " "), (5003, "one"), (5004, "One"), (5005, "two"), (3, rows[9][1])]


def test_signatures_of_texts():
    for t in [t for t in texts() if len(t or "") < 20_000] + [t for _, t in copied_rows(3)]:
        assert near_copies.signatures_of(t) == slow_signatures(t)
    assert near_copies.most_different() == 41


@pytest.mark.parametrize(("subtrie", "chunk"), [(1 << 20, 1 << 18), (3, 8)])
def test_near_copies_against_all_pairs(spark, monkeypatch, subtrie, chunk):
    monkeypatch.setattr(simhash, "SUBTRIE", subtrie)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = copied_rows()
    rows += [(6000 + k, " ".join(["same"] * 40 + [f"x{k}"] + ["words"] * k)) for k in range(30)]  # many of one words' signature
    got = near_copies.near_copies(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["component_id"]) for r in got), key=str) == sorted(slow_copies(rows), key=str)
    found = dict((r["id"], r["component_id"]) for r in got)
    assert np.mean([found[100 + 10 * i] == i for i in range(24)]) > 0.9  # one word of 80 changed: a similarity of 0.88
    assert not any(found[100 + 10 * i + 4] == i for i in range(24))  # every sixth: below 0.1
    assert near_copies.near_copies(frame(spark, [])).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (300, 7)]
    got = components.star_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["u"], r["v"]) for r in got} == {(i, 0) for i in range(1, 41)} | {(300, 0), (201, 200)}
    assert components.star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_lines(text):
    """[(start, end of the line's signs and white space, line)] by a walk over the text"""
    out, i, white = [], 0, " \t\n\x0b\x0c\r"
    while i < len(text or ""):
        j = i
        while j < len(text) and text[j] not in ".!?\n":
            j += 1
        k = j
        while k < len(text) and text[k] in ".!?" + white:
            k += 1
        if text[i:j].strip(white):
            out.append((i, k, text[i:j].strip(white)))
        i = k
    return out


def slow_runs(rows, least=25, most=8):
    """{(id, text): (lines that go, text without them)}, straight from the definition of a run"""
    seen, gone = {}, {}
    for i, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, str(x[1]))):
        at = [x[2] for x in slow_lines(text)]
        for a in range(len(at)):
            for n in range(1, min(most, len(at) - a) + 1):
                if n == most or sum(x.count(" ") + 1 for x in at[a : a + n]) >= least:
                    run = tuple(at[a : a + n])
                    if seen.setdefault(run, (i, text, a)) != (i, text, a):
                        gone.setdefault((i, text), set()).update(range(a, a + n))
                    break
    out = {}
    for i, text in rows:
        cut, kept, prior = gone.get((i, text), set()), "", "\n"
        if not cut:
            out[i, text] = (0, text)
            continue
        spans = slow_lines(text)
        kept = text[: spans[0][0]]
        prior = kept or "\n"
        for k, (a, b, _) in enumerate(spans):
            if k not in cut:
                kept += text[a:b]
                prior = text[a:b]
            elif k + 1 not in cut and "\n" in text[a:b] and "\n" not in prior:
                kept += "\n"
        out[i, text] = (len(cut), kept)
    return out


def run_rows():
    rng = random.Random(5)
    pool = [" ".join(f"p{i}q{j}" for j in range(rng.choice([1, 3, 5, 9, 12, 20, 24, 25, 26, 40]))) for i in range(24)]
    rows = []
    for i in range(60):
        k = rng.randrange(len(pool))
        body = pool[k : k + rng.randrange(1, 8)] + [f"own {i}"] * rng.randrange(2) + ["", " "] * rng.randrange(2) + rng.choices(pool, k=3)
        text = "".join(x + rng.choice(["\n", ". ", "!\n", "?! ", ".", " .\n\n"]) for x in body)
        rows.append((i, rng.choice(["", "\n\n", " .", "."]) + text + rng.choice(["", "tail", " "])))
    same = [(70, None), (71, ""), (72, "\n\n"), (73, "\n".join(["same line"] * 60)), (74, " the" * 148), (75, "x. " + rows[4][1] + " y\n")]
    return [*rows, *same, (76, " ".join(f"One{n % 3}." for n in range(5_000))), (77, "a. b. c. d. e. f. g."), (78, "a. b. c. d. e. f. g.")]


def test_runs_against_brute_force(spark):
    rows = [*run_rows(), (None, run_rows()[2][1]), (3, run_rows()[3][1]), (3, "another text of id 3. " + run_rows()[5][1])]
    got = {(r["id"], r["text"]): r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    other = (3, rows[-1][1])  # two texts share an id: which goes first follows from a hash
    want = slow_runs([r for r in rows if r != other])
    for (i, t), (n, text) in want.items():
        if i != 3 and (i, text) in got:
            assert got[i, text]["n_deleted"] == n, (i, t)
            assert sum(r["last"] - r["first"] + 1 for r in got[i, text]["runs"]) == n
    assert sum(n > 0 for n, _ in want.values()) > 20
    plain = run_rows()
    for least in (25, 5):
        found = {r["id"]: (r["n_deleted"], r["text"]) for r in lines.dedup_lines(frame(spark, plain), min_words=least).collect()}
        assert found == {i: x for (i, _), x in slow_runs(plain, least).items()}
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="min_words"):
        lines.dedup_lines(frame(spark), min_words=64)


def test_passage_inside_a_line_of_the_file(spark):
    def passage(n):
        return ". ".join(" ".join(f"s{n}_{k}_{j}" for j in range(10)) for k in range(n))

    rows = [(i, f"head of line{i}. {passage(n)}. end{i} of it\nlast {i}") for i, n in enumerate([5, 2, 5, 2])]
    got = {r["id"]: r["text"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {**dict(rows), 2: "head of line2. end2 of it\nlast 2"}


def test_all_shared_runs_are_found_through_the_fingerprints(spark):
    """The windows that repeat are those found, and of each all places but the first go."""
    rows = [r for r in run_rows() if r[1]]
    windows = lines.window_table(frame(spark, rows), "doc_id", "text").collect()
    by_content, by_print = {}, {}
    for w in windows:
        by_content.setdefault((w["fingerprint"], w["content"]), set()).add((w["id"], w["first"]))
        by_print.setdefault(w["fingerprint"], set()).add((w["id"], w["at"]))
        assert w["first"] <= w["at"] < w["first"] + w["lines"] <= w["first"] + lines.MOST_LINES
    for (p, _), places in by_content.items():
        assert len(places) == 1 or len(by_print[p]) > 1 or len({i for i, _ in places}) == 1
    assert len(by_print) < 0.8 * len(windows)


def test_runs_against_sql(spark, tmp_path):
    rows = [*run_rows(), (80, "Ä line of words. " * 40), (81, "\x0b. one")]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(lines.ORACLE_SQL).fetchall())
    got = queries.op1_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_deleted"], r["n_chars"], r["text_md5"]) for r in got) == want


def test_rules_against_sql_and_brute_force(spark):
    rows = list(enumerate(texts())) + [(20, "# one two | three <x>\nAB! CD!\n\nAB! CD!"), (21, "x y z " * 40), (22, "THE END!! " * 60)]
    got = {r["id"]: r.asDict() for r in rules.apply_rules(frame(spark, rows)).collect()}
    db = duckdb.connect()
    table = frame(spark, rows).select("doc_id", "text").toPandas()
    db.register("documents", table)
    for row in db.sql(rules.ORACLE_SQL).df().to_dict("records"):
        mine = got[row["doc_id"]]
        assert {k: mine[k] for k in row if k != "doc_id"} == {k: v for k, v in row.items() if k != "doc_id"}, row
    for i, t in rows:
        w = SPACE.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {}
        for k, g in enumerate(grams):
            seen.setdefault(g, []).append(k)
        hit = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(3)}
        assert got[i]["n_words"] == len(w) and got[i]["n_repeat_words"] == len(hit)
    assert rules.apply_rules(frame(spark, [])).count() == 0
    assert rules.apply_rules(frame(spark)).count() == len(texts()) + 2


def slow_words_at(text):
    """[(line, word)], character by character"""
    out, word = [], ""
    for k, line in enumerate((text or "").lower().split("\n")):
        for c in line + " ":
            if c.isalnum():
                word += c
            elif word:
                out.append((k, word))
                word = ""
    return out


def slow_passages(text, threshold=0.8):
    """All windows of words against all templates; the best of those that share words, from the definition"""
    words = slow_words_at(text)
    flat = [w for _, w in words]
    found = []
    for n, (name, template) in enumerate(licences.TEMPLATES):
        own = {tuple(x) for x in zip(*[[w for _, w in slow_words_at(template)][k:] for k in (0, 1)], strict=False)}
        for i in range(len(flat) - 1):
            if (flat[i], flat[i + 1]) not in own:
                continue
            best = None
            for j in range(i + 1, len(flat)):
                if j > i + 1 and (flat[j - 1], flat[j]) == (flat[i], flat[i + 1]):
                    break
                grams = {(flat[x], flat[x + 1]) for x in range(i, j)}
                d = 2 * len(grams & own) / (len(grams) + len(own))
                if (flat[j - 1], flat[j]) in own and d >= threshold and (best is None or d > best[0]):
                    best = (d, i, j)
            if best:
                found.append((-best[0], -len(own), best[2] - best[1], best[1], n, best[2], name))
    used, out = set(), []
    for d, _, _, i, _, j, name in sorted(found):
        if used.isdisjoint(range(i, j + 1)):
            used.update(range(i, j + 1))
            out.append((i, j, words[i][0], words[j][0], name, pytest.approx(-d)))
    return [x[2:] for x in sorted(out, key=lambda x: x[:2])]


def test_licences_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    short = [x for x in licences.TEMPLATES if len(x[1]) < 420]
    for i in range(60):
        _, template = rng.choice(short)
        w = template.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["other", "word", "the"])
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w)), "\n")
        lead = rng.choice(["some words before\nof the license\n", "(c) 2019 Jane Roe. ", ""])
        rows.append((i, lead + " ".join(w) + rng.choice(["\nthe of and to end", " under the license.", ""])))
    rows += [(100, None), (101, ""), (102, "License"), (103, "MIT"), (104, "Released under the MIT License. " * 4), (None, rows[0][1]), (0, rows[0][1])]
    n = 0
    for r in licences.scan(frame(spark, rows)).collect():
        text = next(t for i, t in rows if i == r["id"])
        assert [tuple(m) for m in r["matches"]] == slow_passages(text), text
        n += len(r["matches"])
    assert n > 40
    assert licences.scan(frame(spark, [])).count() == 0
    assert {r["licence"] for r in licences.licence_counts(licences.scan(frame(spark, rows))).collect()} >= {"MIT", "Apache-2.0"}
    with pytest.raises(ValueError, match="two words"):
        licences.scan(frame(spark), templates=[("X", "one")])


def wrapped(text, width, sign=""):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(sign + line)
            line = ""
        line += w + " "
    return "\n".join([*out, sign + line])


FULL = {
    "MIT": f"MIT License\n\nCopyright (c) 2019 Jane Roe\n\n{wrapped(licences._MIT, 70)}\n\n{wrapped(licences._MIT_END, 70)}",
    "Apache-2.0": f"Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n{wrapped(licences._APACHE_TERMS, 60)}\n" + 'prose of the terms "Source" form. ' * 90,
    "BSD-3-Clause": f"Copyright 2020 The Roes\n{wrapped(licences._BSD_2, 72)}\n{wrapped(licences._BSD_3, 72)}\n\n{wrapped(licences._BSD_END, 72)}",
    "GPL-3.0-or-later": "\n".join(["#!/bin/sh", "# roe.sh: does it", wrapped(licences._GNU.format("", 3), 60, "# "), "#", wrapped(licences._GNU_END.format(""), 60, "# "), "echo"]),
}


@pytest.mark.parametrize("name", FULL)
@pytest.mark.parametrize("one_line", [True, False])
def test_full_texts_and_headers(name, one_line):
    text = FULL[name].replace("\n", " ") if one_line else FULL[name]
    got = licences.passages("some prose before it\n" + text, licences.compile_templates())
    assert [x[2] for x in got] == [name] and got[0][3] > 0.95


def test_repeated_lines_take_time_in_proportion():
    t = licences.compile_templates()
    began = time.time()
    line = "the software and the license of this software"
    assert licences.passages("\n".join([line] * 100_000), t) == []
    got = licences.passages("\n".join(["Released under the MIT License."] * 100_000), t)
    assert len(got) == 100_000 and got[-1][:3] == (99_999, 99_999, "MIT")
    assert time.time() - began < 60


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Copyright 2019 Jane Roe. Released under the MIT License.", [(0, 0, "MIT", 1.0)]),
        ("first\nThis is long prose. Licensed under the MIT License. See the docs for what follows then.", [(1, 1, "MIT", 1.0)]),
        (licences._MIT.replace("\n", " "), [(0, 0, "MIT", 1.0)]),
        ("Long prose before it that ends so. Released under\nthe MIT License. Long prose goes on after it.", [(0, 1, "MIT", 1.0)]),
        ("Some prose goes here first. Licensed under CC BY 4.0. Licensed under CC BY 4.0. It goes on.", [(0, 0, "CC-BY-4.0", 1.0)] * 2),
        ("prose of the license and the software under the terms of this prose", []),
        ("under the " * 3000, []),
    ],
)
def test_notices_inside_lines(text, want):
    assert licences.passages(text, licences.compile_templates()) == want
