"""WARC round trips and the positional index against brute force."""

import gzip
import hashlib
import io
import os
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from vantage.llm import contamination, queries, sql_hashes, warc
from vantage.llm.common import new_path

from .helpers import frame, texts, words


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def page_rows():
    rng = random.Random(4)
    big = ["<p>" + " ".join(words(rng, 400)) + "é</p>" for _ in range(5)]
    rows = [(i, f"http://h/{i}?q=ä b\r\nX: y", rng.choice(big)) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "small"), (53, "u", "small"), (54, "u", "y" * 999), (55, "u", "y" * 999), (56, "u", "z" * 1000), (57, "u", "z" * 1000)]
    return [*rows, (None, "u", "no id"), (58, "u", "".join(rng.choices("abcdefghij ", k=300_000)))]


def expected(rows):
    best = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        to = best.get(b, i) if i is not None else None
        to = to if to != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [700, 5000, warc.SPLIT])
def test_round_trip_at_any_split(spark, split):
    rows = page_rows()
    got = warc.round_trip(pages(spark, rows), split=split).collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)


def test_round_trip_of_nothing_and_of_one_hot_payload(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    rows = [(i, "u", "x" * 2000) for i in range(200)]
    got = warc.round_trip(pages(spark, rows)).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in got} == {("response", None, 1), ("revisit", 199, 199)}


def test_files_are_gzip_members_and_roll(spark):
    folder = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages(spark, page_rows()), folder, roll=2000).collect()
    assert sum(r["records"] for r in manifest) == len(page_rows()) and len(manifest) > 4
    raw = open(manifest[0]["path"].removeprefix("file://"), "rb").read()
    assert len(raw) == manifest[0]["bytes"] and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    listed = warc.archive_files(spark, folder + "/*.warc.gz")
    assert warc.read_warc(spark, listed).count() == len(page_rows())
    body = warc.read_warc(spark, listed).where("record_id = '<urn:page:58>'").first()
    assert hashlib.sha1(body["payload"]).hexdigest() == body["payload_digest"]


def test_originals_are_the_same_with_and_without_a_broadcast(spark):
    rows = pages(spark, [*page_rows(), (7, "u", "x" * 5000), (7, "u", "x" * 5000), (3, "u", "x" * 5000)])
    found = [sorted(map(tuple, warc.with_originals(rows, most=most).select("id", "url", "html", "refers_to").collect()), key=str) for most in (0, 1000)]
    assert found[0] == found[1] and sum(r[3] is not None for r in found[0]) > 30
    plan = warc.with_originals(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_empty_archives_and_files_of_other_attempts(spark):
    folder = new_path(spark, "warc-empty")
    warc.write_warc(pages(spark, page_rows()), folder)
    top = folder.removeprefix("file://")
    open(f"{top}/empty.warc.gz", "wb").close()
    listed = warc.archive_files(spark, folder + "/*.warc.gz")
    empty = spark.createDataFrame([(f"{folder}/empty.warc.gz", 0)], "path string, bytes long")
    assert warc.read_warc(spark, listed.union(empty)).count() == len(page_rows()) and warc.read_warc(spark, empty).count() == 0
    open(f"{top}/_attempt-1-0", "wb").write(b"half a file")
    open(f"{top}/part-000000-99-0000.warc.gz", "wb").write(warc.record("response", 1, "u", b"of a lost attempt"))
    before = {r["path"].rpartition("/")[2] for r in listed.collect()} - {"empty.warc.gz"}
    warc._sweep(spark, folder, before)
    assert {f for f in os.listdir(top) if not f.startswith(".")} == before


def test_junk_between_members_is_passed_over():
    good = [warc.record("response", i, "u", b"x%d" % i * 50) for i in range(3)]
    other = gzip.compress(b"not a record")
    blob = b"junk\x1f\x8b\x08junk" + good[0] + other + good[1] + b"\x1f\x8b\x08" + good[2] + good[2][:40]
    for cut in range(0, len(blob), 7):
        parts = [list(warc.records_in(io.BytesIO(blob), a, b)) for a, b in ((0, cut), (cut, len(blob)))]
        ids = [h["warc-record-id"] for p in parts for _, h, _ in p]
        assert ids == [f"<urn:page:{i}>" for i in range(3)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_contamination(text, items):
    w = slow_words(text)
    hit, found = set(), set()
    for name, item in items:
        x = slow_words(item)
        n = min(13, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == x[k : k + n]:
                    hit.update(range(s, s + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, n, 50)).title()) for k, n in ((1, 40), (2, 13), (10, 5), (3, 1), (4, 60))]
    items += [(5, None), (6, ""), (7, "?!"), (8, items[0][1]), (9, "ÉTÉ Été 日本 a_b")]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120), 50)
        _, passage = rng.choice(items[:5])
        cut = passage.split(" ")
        a = rng.randrange(len(cut))
        w[len(w) // 2 : len(w) // 2] = cut[a : a + rng.randrange(5, 40)]
        rows.append((i, ", ".join(w) if i % 2 else "\n".join(w)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (None, items[0][1]), (102, items[0][1]), (103, "x été Été 日本 A_B y"), (104, texts()[-2])]
    # the end of one document and the start of the next make no window
    halves = items[1][1].split(" ")
    return [*rows, (105, " ".join(halves[:7])), (106, " ".join(halves[7:]))], items


@pytest.mark.parametrize("turns", [1, 3])
@pytest.mark.parametrize("restrict", [True, False])
def test_contamination_against_brute_force(spark, monkeypatch, turns, restrict):
    rows, items = cases()
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 700)
    monkeypatch.setattr(contamination, "ITEMS_AT_ONCE", 100 if turns == 1 else 3)
    if not restrict:
        monkeypatch.setattr(contamination, "test_terms", lambda items, text_col: None)
    tests = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    got = contamination.contamination(frame(spark, rows).coalesce(1), tests).collect()
    want = sorted(((i, *slow_contamination(t, items)) for i, t in rows), key=str)
    assert sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_contamination_of_nothing(spark):
    rows, items = cases()
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert contamination.contamination(frame(spark, []), tests).count() == 0
    got = contamination.contamination(frame(spark, rows), tests.where("false")).collect()
    assert len(got) == len(rows) and not any(r["n_hit"] for r in got)


def test_exact_and_proximity_matches(spark):
    docs = frame(spark, [(1, "x a b c d y"), (2, "d z c b a"), (3, "a b q q q q q q c d"), (4, "a b"), (5, "c d")]).coalesce(1)
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    exact = contamination.matches(docs, items).collect()
    assert [(r["id"], r["item"], r["start"], r["n_words"]) for r in exact] == [(1, "7", 1, 4)]
    near = contamination.matches(docs, items, slack=2).collect()
    assert {r["id"] for r in near} == {1, 2}


@pytest.mark.parametrize("turns", [1, 2])
def test_proximity_against_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 300)
    monkeypatch.setattr(contamination, "CHUNK", 16)
    monkeypatch.setattr(contamination, "ITEMS_AT_ONCE", 100 if turns == 1 else 3)
    rng = random.Random(21)
    items = [(k, " ".join(words(rng, n, 12))) for k, n in enumerate([2, 3, 4, 5, 16])]
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60), 12))) for i in range(40)]
    for i in (3, 9):
        cut = items[4][1].split(" ")[1:14]
        rng.shuffle(cut)
        rows.append((100 + i, " ".join(words(rng, 9, 12) + cut[:6] + ["aside"] + cut[6:])))
    want = set()
    for i, text in rows:
        w = slow_words(text)
        for name, item in items:
            for x in contamination_windows(item):
                for a in range(len(w)):
                    if w[a] in x and set(x) <= set(w[a : a + len(x) + 2]):
                        want.add((i, str(name), a, min(len(x) + 2, len(w) - a)))
    got = contamination.matches(frame(spark, rows).coalesce(2), spark.createDataFrame(items, "item_id long, text string"), slack=2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 40


def contamination_windows(item, size=13):
    x = slow_words(item)
    return [x[k : k + size] for k in range(max(1, len(x) - size + 1))]


def test_document_frequency(spark):
    docs = frame(spark, [(1, "a b a"), (2, "B c"), (3, None)])
    index = contamination.build_index(docs)
    assert dict(contamination.document_frequency(index).collect()) == {"a": 2, "b": 2, "c": 1}
    some = contamination.build_index(docs, terms={b"c"})
    assert dict(contamination.document_frequency(some).collect()) == {"c": 1}
    assert some.select(F.sum(F.size("ids"))).first()[0] == 3


def test_queries_against_their_sql(spark, tmp_path):
    rows, items = cases()
    rows += [(700 + i, rows[5][1]) for i in range(30)] + [(None, "no id"), (None, "no id"), (6, "no id")]
    frame(spark, [(i, t) for i, t in rows if len(t or "") < 50_000]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pages(spark, [r for r in page_rows() if r[0] is not None]).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op2_simhash", "op6_sharding", "op9_warc", "op10_decontamination"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = db.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_hashes_in_sql():
    rng = random.Random(1)
    found = {"", "é日本 x", *("".join(rng.choices("abc déß", k=n)) for n in range(1, 140))}
    db = duckdb.connect()
    db.execute("CREATE TABLE t0x (x VARCHAR)")
    db.executemany("INSERT INTO t0x VALUES (?)", [(t,) for t in found])
    assert dict(db.execute(sql_hashes.xxh64("t0x", "x")).fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in found}
    assert dict(db.execute(sql_hashes.crc32("t0x", "x")).fetchall()) == {t: zlib.crc32(t.encode()) for t in found}


def test_headers_of_any_length():
    long = "http://a/" + "\u65e5" * 120_000  # over 1 MiB once percent-encoded
    members = [warc.record("response", i, url, b"payload %d" % i) for i, url in enumerate(["http://a/", long, "http://b/"])]
    got = list(warc.records_in(io.BytesIO(b"".join(members)), 0, sum(map(len, members))))
    assert [h["warc-record-id"] for _, h, _ in got] == [f"<urn:page:{i}>" for i in range(3)]
    assert [b.partition(b"\r\n\r\n")[2] for _, _, b in got] == [b"payload %d" % i for i in range(3)]
