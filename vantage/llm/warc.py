"""WARC archives of one gzip member per record: a writer and a reader that splits files anywhere.

A reading task gets a byte range. It looks for gzip magic from the range's first byte on, takes a candidate
for a member only if it decodes to a WARC record header, and owns the records that start in the range, the
last of which it reads beyond the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, new_path, require

#: Bytes of a reading task's range, bytes read at a time, and bytes of a file after which the next is begun.
SPLIT, BLOCK, ROLL = 32 << 20, 1 << 20, 1 << 30
#: Most repeated payloads whose digests are broadcast.
BROADCAST_ROWS = 200_000
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"


def _store(uri: str):
    """(file system, path) of a file in a store that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _name(page_id: object) -> str:
    return "<urn:nopage:>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A gzip member with one WARC record; a revisit holds the HTTP header of the response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~-._' + chr(39))}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(refers_to)}")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_originals(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = BROADCAST_ROWS) -> DataFrame:
    """pages with refers_to: the largest id among equal payloads of LEAST_REVISIT bytes or more, null for the
    row that has it, for smaller payloads and for null ids. Rows that repeat the largest id are all originals.

    Up to `most` payloads that repeat are broadcast, so that no html is shuffled. Beyond, pages with a digest are
    joined by it; those without one have no part in the join, and a frequent payload is one that Spark may split."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).alias("id"), body.alias("html"), *([F.col("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")])).withColumn(
        "digest", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha1(F.col("html").cast("binary")))
    )
    groups = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n"))
    originals = Table(groups.where("n > 1").drop("n"), "warc-originals").df
    refers = F.when(F.col("id") < F.col("original"), F.col("original")).alias("refers_to")
    if originals.count() <= most:
        return keyed.join(F.broadcast(originals), "digest", "left").select("id", "url", "html", refers)
    joined = keyed.where("digest IS NOT NULL").join(originals.hint("merge"), "digest", "left").select("id", "url", "html", refers)
    return joined.union(keyed.where("digest IS NULL").select("id", "url", "html", F.lit(None).cast(keyed.schema["id"].dataType)))


def _sweep(spark: SparkSession, folder: str, kept: set[str]) -> None:
    """Delete what lost or second attempts have left in a folder: every file but those of the manifest."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.listStatus(top) if kept else []:
        if found.getPath().getName() not in kept:
            store.delete(found.getPath(), False)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes a record per row of pages into .warc.gz files in folder, one or more a task; returns the written
    manifest (path, bytes, records). A task writes under a hidden name and renames whole files, whose names hold the
    number of its attempt: files of two attempts never mix, and what the manifest doesn't have is deleted."""
    require(pages, id_col, html_col)
    rows = with_originals(pages, id_col, html_col)
    schema = "path string, bytes long, records long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        made, out, size, count = [], None, 0, 0

        def close() -> None:
            nonlocal out, size, count
            if out is None:
                return
            out.close()
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.gz"
            store.move(temporary, f"{top}/{name}")
            made.append((f"{folder}/{name}", size, count))
            out, size, count = None, 0, 0

        for batch in batches:
            ids, urls, bodies, refers = (batch.column(n) for n in ("id", "url", "html", "refers_to"))
            for page_id, url, body, refer in zip(ids.to_pylist(), urls.to_pylist(), bodies.cast(pa.binary()).to_pylist(), refers.to_pylist(), strict=True):
                if out is None:
                    temporary = f"{top}/_attempt-{context.taskAttemptId()}-{len(made)}"
                    out = store.open_output_stream(temporary)
                member = record("response" if refer is None else "revisit", page_id, url, body, refer)
                out.write(member)
                size += len(member)
                count += 1
                if size >= roll:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["path", "bytes", "records"])

    manifest = Table(rows.mapInArrow(write, schema), "warc-manifest").df
    _sweep(pages.sparkSession, folder, {r["path"].rpartition("/")[2] for r in manifest.select("path").collect()})  # a name a file
    return manifest


class _Source:
    """A file read in blocks from `start`; `at` is the place in the file that is looked at."""

    def __init__(self, handle, start: int):
        self.handle, self.at, self.base, self.data = handle, start, start, b""
        handle.seek(start)

    def more(self) -> bool:
        new = self.handle.read(BLOCK)
        self.data = self.data[self.at - self.base :] + new  # what lies before `at` isn't needed again
        self.base = self.at
        return bool(new)

    def ahead(self) -> int:
        return self.base + len(self.data) - self.at


def _member(source: _Source, limit: int | None = None) -> tuple[bytes, int] | None:
    """(what the gzip member at source.at holds, its length), or with a limit the first bytes of it and 0;
    None if there is no sound member."""
    unpacker, out, used, total, step = zlib.decompressobj(31), [], 0, 0, 8192
    while True:
        if used >= source.ahead() and not source.more():
            return None
        begin = source.at - source.base + used
        piece = source.data[begin : begin + step]
        try:
            got = unpacker.decompress(piece, *([limit] if limit else []))
        except zlib.error:
            return None
        used, total, step = used + len(piece), total + len(got), min(2 * step, BLOCK)
        out.append(got)
        if unpacker.eof:
            return b"".join(out), used - len(unpacker.unused_data)
        if limit and total >= limit:
            return b"".join(out), 0


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """(lower-case names and values, length) of a WARC header at the start of raw, or None."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        return None
    try:
        lines = raw[:end].decode().split("\r\n")
    except UnicodeDecodeError:
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def records_in(handle, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records whose member starts in [start, end). Bytes that aren't a sound
    member with a WARC header are passed over."""
    source = _Source(handle, start)
    while True:
        found = source.data.find(_MAGIC, source.at - source.base)
        if found < 0:
            source.at += max(0, source.ahead() - 2)
            if source.at >= end or not source.more():
                return
            continue
        source.at = source.base + found
        if source.at >= end:
            return
        limit = 8192  # few headers are longer
        while True:
            probe = _member(source, limit)
            head = _header(probe[0]) if probe else None
            if head or not probe or probe[1] or not probe[0].startswith(b"WARC/1.") or b"\r\n\r\n" in probe[0]:
                break
            limit *= 2
        whole = _member(source) if head else None
        if not whole:
            source.at += 1
            continue
        fields, begins = head
        size = int(fields["content-length"])
        if len(whole[0]) >= begins + size:
            yield source.at, fields, whole[0][begins : begins + size]
        source.at += whole[1]


def read_warc(spark: SparkSession, paths: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the files in paths (path, bytes): path, start, record_type, record_id, url, refers_to,
    payload_bytes (of the full payload, also for revisits), payload_digest (bare hexadecimal SHA-1), payload
    (null for revisits). Other record types, unsound members and empty files are passed over."""
    schema = T.StructType.fromDDL(
        "path string, start long, record_type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    )
    ranges = paths.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")).select(
        "path", "start", F.least(F.col("start") + split, "bytes").alias("end")
    )

    def parsed(path: str, start: int, end: int) -> Iterator[tuple]:
        store, name = _store(path)
        with store.open_input_file(name) as handle:
            for offset, h, block in records_in(handle, start, end):
                kind = h["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                top, _, payload = block.partition(b"\r\n\r\n")
                said = [v for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
                stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    size, digest, payload = int(said[0]) if said else None, base64.b32decode(stated).hex() if stated else None, None
                yield path, offset, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for x in batch.to_pylist():
                rows, held = [], 0
                for row in parsed(x["path"], x["start"], x["end"]):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.fieldNames())
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.fieldNames())

    spread = max(1, min(100_000, ranges.count()))
    return ranges.repartitionByRange(spread, "path", "start").mapInArrow(read, schema)


def archive_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the files that match, for archives that others wrote."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", split: int = SPLIT) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) per row of pages, as read back from the
    archives written of them. Null html is an empty payload; a null id is written without a page and read back
    as null; an empty table gives an empty result."""
    spark = pages.sparkSession
    manifest = write_warc(pages, new_path(spark, "warc"), id_col, html_col)
    id_type = pages.schema[id_col].dataType
    named = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(id_type)
    found = read_warc(spark, manifest, split)
    return found.select(named("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))


#: DuckDB SQL for the rows of the registered query.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS original FROM p WHERE strlen(html) >= {LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.page_id < g.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.original THEN g.original END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""
