"""WARC revisit resolution.

1. ``write_archives``: every row becomes a WARC/1.1 response record (its own gzip member) in archive
   files of a bounded size below the shared checkpoint folder.
2. ``read_headers``: the archives are streamed; only (file, position, id, digest, size) leave the tasks.
3. ``resolve``: headers are shuffled by payload digest.  Per digest a partially aggregated max finds the
   original (largest page id, ties: largest file and position); records of digests that occur more than
   once are joined to it, a skew-splittable join.  Payloads are never shuffled.
4. ``write_deduplicated``: decisions are grouped by source file (bounded by the file size); each task
   streams one archive and writes its records again under fresh headers, duplicates as revisit
   records without payload that refer to the original.
5. ``read_records``: the new archives are read back into rows.

A task writes to a file name of its own attempt and returns it as a row; the written table of those
rows is the manifest.  A file of a lost or repeated attempt is in no manifest and is never read.

Defined results: a null html is an empty payload; payloads below ``min_bytes`` are always responses; a
null page_id sorts before every other and is written as an empty id; of rows repeated under one
page_id with equal payload one is the response and the others revisit it; an empty table gives no
files and no rows; only page_id, url and html are read, and a null url is an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import common as C
from roadlens.session import ensure_checkpoint_dir

#: Record layout, media types and the revisit profile of WARC/1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
DATE = "1970-01-01T00:00:00Z"

#: An archive file is closed once it holds this many payload bytes or records.
FILE_BYTES, FILE_RECORDS = 32 << 20, 10_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str, sha: str, serial: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha}/{serial}')}>"


def http_block(payload: bytes | None, size: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return head + (payload or b"")


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def store(path: str):
    """(file system, path in it) of a folder URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Archive:
    """Archive files of one task attempt, opened as needed."""

    def __init__(self, folder: str):
        self.fs, self.base = store(folder)
        self.folder, self.out, self.done = folder, None, []

    def add(self, data: bytes, size: int) -> None:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.size, self.count = self.fs.open_output_stream(f"{self.base}/{self.name}"), 0, 0
        self.out.write(data)
        self.size, self.count = self.size + size, self.count + 1
        if self.size >= FILE_BYTES or self.count >= FILE_RECORDS:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.count))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in self.done], type=pa.string()),
                                           pa.array([n for _, n in self.done], type=pa.int64())], ["file", "records"])


def members(path: str):
    """The decompressed records of an archive file, one at a time, read in steps of a megabyte."""
    folder, _, name = path.rpartition("/")
    fs, base = store(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        rest = b""
        while True:
            if not rest:
                rest = f.read(1 << 20)
                if not rest:
                    return
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not rest:
                    rest = f.read(1 << 20)
                    if not rest:
                        raise ValueError(f"truncated archive {path}")
                parts.append(z.decompress(rest))
                rest = z.unused_data
            yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, by its Content-Length."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    return headers, data[end + 4:end + 4 + size]


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4:]


def clean(url: str | None) -> str:
    """A header value is one line."""
    return " ".join((url or "").split())


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{tag}-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Manifest (file, records) of response records of all rows."""

    def run(batches):
        archive = Archive(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page, url, html in zip(*(c.slice(at, 64).to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    sha, pid = digest(payload), "" if page is None else str(page)
                    archive.add(record({
                        "WARC-Type": "response", "WARC-Record-ID": record_id(pid, sha, "0"), "WARC-Date": DATE,
                        "WARC-Target-URI": clean(url), "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": HTTP_TYPE,
                        "X-Page-Id": pid}, http_block(payload, len(payload))), len(payload))
        yield archive.manifest()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return C.saved(rows.mapInArrow(run, "file string, records long"), "manifest")


def one_file_a_task(manifest: DataFrame) -> DataFrame:
    """The manifest's files spread over tasks of a few files each."""
    n = manifest.count()
    return manifest.select("file").repartition(max(1, min(n, 100_000)))


def read_headers(manifest: DataFrame) -> DataFrame:
    """(file, at, page_id, bytes, digest, uri, record_id): the digest is computed from the payload read."""
    schema = "file string, at long, page_id long, bytes long, digest string, uri string, record_id string"

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for at, data in enumerate(members(path)):
                    head, block = parse(data)
                    payload = payload_of(block)
                    rows.append((path, at, int(head["X-Page-Id"]) if head["X-Page-Id"] else None, len(payload),
                                 digest(payload), head["WARC-Target-URI"], head["WARC-Record-ID"]))
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)],
                                                 ["file", "at", "page_id", "bytes", "digest", "uri", "record_id"])

    return C.saved(one_file_a_task(manifest).mapInArrow(run, schema), "headers")


def resolve(headers: DataFrame, min_bytes: int) -> DataFrame:
    """The revisit records: (file, at, and of the original: o_page, o_uri, o_record, has_page)."""
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "file", "at", "page_id", "uri", "record_id")
    originals = headers.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.max(rank).alias("o"), F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = headers.select("file", "at", "digest", "bytes").join(originals, ["digest", "bytes"])
    return hits.filter((F.col("file") != F.col("o.file")) | (F.col("at") != F.col("o.at"))).select(
        "file", "at", F.col("o.page_id").alias("o_page"), F.col("o.uri").alias("o_uri"), F.col("o.record_id").alias("o_record"))


def write_deduplicated(manifest: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """Manifest of the archives written again: originals whole, duplicates as revisit records."""
    schema = "file string, records long"
    every = manifest.select("file", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("o_page"),
                            F.lit(None).cast("string").alias("o_uri"), F.lit(None).cast("string").alias("o_record"))

    def run(table: pa.Table) -> pa.Table:
        path, archive = table.column("file")[0].as_py(), Archive(folder)
        decided = {at: (page, uri, rid) for _, at, page, uri, rid in zip(*(c.to_pylist() for c in table.columns))}
        for at, data in enumerate(members(path)):
            head, block = parse(data)
            payload = payload_of(block)
            sha, pid = digest(payload), head["X-Page-Id"]
            fresh = {"WARC-Type": "response", "WARC-Record-ID": head["WARC-Record-ID"], "WARC-Date": DATE,
                     "WARC-Target-URI": head["WARC-Target-URI"], "WARC-Payload-Digest": f"sha1:{sha}",
                     "Content-Type": HTTP_TYPE, "X-Page-Id": pid, "X-Payload-Length": str(len(payload))}
            if at in decided:
                page, uri, rid = decided[at]
                fresh |= {"WARC-Type": "revisit", "WARC-Record-ID": record_id(pid, sha, f"{path}#{at}"),
                          "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": rid, "WARC-Refers-To-Target-URI": uri,
                          "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-Id": "" if page is None else str(page)}
                archive.add(record(fresh, http_block(None, len(payload))), 0)
            else:
                archive.add(record(fresh, http_block(payload, len(payload))), len(payload))
        return pa.Table.from_batches([archive.manifest()])

    rows = every.unionByName(revisits)
    n = manifest.count()
    out = rows.repartition(max(1, min(n, 100_000)), "file").groupBy("file").applyInArrow(run, schema)
    return C.saved(out, "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id, refers_to_record)."""
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "target_uri string, record_id string, refers_to_record string")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        whole = lambda s: int(s) if s else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in members(path):
                    head, block = parse(data)
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest(payload_of(block)) != sha:
                        raise ValueError(f"digest mismatch in {path}")
                    rows.append((whole(head["X-Page-Id"]), int(head["X-Payload-Length"]), sha, head["WARC-Type"],
                                 whole(head.get("X-Refers-To-Page-Id")), head["WARC-Target-URI"],
                                 head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names)

    return one_file_a_task(manifest).mapInArrow(run, schema)


def deduplicate(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(manifest of the deduplicated archives, their records read back)."""
    spark = pages.sparkSession
    written = write_archives(pages, new_folder(spark, "raw"))
    headers = read_headers(written)
    out = write_deduplicated(written, C.saved(resolve(headers, min_bytes), "revisits"), new_folder(spark, "dedup"))
    return out, read_records(out)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    _, records = deduplicate(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
        max(page_id) OVER (PARTITION BY html) AS top FROM p),
bits AS (SELECT DISTINCT hex, list_transform(range(0, 32), lambda i: (
    (CAST(('0x' || substr(hex, CAST(i * 5 // 4 AS INT) + 1, 1)) AS INT) * 16
     + CASE WHEN i * 5 // 4 + 2 <= 40 THEN CAST(('0x' || substr(hex, CAST(i * 5 // 4 AS INT) + 2, 1)) AS INT) ELSE 0 END)
    >> CAST(3 - (i * 5) % 4 AS INT)) & 31) AS v FROM d)
SELECT d.page_id, d.payload_bytes,
  list_aggregate(list_transform(bits.v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN d.page_id = d.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> d.top THEN d.top END AS refers_to
FROM d JOIN bits USING (hex)
"""
