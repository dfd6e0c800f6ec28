"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page_id over ranges, whose bounds come from exact sums of payload bytes; a file rolls at the end of a range or when its
compressed records reach a size; each record is a gzip member of its own, with headers and digests made anew from the payload. So the
same pages give the same files, names and bytes, however many tasks there are. A file is written under a temporary name and renamed
when whole, and counts only through its row in the manifest, so a task that runs twice does no harm.

Defined results: a null html is an empty payload; of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest
page_id is the response (every row of that page_id, if rows repeat) and the others revisit it; records without a page_id are responses;
texts of any length are one record each, which a task holds whole; rows that repeat a page_id stand in order of url and payload; a null url
becomes urn:page:<page_id>; control characters and spaces in a url are percent-encoded; an empty table gives no files; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import SharedFiles, arrow_rows, cut, drop_written, open_shared, shared_folder, table

MIN_REVISIT, FILE_BYTES, SALTS = 100, 64 << 20, 64
#: Payload bytes of a part (a range of page_id): a PARTS-th of all, but for these bounds.
PARTS, LEAST_PART, MOST_PART = 256, 1 << 20, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("records", "bytes", "first_id", "last_id"))])
READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def revisits(pages: DataFrame, least: int = MIN_REVISIT, salts: int = SALTS) -> DataFrame:
    """page_id, digest, refers_to of the records that revisit another. Payloads meet by SHA-256, hot ones salted; no payload is shuffled."""
    rows = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.coalesce(F.sha2(F.encode("html", "UTF-8"), 256), F.lit("")).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    first = rows.groupBy("digest", "salt").agg(F.min("page_id").alias("own"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("digest")
    first = first.select("digest", "salt", F.min("own").over(whole).alias("refers_to"), F.sum("n").over(whole).alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["digest", "salt"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def part_of(bounds: list[int]):
    """A function of page_id: the number of its range, null standing before the first one. bounds: where the next range begins."""

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype("int64"), "right")).astype("int32"))

    return part


def range_bounds(rows: DataFrame) -> list[int]:
    """Bounds of ranges of page_id with about equally many payload bytes. A range that holds over twice a part's bytes is cut into equal
    widths, again and again, down to one page_id; one number a range comes to the driver."""
    sizes = cut(rows.select("page_id", F.octet_length("html").cast("long").alias("bytes")), "sizes")
    all_of = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if all_of[0] is None:
        drop_written(sizes)
        return []
    low, high, target = int(all_of[0]), int(all_of[1]) + 1, min(MOST_PART, max(LEAST_PART, int(all_of[2]) // PARTS))
    bounds, held = [], {0: int(all_of[2])}
    while True:
        edges = [low, *bounds, high]
        more = set()
        for i, n in held.items():
            width, pieces = edges[i + 1] - edges[i], min(4096, -(-n // target))
            if n > 2 * target and width > 1:
                more.update(edges[i] + width * k // pieces for k in range(1, pieces))
        if not more - set(edges):
            drop_written(sizes)
            return bounds
        bounds = sorted(more.union(bounds) - {low, high})
        found = sizes.where("page_id is not null").groupBy(part_of(bounds)("page_id").alias("part")).agg(F.sum("bytes").alias("n"))
        held = {r["part"]: int(r["n"]) for r in found.where(F.col("n") > 2 * target).collect()}


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, html: str, known: dict[str, int], date: str) -> bytes:
    """A gzip member; known: by digest, the page that this page revisits with that payload."""
    payload = html.encode("utf-8", "replace")
    digest = hashlib.sha256(payload).hexdigest()
    refers_to = known.get(digest)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, least: int = MIN_REVISIT) -> DataFrame:
    """Write archives under folder; the manifest, one row a file. A task holds one file's compressed records at most.

    Payloads are shuffled once, by range of page_id. What a page revisits comes as a small row of its own, sorted before the page's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, files, rows = 0, 0, SharedFiles(folder), []
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def commit() -> None:
            nonlocal size, seq
            name = f"part-{part:05d}-{seq:05d}.warc.gz"
            info = f"format: WARC File Format 1.1\r\nname: {name}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            top = gzip.compress(head.encode() + info + b"\r\n\r\n", 6, mtime=0)
            rows.append((part, seq, files.put(name, [top, *held]), len(held), size + len(top), ids[0], ids[-1]))
            held.clear()
            ids.clear()
            size, seq = 0, seq + 1

        now, known = None, {}  # of one page_id: what a payload's digest refers to
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if row["part"] != part:
                    if held:
                        commit()
                    part, seq = row["part"], 0
                if row["page_id"] != now:
                    now, known = row["page_id"], {}
                if row["html"] is None:
                    known[row["digest"]] = row["refers_to"]
                    continue
                held.append(record(row["page_id"], row["url"], row["html"], known, date))
                ids.append(row["page_id"])
                size += len(held[-1])
                if size >= file_bytes:
                    commit()
        if held:
            commit()
        yield arrow_rows(rows, MANIFEST)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    notes = revisits(rows, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    both = notes.union(rows.select("page_id", "url", "html", F.lit(None).cast("string"), F.lit(None).cast("long")))
    both = both.withColumn("part", part_of(range_bounds(rows))("page_id"))
    ordered = both.repartition("part").sortWithinPartitions("part", "page_id", F.col("html").isNotNull(), "url", "html")
    return cut(ordered.mapInArrow(run, from_arrow_schema(MANIFEST)), "warc-manifest")


def members(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    rest = file.read(chunk)
    while rest:
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if not rest and not (rest := file.read(chunk)):
                raise ValueError("archive cut short")
            out.append(one.decompress(rest))
            rest = one.unused_data
        yield b"".join(out)
        rest = rest or file.read(chunk)


def parse(raw: bytes) -> tuple | None:
    """A READ row of a record; None for warcinfo. Digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return number["X-Page-Id"], fields["WARC-Target-URI"], size, digest, kind, number["X-Refers-To-Page-Id"], payload if kind == "response" else None


def read_warc(manifest: DataFrame, at_once: int = 200) -> DataFrame:
    """The records of a manifest's files, a file a task, a record at a time; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_shared(path) as file:
                    for raw in members(file):
                        if row := parse(raw):
                            rows.append(row)
                        if len(rows) == at_once:
                            yield arrow_rows(rows, READ)
                            rows = []
                yield arrow_rows(rows, READ)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, from_arrow_schema(READ))


def op6_warc(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"), folder or shared_folder(spark, "warc"))).drop("payload", "url")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS raw FROM pages
), q AS (
  SELECT page_id, octet_length(raw) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
