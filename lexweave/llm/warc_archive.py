"""WARC archives with an index that is written first and drives all reading.

``write_archive`` writes one gzip member for each page, a task at a time into files of its own in the shared folder,
and an index row with file, offset, length, URL and digest.  The index goes through Spark's commit, so only rows of
tasks that ended count; what a lost task left behind is never read.  ``read_records`` takes any selection of index
rows, deals them by stretches of a file, sorts them by offset and reads neighbouring ranges as one.

Of pages with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is a response and the rest
are revisits of it; shorter ones are all responses.  Defined results: a null payload is empty; of repeated rows with
the smallest id each is a response; a null id is larger than any other, and pages with equal payloads and only null
ids are all responses; a null URL has no target header; an empty table gives an empty index.  When read, a record's id,
target, digest and reference must be the index's, and its body must have its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import bounded_batches, materialize, new_folder, pieces, quoted

FILE_BYTES = 256 << 20
#: Digests that several payloads share are broadcast up to so many, about 80 MB.
BROADCAST_ROWS = 500_000
RANGE_GAP = 64 << 10
RANGE_BYTES = 8 << 20
STRETCH = 16 << 20


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _clean(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: the payload in an HTTP response, or the response's head alone for a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's full length as its HTTP head gives it, and the payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 100) -> DataFrame:
    """id, url, payload, digest, and the id that a revisit refers to."""
    base = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.coalesce(F.col(quoted(payload_col)), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    shared = base.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    shared = materialize(shared, "shared-payloads")  # a table of its own: broadcast if it is small, else a join that Spark can split
    planned = base.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "digest", "left")
    return planned.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archive(planned: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", level: int = 2) -> DataFrame:
    """Write archives under ``folder`` and return their index, which is written there too."""
    id_type = planned.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", id_type),
        T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in pieces(batches):
                files, offsets, lengths = [], [], []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, payload, digest, refers_to = row
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(make_record(page_id, url, payload.encode(), digest, refers_to, refers_to is not None, date), level, mtime=0)
                    out.write(member)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                columns = [batch.column(i) for i in (0, 1, 3, 4)] + [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        finally:
            if out is not None:
                out.close()

    bounded_batches(planned).mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return planned.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = RANGE_GAP, most: int = RANGE_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) joined to (offset, end, which) where at most ``gap`` bytes lie between and the whole stays under ``most``."""
    out: list[list] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append(i)
        else:
            out.append([offset, offset + length, [i]])
    return [tuple(x) for x in out]


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the selected index rows' records: id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload (null for a revisit)."""
    spark = selected.sparkSession
    id_type = selected.schema["id"].dataType
    fields = [T.StructField("id", id_type), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type)]
    if payloads:
        fields.append(T.StructField("payload", T.BinaryType()))
    schema = T.StructType(fields)
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // (2 * STRETCH)))
    dealt = selected.select("id", "url", "digest", "refers_to", "file", "offset", "length").repartition(parts, F.col("file"), F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for piece in pieces([batch], 1000):
                rows = piece.to_pylist()
                found: list[list] = [[] for _ in fields]
                by_file: dict[str, list[dict]] = {}
                for r in rows:
                    by_file.setdefault(r["file"], []).append(r)
                for name, own in by_file.items():
                    with filesystem.open_input_file(f"{root}/{name}") as source:
                        for start, end, which in coalesce_ranges([(r["offset"], r["length"]) for r in own]):
                            data = source.read_at(end - start, start)
                            for i in which:
                                r = own[i]
                                member = data[r["offset"] - start : r["offset"] - start + r["length"]]
                                headers, length, payload = parse_record(zlib.decompress(member, 31))
                                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                                refers_to = record_id(r["refers_to"]) if r["refers_to"] is not None else None
                                target = _clean(r["url"]) if r["url"] is not None else None
                                if digest != r["digest"] or headers["WARC-Record-ID"] != record_id(r["id"]) or headers.get("WARC-Refers-To") != refers_to or headers.get("WARC-Target-URI") != target:
                                    raise ValueError(f"{name} at {r['offset']}: the record is not the index's")
                                if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                                    raise ValueError(f"{name} at {r['offset']}: the payload does not match its digest")
                                values = [r["id"], r["url"], length, digest, kind, r["refers_to"] if kind == "revisit" else None]
                                for column, v in zip(found, [*values, payload if kind == "response" else None], strict=False):
                                    column.append(v)
                arrow = [batch.schema.field("id").type, pa.string(), pa.int64(), pa.string(), pa.string(), batch.schema.field("id").type, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, arrow, strict=False)], schema.names)

    return dealt.mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 100) -> DataFrame:
    """Write every page to archives in the shared folder and read every record back, without payloads."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_archive(plan_records(pages, id_col, url_col, payload_col, revisit_from), folder)
    return read_records(index, folder, payloads=False)
