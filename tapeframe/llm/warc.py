"""WARC archives with an index that is written first, and reads by coalesced byte ranges.

Writing: every task appends gzip members, one WARC record each, to an archive of its own under a shared folder and
returns one index row per record (archive, offset, length, URL, digest, ...).  The index is stored as a table before
anything is read.  Payloads are brought together once per digest by an aggregation that combines in the map tasks;
the other rows travel without payload and become revisit records.  An archive of a failed attempt is named by no
index row.

Reading: the selected index rows are sorted by archive and offset, neighbours with small gaps are merged into one
range of bounded size, and every record is cut out of its range and parsed.

Archives are opened through the file systems pyarrow knows (local or mounted folders, HDFS, S3, GCS).

Defined results: null payloads are empty ones; of records with equal payloads of at least ``least_bytes`` the one
with the smallest key (null last, then by URL) is a response, the others revisit it; of exactly repeated rows one
can be the response; null keys and URLs come back as null; other columns are not read; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.runtime import new_path, stage

ROLL_BYTES = 1 << 30
BLOCK_BYTES = 8 << 20
GAP_BYTES = 64 << 10
ROWS_OUT = 200
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = ("archive string, offset bigint, length bigint, key string, url string, digest string, record_type string, refers_to string, "
         "payload_bytes bigint")
RECORD = "key string, url string, digest string, record_type string, refers_to string, payload_bytes bigint, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(text: str) -> str:
    """Header text: control characters and per cent signs are written as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text)


def unescaped(text: str) -> str:
    head, *rest = text.split("%")
    return head + "".join(chr(int(part[:2], 16)) + part[2:] for part in rest)


def record_id(key: str | None, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((key, url, digest, copy)))}>"


def record_bytes(row: dict) -> bytes:
    """One record; a revisit has the HTTP headers of the payload it refers to, and no body."""
    response = row["record_type"] == "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block += row["payload"] if response else b""
    digest = row["digest"]
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["key"], row["url"], digest, row["copy"]), "WARC-Date": DATE,
            "WARC-Target-URI": row["url"], "X-Record-Key": row["key"], "WARC-Payload-Digest": "sha1:" + digest}
    if not response:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"], row["refers_url"], digest), "X-Refers-To-Key": row["refers_to"]}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = [f"{name}: {escaped(value)}" for name, value in head.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of one record; the digest of a response is taken from its payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    head = {name: unescaped(value) for name, _, value in (line.partition(": ") for line in lines)}
    http, _, payload = rest[:int(head["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(line.partition(b": ")[2] for line in http.split(b"\r\n") if line.startswith(b"Content-Length")))
    digest, response = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "response"
    if response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    return {"key": head.get("X-Record-Key"), "url": head.get("WARC-Target-URI"), "digest": digest, "record_type": head["WARC-Type"],
            "refers_to": head.get("X-Refers-To-Key"), "payload_bytes": size, "payload": payload if response else None}


def planned(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Rows to write: key, url, payload (null for revisits), digest (hex), payload_bytes, record_type, refers_to, refers_url, copy."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    shared, short = rows.where(F.col("payload_bytes") >= least_bytes), rows.where(F.col("payload_bytes") < least_bytes)
    order = [F.col("key").isNull().alias("no_key"), F.col("key"), F.col("url").isNull().alias("no_url"), F.col("url")]
    whole = shared.groupBy("digest").agg(F.min(F.struct(*order, "payload")).alias("first"), F.min("payload_bytes").alias("payload_bytes"))
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    columns = ["key", "url", "payload", "digest", "payload_bytes", "record_type", "refers_to", "refers_url", "copy"]
    response = lambda frame: frame.select(text("key").alias("key"), "url", "payload", "digest", "payload_bytes", F.lit("response").alias("record_type"),
                                          none.alias("refers_to"), none.alias("refers_url"), F.lit(0).alias("copy")).select(columns)
    responses = response(whole.select("first.key", "first.url", "first.payload", "digest", "payload_bytes"))
    counted = shared.groupBy("digest", "payload_bytes", "key", "url").count()
    first = counted.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))  # narrow: payloads are shuffled once
    named = counted.join(first.select("digest", F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url")), "digest")
    own = F.col("key").eqNullSafe(F.col("first_key")) & F.col("url").eqNullSafe(F.col("first_url"))
    copies = F.col("count") - F.when(own, 1).otherwise(0)
    revisits = named.where(copies > 0).select(
        text("key").alias("key"), "url", F.lit(None).cast("binary").alias("payload"), "digest", "payload_bytes", F.lit("revisit").alias("record_type"),
        text("first_key").alias("refers_to"), F.col("first_url").alias("refers_url"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
    return responses.union(revisits).union(response(short))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
          roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under ``folder`` and returns the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        system.create_dir(root, recursive=True)
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    row["digest"] = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    member = gzip.compress(record_bytes(row), compresslevel=6, mtime=0)
                    out.write(member)
                    rows.append({"archive": name, "offset": at, "length": len(member)} | {k: row[k] for k in ("key", "url", "digest", "record_type", "refers_to", "payload_bytes")})
                    at += len(member)
                yield from to_batches(rows, INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return stage(planned(pages, key, url, payload, least_bytes).mapInArrow(run, INDEX), "warc-index")


def to_batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


INDEX_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string()), ("url", pa.string()),
                         ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64())])
RECORD_ARROW = pa.schema([("key", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                          ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def coalesced(spans: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) -> (archive, start, end, spans) with gaps up to ``gap`` read along."""
    archive, start, end, held = "", 0, 0, []
    for name, offset, length in spans:
        if held and (name != archive or offset > end + gap or offset + length - start > most):
            yield archive, start, end, held
            held = []
        if not held:
            archive, start, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield archive, start, end, held


def read(selected: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records of the selected index rows: key, url, digest, record_type, refers_to, payload_bytes, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        spans = ((a, o, n) for b in batches for a, o, n in zip(*(b.column(i).to_pylist() for i in range(3))))
        name, source = "", None
        for archive, start, end, held in coalesced(spans, gap_bytes, block_bytes):
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, system.open_input_file(f"{root}/{archive}")
            raw = source.read_at(end - start, start)
            for at in range(0, len(held), ROWS_OUT):
                rows = [parsed(gzip.decompress(raw[o - start:o - start + n])) for o, n in held[at:at + ROWS_OUT]]
                yield from to_batches(rows, RECORD_ARROW)
        if source is not None:
            source.close()

    spans = selected.select("archive", "offset", "length", F.floor(F.col("offset") / block_bytes).alias("block"))
    # Index rows are small and what they point at is not, so the number of tasks follows the bytes to read.
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * block_bytes)))
    ordered = spans.repartition(tasks, "archive", "block").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return ordered.mapInArrow(run, RECORD)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
