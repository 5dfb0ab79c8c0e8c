"""WARC archives with an index written first-class, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.scratch import materialise, new_path

GAP, RANGE = 256 << 10, 8 << 20  # ranges closer than GAP are read at once, up to RANGE bytes
BLOCK = 64 << 20  # bytes of an archive that one reading task takes
GZIP_LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"  # pages carry no capture time
BROADCAST_REPEATS = 500_000  # repeated payloads up to which their digests (40 characters and an id) are sent to the tasks

_INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, intact boolean"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of one gzip member; ``intact`` tells whether a response's payload has its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload.decode("utf-8"),
        "intact": revisit or (len(payload) == size and digest_of(payload) == digest),
    }


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """Write one archive a task under ``folder`` and return the index of all records.

    Which record is a response is decided on digests and ids alone.  Up to
    ``broadcast_repeats`` repeated payloads, their digests go to the tasks and no
    payload is shuffled; beyond that, or where a page stands twice with one
    payload, payloads are shuffled once to meet the decision.

    Of records with equal payloads of at least ``revisit_bytes``, the one with
    the smallest page id is the response and the others revisit it; equal ids
    with equal payloads give one response and revisits of it.  A null page id is
    never chosen before another id (an id of -2**63 stands for it and is one with it);
    a group of null ids alone is all responses.
    A null html is an empty payload, a null url has no target line, line breaks in a
    url are percent-encoded.  An archive
    has a name of its own, so a task that runs again leaves the first file unused
    and the index, which Spark commits, names the right one.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    same = ["digest", "key"]
    keyed = page.withColumn("key", F.coalesce("page_id", F.lit(-(2**63)).cast("long")))
    narrow = keyed.filter(F.octet_length("html") >= revisit_bytes).select("page_id", *same)
    counted = narrow.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    repeated = counted.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("n").alias("most")).filter("n > 1 and first is not null")
    repeated = materialise(repeated, "repeated")
    size = repeated.agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).first()
    if size["n"] <= broadcast_repeats and (size["most"] or 1) == 1:
        enough = F.octet_length("html") >= revisit_bytes
        placed = keyed.join(F.broadcast(repeated.select("digest", "first")), "digest", "left").withColumn("first", F.when(enough, F.col("first")))
        placed = placed.select("page_id", "url", "html", "first")
    else:
        firsts = counted.select(*same).join(repeated.select("digest", "first"), "digest")
        # equal ids with equal payloads meet in one task
        placed = keyed.repartition(*same).join(firsts, same, "left")
        placed = placed.sortWithinPartitions("page_id", "digest", "url").select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset, last = None, 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = digest_of(payload)
                    revisit = first is not None and (page_id != first or last == (page_id, digest))
                    last = (page_id, digest)
                    member = record(page_id, url, payload, digest, first, revisit)
                    out.write(member)
                    rows.append((page_id, url, name, offset, len(member), digest, "revisit" if revisit else "response", first if revisit else None))
                    offset += len(member)
                yield _batch(rows, _INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return placed.mapInArrow(write, _INDEX)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, read by sorted byte ranges that are joined where they lie close."""
    block = (F.col("offset") / BLOCK).cast("long")
    wanted = index.select("file", "offset", "length").repartition("file", block).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            spans = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(spans):
                file, start, length = spans[i]
                j, end = i + 1, start + length
                while j < len(spans) and spans[j][0] == file and spans[j][1] - end <= GAP and spans[j][1] + spans[j][2] - start <= RANGE:
                    end = max(end, spans[j][1] + spans[j][2])
                    j += 1
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(end - start, start)
                found = [parse(data[o - start : o - start + n]) for _, o, n in spans[i:j]]
                yield pa.RecordBatch.from_pylist(found, schema=_READ_SCHEMA)
                i = j

    return wanted.mapInArrow(read, _READ)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


_INDEX_SCHEMA, _READ_SCHEMA = _arrow(_INDEX), _arrow(_READ)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame, revisit_bytes: int = 0, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """Write all pages, keep the index as a table, and read every record back through it."""
    folder = new_path(pages.sparkSession, "warc")
    index = materialise(write_archives(pages, folder, revisit_bytes, broadcast_repeats=broadcast_repeats), "warc-index")
    return read_archives(index, folder)
