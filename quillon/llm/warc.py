"""WARC archives with an index: writing, and reading selected records by coalesced byte ranges.

Archives hold one gzip member a record, so that any record can be read alone. Writing yields the index first of all:
(page_id, url, digest, file, offset, length) for each record. Readers sort the index rows they want by file and offset,
join ranges that lie close together into one read, and take the records apart.

Files are named by task attempt and only the index of an attempt that succeeded names them, so a task that is run again
after an executor was lost leaves at most a file that nothing reads. Archives go to a folder that all executors share.

Defined results: a null html is an empty payload, a null url is written as urn:unknown, control characters in a url are
percent-encoded, rows with a null page_id are never the copy that others refer to; rows with equal page_id and payload
are alike.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import new_path, split_by_keys, stash

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
#: Ranges at most GAP bytes apart are read at once, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archives that one reading task takes, about.
READ_BYTES = 16 << 20
SALTS = 32
INDEX = "page_id long, url string, digest string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A batch of rows of numbers, texts and bytes, whole numbers exactly as they are."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[k]) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], list(names))


def copies(pages: DataFrame) -> DataFrame:
    """(digest, keep) of payloads that several of pages (page_id, digest, payload_bytes) hold: the page that others revisit."""
    groups = pages.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1 and keep is not null").select("digest", "keep")


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else int(page_id)}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:unknown"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit leaves the payload out and keeps its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, digest, record_type, refers_to, url, payload) of a gzip member; a wrong digest is an error."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(name: str | None):
        return None if name in (None, "<urn:page:null>") else int(name[len("<urn:page:") : -1])

    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, digest, refers_to) below folder; the stored index of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for page_id, url, html, digest, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page_id, url, (html or "").encode("utf-8", "replace"), digest, ref)
                out.write(member)
                entries.append((page_id, url, digest, f"{folder}/{name}", at, len(member)))
                at += len(member)
            yield _records(entries, INDEX)
        if out is not None:
            out.close()

    return stash(rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of index name, read in order of file and offset, near ranges at once.

    Tasks are as many as the records' bytes ask for.
    """

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, run = None, []
        for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if run and (file != name or offset - sum(run[-1]) > GAP or offset + length - run[0][0] > SPAN):
                yield name, run
                run = []
            name = file
            run.append((offset, length))
        if run:
            yield name, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, run in runs(batch):
                if file != name:
                    if source is not None:
                        source.close()
                    system, path = _open(file)
                    name, source = file, system.open_input_file(path)
                first = run[0][0]
                data = source.read_at(sum(run[-1]) - first, first)
                for o, n in run:
                    x = parse(data[o - first : o - first + n])
                    rows.append(x if with_payload else (*x[:-1], None))
                    held += x[1] if with_payload else 0
                if held > SPAN:
                    yield _records(rows, RECORD)
                    rows, held = [], 0
            yield _records(rows, RECORD)

    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // READ_BYTES)
    ordered = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder, copies as revisits; the index.

    Copies are counted before anything is shuffled by digest. Only pages that may be copies are shuffled, salted, so a
    payload that a third of all pages share is spread over many tasks; the others are written where they are read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(html.cast("binary")).alias("digest")
    groups = stash(copies(pages.select("page_id", digest, F.octet_length(html).cast("long").alias("payload_bytes"))), "page-copies")
    near, far = split_by_keys(pages.select("page_id", "url", "html", digest), groups, ["digest"])
    salted = groups.select("digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # Both sides grow with the corpus, so neither is broadcast at any size.
    near = near.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted.hint("merge"), ["digest", "salt"], "left")
    near = near.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    return write_archives(near.select(*columns).unionByName(far.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)), folder)


def op6_query(spark, sf_dir: str) -> DataFrame:
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
