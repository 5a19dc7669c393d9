"""WARC archives that are read through an index.

Writing gives one gzip member per record and returns the index: file, offset, length, URL, payload
digest, type.  Reading starts from the index: selected entries are sorted by file and offset,
neighbours are coalesced into one byte-range read, and the records are cut out and unpacked.

Archives lie in a folder that all executors reach (any file system that pyarrow opens by URI).  A
task writes a file with a name of its own, and only the index rows of tasks that ended are kept, so a
lost executor or a second attempt leaves at most a file that no index names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, saved, scratch_path

#: Payloads under this many bytes are never revisits.
LEAST_REVISIT = 1000
GZIP_LEVEL = 4
#: Reads of records at most this far apart are one read, up to this many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Bytes of selected records that a task reads.
TASK_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record of ``refers_to`` (its block keeps the HTTP head alone)."""
    revisit = refers_to is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _urn(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(headers, http if revisit else http + payload)


def parsed(raw: bytes) -> tuple:
    """A row of RECORDS from one gzip member; a damaged member or digest is an error."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    return _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(headers.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): the largest page_id of equal payloads of ``least`` bytes or more, null on itself."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(html) >= least, F.sha1(html.cast("binary"))).alias("digest"))
    named = F.concat(F.lit("sha1:"), "digest")
    first = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(named.alias("key"), "largest")
    # payloads without a digest get a key by their row, so that they spread; a frequent payload's partition can be split
    held = keyed.withColumn("key", F.coalesce(named, F.concat(F.lit("row "), F.xxhash64("page_id", "url", "html").cast("string"))))
    refers = F.when(F.col("page_id") != F.col("largest"), F.col("largest"))
    return held.join(first, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``; gives the index as a stored table.

    A null html is an empty payload, a null url gives no target, a null page_id gives a response.
    Rows with equal page_id are separate records.  An empty table gives an empty index.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        sink, name, offset = None, "", 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if sink is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(name, compression=None)
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    sink.write(info)
                    offset = len(info)
                out = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    raw = record(page_id, url, payload, refers_to, date)
                    sink.write(raw)
                    out.append((name, offset, len(raw), url, hashlib.sha1(payload).hexdigest(), page_id, "response" if refers_to is None else "revisit"))
                    offset += len(raw)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        finally:
            if sink is not None:
                sink.close()

    bounded_batches(pages.sparkSession)
    return saved(with_revisits(pages, least).mapInArrow(kernel, INDEX), "warc-index")


def coalesced(entries: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, offset, length, records) reads for entries sorted by file and offset; a longer record is one read."""
    held: list[tuple[int, int]] = []
    name, begin, end = "", 0, 0
    for file, offset, length in entries:
        if held and (file != name or offset - end > gap or offset + length - begin > most):
            yield name, begin, end - begin, held
            held = []
        if not held:
            name, begin, end = file, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield name, begin, end - begin, held


def read(index: DataFrame, path: str) -> DataFrame:
    """RECORDS of the index entries, in any order; entries that are not selected are not read, or passed over in a gap."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        source, opened = None, ""
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name, begin, length, held in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened = fs.open_input_file(name), name
                raw = source.read_at(length, begin)
                rows = [parsed(raw[o - begin : o - begin + n]) for o, n in held]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])
        if source is not None:
            source.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    ordered = index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(kernel, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, read every record back and report on it."""
    path = scratch_path(pages.sparkSession, "warc")
    index = write(pages, path)
    return read(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
