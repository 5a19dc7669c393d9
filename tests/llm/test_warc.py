import gzip
import hashlib
import zlib
from pathlib import Path

import pytest

from leafscan.llm import warc

SCHEMA = "page_id long, url string, html string, extra string"


def pages(spark):
    same, tiny = "x" * 1500, "t"
    rows = [(1, "http://a/1", same, "e"), (2, "http://a/ 2\r\n", same, "e"), (9, None, same, "e"), (3, "u", tiny, None), (4, "u", tiny, None), (5, "ü", "é" * 499, None), (6, "u", None, None), (7, "u", "", None), (8, "u", "漢" * 100_000, None), (None, "u", "n" * 1200, None), (10, "u", "a\r\n\r\nb" * 300, None), (10, "u", "a\r\n\r\nb" * 300, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/w"
    index = warc.write(df, path)
    got = sorted((tuple(r) for r in warc.read(index, path).collect()), key=str)
    want = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        first = {"x" * 1500: 9}.get(html, page_id)
        revisit = first != page_id
        want.append((page_id, "revisit" if revisit else "response", first if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if revisit else raw))
    assert sorted(((r[0], *r[2:6], None if r[6] is None else bytes(r[6])) for r in got), key=str) == sorted(want, key=str)


def test_files_are_archives(spark, tmp_path):
    _, df = pages(spark)
    index = warc.write(df, f"file://{tmp_path}/w")
    for path in Path(tmp_path, "w").iterdir():
        whole = gzip.decompress(path.read_bytes())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.endswith(b"\r\n\r\n")
    for r in index.collect():
        raw = Path(r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())


def test_selected_records_alone_are_read(spark, tmp_path):
    _, df = pages(spark)
    path = f"file://{tmp_path}/w"
    index = warc.write(df, path)
    assert {r["page_id"] for r in warc.read(index.where("page_id in (3, 8)"), path).collect()} == {3, 8}


def test_neighbours_are_one_read():
    reads = list(warc.coalesced([("a", 0, 10), ("a", 10, 10), ("a", 200, 10), ("b", 0, 5), ("b", 5, 100)], gap=50, most=60))
    assert [(f, o, n, len(h)) for f, o, n, h in reads] == [("a", 0, 20, 2), ("a", 200, 10, 1), ("b", 0, 5, 1), ("b", 5, 100, 1)]


def test_damage_is_an_error():
    raw = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    good = zlib.decompress(raw, 31)
    packed = gzip.compress(good.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(packed)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    index = warc.write(spark.createDataFrame([], SCHEMA), path)
    assert index.count() == 0 and warc.read(index, path).count() == 0
