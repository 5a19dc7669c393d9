import json
import struct

import pytest
from pyspark.sql import functions as F

from leafscan.operators import catalog as c
from leafscan.operators import protocol
from leafscan.sources import files


def test_upsert_moves_the_new_entry_last(spark):
    old = spark.createDataFrame([(1, "a", 0, "n"), (2, "b", 1, "m")], "id long, name string, seq int, notes string")
    new = spark.createDataFrame([(1, "A", 0)], "id long, name string, seq int")
    rows = c.upsert(old, new).orderBy("place").select("id", "name", "notes", "place").collect()
    assert [tuple(r) for r in rows] == [(2, "b", "m", 0), (1, "A", None, 1)]
    assert c.upsert(old, new, keep_unknown=True).where("id = 1").first()["notes"] == "n"


def test_assets_of_an_old_version_drop(spark):
    df = spark.createDataFrame([({"x": 1, "y": 2}, {"x": 3})], "o map<string,int>, n map<string,int>")
    assert df.select(c.merged_assets(F.col("o"), F.col("n"), F.lit(True))).first()[0] == {"x": 3, "y": 2}
    assert df.select(c.merged_assets(F.col("o"), F.col("n"), F.lit(False))).first()[0] == {"x": 3}


def test_conditional_library_is_not_hard(spark):
    imports = spark.createDataFrame([("a.pyd", "MSVCP140.dll"), ("a.pyd", "own.dll"), ("b.pyd", "nope.dll"), ("a.pyd", "KERNEL32.dll")], "file string, lib string")
    missing = c.missing_libraries(imports, spark.createDataFrame([("Own.dll",)], "lib string"))
    assert {r["lib"]: r["kind"] for r in missing.collect()} == {"msvcp140.dll": "conditional", "nope.dll": "hard"}
    assert c.audit_fails(missing).first()[0] and not c.audit_fails(missing.where("kind <> 'hard'")).first()[0] and c.audit_fails(missing.where("kind <> 'hard'"), strict=True).first()[0]


def test_hashes_are_required(spark):
    held = spark.createDataFrame([("a", bytearray(b"x"))], "name string, content binary")
    good = spark.createDataFrame([("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")], "name string, sha256 string")
    c.require_verified(held, good)
    with pytest.raises(ValueError, match="missing"):
        c.require_verified(held, good.unionByName(spark.createDataFrame([("b", "0")], "name string, sha256 string")))
    with pytest.raises(ValueError, match="unknown"):
        c.require_known(spark.createDataFrame([("z",)], "t string"), spark.createDataFrame([("a",)], "t string"), "t")


def test_error_page_and_order(spark, tmp_path):
    pages = spark.createDataFrame([(0, 7, "a.png", 800, 1200, None), (1, 8, "b.png", 5, 5, "cannot read")], "seq long, page_id long, file string, width int, height int, error string")
    lines = spark.createDataFrame([(7, 1, "漢", [0.0, 0.0, 1.0, 1.0], True), (7, 0, "", [0.0, 0.0, 1.0, 1.0], True)], "page_id long, line_no int, text string, box array<double>, vertical boolean")
    records = protocol.page_records(pages, lines).unionByName(protocol.meta_record(spark, "e", ["ja"], ["ja"]))
    protocol.write_ordered(records, str(tmp_path / "out"))
    text = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    found = [json.loads(x) for x in text]
    assert [x["kind"] for x in found] == ["meta", "page", "page"] and "漢" in text[1]
    assert found[1]["lines"] == [{"text": "漢", "confidence": 1.0, "box": [0.0, 0.0, 1.0, 1.0], "vertical": True}] and "error" not in found[1]
    assert (found[2]["ok"], found[2]["width"], found[2]["height"], found[2]["lines"], found[2]["error"]) == (False, 0, 0, [], "cannot read")


def test_both_manifest_roots(spark, tmp_path):
    page = {"rel": "a", "absPath": "/a", "width": 1, "height": 2}
    for k, root in enumerate(({"pages": [page, page]}, [page])):
        (tmp_path / f"{k}.json").write_text(json.dumps(root, indent=1))
        assert [tuple(r)[:3] for r in files.read_manifest(spark, str(tmp_path / f"{k}.json")).collect()] == [(n, "a", "/a") for n in range(2 - k)]


def test_vocabulary_catalog_and_hashes(spark, tmp_path):
    (tmp_path / "v").write_text("a\nb\nc\n")
    assert [tuple(r) for r in files.read_vocabulary(spark, str(tmp_path / "v")).orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "c").write_text('{"id":"x","version":1}\n\n{"id":"y","version":2}\n')
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "c"), "id string, version int").orderBy("seq").collect()] == [(0, "x", 1), (1, "y", 2)]
    (tmp_path / "h").write_text('{"format":1,"files":{"m":"00"}}')
    assert [tuple(r) for r in files.read_hashes(spark, str(tmp_path / "h")).collect()] == [("m", "00")]


def image_with_imports(names):
    """A 64-bit PE file with one section that holds the import table."""
    head = bytearray(0x400)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<H", head, 0x86, 1)
    struct.pack_into("<H", head, 0x94, 240)
    struct.pack_into("<H", head, 0x98, 0x20B)
    body = bytearray(20 * (len(names) + 1))
    for k, n in enumerate(names):
        struct.pack_into("<I", body, 20 * k + 12, 0x1000 + len(body))
        body += n.encode() + b"\0"
    if names:
        struct.pack_into("<I", head, 0x98 + 112 + 8, 0x1000)
    struct.pack_into("<IIII", head, 0x98 + 240 + 8, len(body), 0x1000, len(body), 0x400)
    return bytes(head + body)


def test_import_tables(spark, tmp_path):
    assert files.import_names(image_with_imports(["A.dll", "b.DLL"])) == ["a.dll", "b.dll"]
    assert files.import_names(image_with_imports([])) == [] and files.import_names(b"MZ") is None and files.import_names(b"text") is None
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.PYD").write_bytes(image_with_imports(["q.dll"]))
    (tmp_path / "n.txt").write_bytes(b"1234")
    listed = files.listing(spark, str(tmp_path))
    assert [tuple(r) for r in listed.collect()] == [("n.txt", 4), ("sub/x.PYD", listed.collect()[1]["bytes"])]
    edges = files.import_edges(files.listing(spark, str(tmp_path), content=True, names=files.BINARY_NAMES))
    assert [tuple(r) for r in edges.collect()] == [("sub/x.PYD", "q.dll")]


def test_page_without_a_file_goes_on(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    pages = spark.createDataFrame([("a.png",), ("b.png",)], "rel string")
    assert {r["rel"]: r["error"] is None for r in files.page_images(spark, pages, str(tmp_path)).collect()} == {"a.png": True, "b.png": False}


def test_missing_package_is_an_error(spark):
    from leafscan.operators import catalog

    wanted, there = spark.createDataFrame([("Num-Py",), ("cv2",)], "name string"), spark.createDataFrame([("num_py",)], "name string")
    with pytest.raises(ValueError, match="cv2"):
        catalog.require_packages(wanted, there)
    catalog.require_packages(wanted.where("name <> 'cv2'"), there)


def test_thresholds_are_the_operators_own():
    from leafscan.operators import layout
    from leafscan.settings import Thresholds

    assert Thresholds().assign == layout.ASSIGN and Thresholds(assign=0.5).assign == 0.5
