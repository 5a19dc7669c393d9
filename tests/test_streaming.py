import json

from leafscan.streaming import pages


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        rows = [{"seq": n, "page_id": n, "file": f"{n}.png", "width": 9, "height": 9, "line_no": k, "text": f"a{k} …", "box": [0.0, 0.0, 1.0, 1.0], "vertical": False} for k in range(n)] or [
            {"seq": n, "page_id": n, "file": f"{n}.png", "width": 9, "height": 9, "error": "bad"}
        ]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    query = pages.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=1)
    query.awaitTermination(60)
    got = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
    batch = pages.records(spark.read.schema(pages.LINES).json(str(source)))
    assert got == sorted(r["record"] for r in batch.collect()) and len(got) == 3
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
