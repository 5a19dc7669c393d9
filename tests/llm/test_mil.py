import numpy as np
import pytest

from leafscan.llm import mil

from .helpers import no_docs, odd_docs, words


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 6)).astype(np.float32)
    first, label = np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0], np.float32)
    model = mil.train(x, first, label, epochs=1)
    model.weights = {k: np.array(v, np.float64) for k, v in model.weights.items()}
    loss = lambda: float(-(label * np.log(model.forward(x, first)["y"]) + (1 - label) * np.log(1 - model.forward(x, first)["y"])).mean())
    g = model.gradient(x, first, label)
    for k, v in model.weights.items():
        at = (0,) * v.ndim
        held = v[at].copy()
        v[at] = held + 1e-5
        up = loss()
        v[at] = held - 1e-5
        down = loss()
        v[at] = held
        assert (up - down) / 2e-5 == pytest.approx(float(np.asarray(g[k])[at]), abs=2e-4)


def test_attention_sums_to_one_in_each_bag():
    x = np.random.default_rng(1).normal(size=(7, 4)).astype(np.float32)
    first = np.array([0, 3, 4])
    out = mil.train(x, first, np.array([1, 0, 1]), epochs=2).forward(x, first)
    assert np.add.reduceat(out["a"], first) == pytest.approx([1, 1, 1])


def test_passages_of_a_text():
    x, owner = mil.encode([b"a " * 130, b"", b"b"])
    assert owner.tolist() == [0, 0, 0, 1, 2] and not x[3].any() and x[0, mil.PAIRS + 1] > x[2, mil.PAIRS + 1]
    whole, _ = mil.encode([b"q " * 64, b"r s"])
    alone, _ = mil.encode([b"r s"])
    assert np.allclose(whole[1], alone[0])


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = mil.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_odd_rows_and_missing_classes(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = mil.classified(odd_docs(spark), labels).collect()
    assert len(out) == 14 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    same = mil.classified(odd_docs(spark), labels.where("quality = 1")).collect()
    assert {r["score"] for r in same} == {0.5}
    assert mil.classified(no_docs(spark), labels).count() == 0
    assert mil.classified(odd_docs(spark), labels.limit(0)).count() == 14


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, " ".join(words(20, k))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert mil.fit(docs, labels, max_bags=1) is None and mil.fit(docs, labels, max_bags=20) is not None
