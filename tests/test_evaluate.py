import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscan.operators import evaluate as e


def test_greedy_takes_the_last_of_equal_and_accepts_a_half():
    assert e.greedy(np.array([[0.5, 0.5]])) == [(0, 1, 0.5)]
    assert e.greedy(np.array([[0.49]])) == []
    assert [x[:2] for x in e.greedy(np.array([[0.9, 0.8], [0.9, 0.6], [0.9, 0.9]]))] == [(0, 0), (1, 1)]


def test_first_fit_needs_more_than_a_half():
    assert [x[:2] for x in e.first_fit(np.array([[0.5, 0.6, 0.9], [0.7, 0.6, 0.9]]))] == [(0, 1), (1, 0)]


@pytest.mark.parametrize("counts, want", [((0, 0, 0), (1.0, 1.0, 1.0)), ((0, 2, 0), (0.0, 1.0, 0.0)), ((2, 0, 0), (0.0, 0.0, 0.0)), ((4, 2, 2), (1.0, 0.5, 2 / 3))])
def test_sample_metrics(spark, counts, want):
    row = spark.range(1).select(*[c.alias(n) for n, c in e.precision_recall(*(F.lit(x) for x in counts)).items()]).first()
    assert tuple(row) == pytest.approx(want)


def test_report_of_a_page_without_pairs(spark):
    ours = spark.createDataFrame([(1, 1, "a")], "page_id long, id long, text string")
    reference = spark.createDataFrame([(2, 1, "b")], "page_id long, id long, text string")
    none = spark.createDataFrame([], "page_id long, our_id long, ref_id long")
    pages = e.page_report(ours, reference, none)
    assert sorted(tuple(r)[:5] for r in pages.collect()) == [(1, 0, 1, 0, 0), (2, 1, 0, 0, 0)]
    assert e.total_report(pages).first()["exact_rate"] == 0.0


def test_f_measure(spark):
    assert spark.range(1).select(e.f_measure(F.lit(0.5), F.lit(0.5))).first()[0] == pytest.approx(0.5)


def test_comparing_in_one_pass_equals_the_report_of_pairs(spark):
    rng = np.random.default_rng(5)

    def side(n):
        at = rng.integers(0, 40, (n, 2)).astype(float)
        rows = [(int(rng.integers(0, 6)), k, *xy, *(xy + rng.integers(10, 30, 2)), str(rng.integers(0, 3)) if k % 7 else None) for k, xy in enumerate(at)]
        return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], "page_id long, id long, x1 double, y1 double, x2 double, y2 double, text string")

    ours, reference = side(60), side(70)
    want = e.page_report(ours, reference, e.iou_match(ours, reference))
    got = e.compared(ours, reference)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().toString().count("MapInArrow") and "Join" not in got._jdf.queryExecution().toString()


def test_pairs_by_parts_equal_the_loop(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = (np.hstack([x, x + rng.integers(5, 20, x.shape)]).astype(float) for x in (rng.integers(0, 30, (n, 2)) for n in (40, 50)))
    monkeypatch.setattr(e, "CELLS", 120)
    overlap = e.iou_matrix(a, b)
    for best, limit in ((True, 0.2), (False, 0.2)):
        free, want = set(range(len(b))), []
        for i, row in enumerate(overlap):
            ok = [j for j in free if (row[j] >= limit if best else row[j] > limit)]
            if ok:
                j = max(ok, key=lambda j: (row[j], j)) if best else min(ok)
                free.remove(j)
                want.append((i, j, row[j]))
        assert e._pairs(a, b, best, limit) == want and len(want) > 10
