from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafscan.operators import detect

SCHEMA = "page_id long, det_id long, label int, conf double, x1 double, y1 double, x2 double, y2 double"


def kept(spark, rows, **how):
    return [r["det_id"] for r in detect.suppressed(spark.createDataFrame(rows, SCHEMA), **how).orderBy("rank").collect()]


def test_golden_cases(spark):
    small = [(0, 1, 0, 0.9, 0.0, 0.0, 0.5, 0.5), (0, 2, 0, 0.8, 0.0, 0.0, 0.5, 0.5)]
    assert kept(spark, small) == [1, 2]  # the union counts as 1
    other = [(0, 1, 0, 0.9, 0.0, 0.0, 9.0, 9.0), (0, 2, 1, 0.8, 0.0, 0.0, 9.0, 9.0)]
    assert kept(spark, other) == [1, 2]
    equal = [(0, 1, 0, 0.9, 0.0, 0.0, 27.0, 10.0), (0, 2, 0, 0.9, 13.0, 0.0, 40.0, 10.0)]  # 140 / 400
    assert kept(spark, equal) == [1, 2]
    over = [(0, 1, 0, 0.9, 0.0, 0.0, 27.0, 10.0), (0, 2, 0, 0.9, 12.0, 0.0, 39.0, 10.0)]
    assert kept(spark, over) == [1]


def test_caps(spark):
    rows = [(0, k, 0, 1 - k / 100, 20.0 * k, 0.0, 20.0 * k + 5, 5.0) for k in range(10)]
    assert kept(spark, rows, keep=3) == [0, 1, 2] and kept(spark, rows, cap=4) == [0, 1, 2, 3]


boxes = st.lists(st.tuples(st.integers(0, 1), st.integers(1, 9), st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(boxes)
def test_equals_a_loop_and_is_idempotent(spark, found):
    rows = [(0, k, label, c / 10, float(x), float(y), float(x + w), float(y + h)) for k, (label, c, x, y, w, h) in enumerate(found)]
    want = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        def overlap(o, r=r):
            c = max(0, min(o[6], r[6]) - max(o[4], r[4])) * max(0, min(o[7], r[7]) - max(o[5], r[5]))
            return c / max((o[6] - o[4]) * (o[7] - o[5]) + (r[6] - r[4]) * (r[7] - r[5]) - c, 1)
        if not any(o[2] == r[2] and overlap(o) > 0.35 for o in want):
            want.append(r)
    got = kept(spark, rows) if rows else []
    assert got == [r[1] for r in want]
    assert (kept(spark, want) if want else []) == got
