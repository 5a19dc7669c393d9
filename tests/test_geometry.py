import math

import pytest
from pyspark.sql import functions as F

from leafscan.functions import geometry as g
from leafscan.operators import polygons


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_touching_boxes_and_boxes_apart(spark):
    r = one(spark, g.intersection(box(0, 0, 10, 10), box(10, 0, 20, 10)), g.intersection(box(0, 0, 10, 10), box(11, 0, 20, 10)), g.iou(box(5, 5, 5, 5), box(5, 5, 5, 5)))
    assert tuple(r) == (0.0, -1.0, 0.0)


def test_iou_is_symmetric_and_floored(spark):
    a, b = box(0, 0, 4, 4), box(2, 1, 6, 5)
    r = one(spark, g.iou(a, b), g.iou(b, a), g.iou(box(0, 0, 0.5, 0.5), box(0, 0, 0.5, 0.5), 1.0))
    assert r[0] == r[1] and r[2] == 0.25


def test_letterbox(spark):
    found = g.letterbox(F.lit(500), F.lit(1000))
    assert tuple(one(spark, *found.values())) == (1.024, 512, 1024, 512, 0)


def test_half_even_padding(spark):
    # (40 * .25 + 40 * .75) / 16 = 2.5
    assert [x for x in one(spark, *g.expanded(box(50, 50, 90, 90), F.lit(1000.0), F.lit(1000.0)))] == [48.0, 48.0, 92.0, 92.0]


def test_rotation_truncates(spark):
    quad = [(F.lit(x), F.lit(y)) for x, y in ((10, 0), (0, 10), (-10, 0), (0, -10))]
    turned = g.rotated(quad, (F.lit(0), F.lit(0)), F.lit(30))
    r = one(spark, *[c for p in turned for c in p])
    assert list(r) == [8, -5, 5, 8, -8, 5, -5, -8] or list(r) == [8, -4, 4, 8, -8, 4, -4, -8]


def test_angle_rules(spark):
    up = g.text_angle(F.lit(0.0), F.lit(10.0), F.lit(True))
    slight = g.text_angle(F.lit(100.0), F.lit(4.0), F.lit(False))
    steep = g.text_angle(F.lit(10.0), F.lit(10.0), F.lit(False))
    assert tuple(one(spark, up, slight, steep)) == (0, 0, 45)


def test_rotated_iou_of_upright_boxes_is_plain_iou():
    import numpy as np

    a, b = np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), np.array([[2, 1], [6, 1], [6, 5], [2, 5]])
    assert polygons.rotated_iou(a, b) == pytest.approx(6 / 26)
    assert polygons.rotated_iou(a, b, "least") == pytest.approx(6 / 16)
    assert polygons.rotated_iou(a, a + 10) == 0
    turned = np.array([[2, -1], [5, 2], [2, 5], [-1, 2]])
    assert polygons.polygon_iou(a, turned) == pytest.approx(14 / (16 + 18 - 14))


def test_least_rectangle_of_a_turned_square():
    import numpy as np

    r = polygons.least_rectangle(np.array([[2, -1], [5, 2], [2, 5], [-1, 2], [2, 2]]))
    assert polygons.area(r) == pytest.approx(18)


def test_unclipped_rectangle(spark):
    quad = [(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 4), (0, 4))]
    d = 40 * 1.5 / 28
    r = one(spark, *polygons.unclipped(quad).values())
    assert [round(x, 9) for x in r] == [round(x, 9) for x in (-d, -d, 10 + d, 4 + d)]


def test_edge_distance():
    d = polygons.edge_distance(5, 5, (0, 0), (4, 0), 2.0)
    assert d[0].max() == 0 and d[1, 2] == 0.5 and d[4, 4] == 1


def test_boxes_from_bitmap():
    import numpy as np

    p = np.zeros((20, 20))
    p[5:10, 4:14] = 0.8
    p[15, 15] = 0.9  # too thin
    (corners, score), = polygons.boxes_from_bitmap(p)
    d = 9 * 4 * 1.5 / (2 * 13)
    assert score == pytest.approx(0.8)
    assert sorted(map(tuple, corners.tolist())) == sorted((x, y) for x in (round(4 - d), round(13 + d)) for y in (round(5 - d), round(9 + d)))
    assert math.isclose(d, 36 * 1.5 / 26)


def test_many_rotated_ious_equal_one_by_one(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(11)
    made = []
    for n in range(400):
        x, y, w, h = (int(v) for v in rng.integers((0, 0, 5, 5), (60, 60, 50, 50)))
        s, t = (int(v) for v in rng.integers(-4, 5, 2))
        quad = np.array([[x, y], [x + w, y + s], [x + w + t, y + h + s], [x + t, y + h]], float)
        made.append(quad[::-1] if n % 3 == 0 else np.roll(quad, n % 4, axis=0))
    made[7], made[8] = made[7][[0, 0, 2, 3]], np.array([[0, 0], [4, 0], [8, 0], [4, 9]], float)  # three corners; one on a side
    made[9] = np.array([[0, 0], [10, 10], [10, 0], [0, 10]], float)  # crossing sides
    a, b = np.array(made[:200] + made[:50]), np.array(made[200:] + made[:50])
    want = [polygons.rotated_iou(p, q) for p, q in zip(a, b, strict=True)]
    assert polygons.rotated_ious(a, b) == pytest.approx(want, abs=1e-9) and 50 < sum(v > 0 for v in want) < 240
    monkeypatch.setattr(polygons, "rotated_iou", None)
    assert len(polygons.rotated_ious(a[100:200], b[100:200])) == 100
    assert len(polygons.rotated_ious(a[:0], b[:0])) == 0
