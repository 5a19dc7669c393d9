import numpy as np

from leafscan.operators import mask as m


def test_labels_by_neighbourhood():
    grid = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]])
    assert m.labels(grid, 8)[1] == [(0, 0, 2, 2, 2), (0, 3, 2, 1, 2)]
    assert len(m.labels(grid, 4)[1]) == 3


def test_morphology_ignores_the_outside():
    full = np.full((4, 4), 255, np.uint8)
    assert (m.eroded(full) == 255).all()
    dot = np.zeros((5, 5), np.uint8)
    dot[2, 2] = 255
    assert (m.dilated(dot) == 255).sum() == 9 and (m.dilated(dot, cross=True) == 255).sum() == 5


def test_merge_takes_what_helps():
    predicted = np.zeros((12, 12), np.uint8)
    predicted[2:8, 2:8] = 255
    good, noise = np.zeros_like(predicted), np.zeros_like(predicted)
    good[3:7, 3:7] = 255
    noise[9:12, 9:12] = 255
    out = m.merged([(good, 10), (noise, 20)], predicted)
    assert (out[2:8, 2:8] == 255).all() and out[9:, 9:].sum() == 0


def test_a_component_that_brings_nothing_stays_out():
    predicted = np.zeros((10, 10), np.uint8)
    assert m.merged([(np.eye(10, dtype=np.uint8) * 255, 1)], predicted).sum() == 0


def test_refined_masks_lie_in_their_windows():
    rng = np.random.default_rng(1)
    image = rng.integers(200, 255, (40, 40, 3)).astype(np.uint8)
    image[10:20, 10:30] = 20
    predicted = np.zeros((40, 40), np.uint8)
    predicted[9:21, 9:31] = 255
    out = m.refined(image, predicted, [(8, 8, 32, 22)])
    assert out[12:18, 12:28].min() == 255 and out[30:].sum() == 0
    again = m.refined_undetected(image, predicted.copy(), np.zeros_like(predicted), [])
    assert again[12:18, 12:28].min() == 255
    assert m.refined_undetected(image, predicted.copy(), np.zeros_like(predicted), [(0, 0, 40, 40)]).sum() == 0


def test_undetected_without_blocks_stays(spark):
    parts = spark.createDataFrame([(1, 1, 0, 0, 4, 4), (2, 1, 0, 0, 4, 4)], "id long, part int, x1 int, y1 int, x2 int, y2 int")
    blocks = spark.createDataFrame([(2, 0, 0, 4, 2)], "id long, x1 int, y1 int, x2 int, y2 int")
    assert [r["id"] for r in m.undetected(parts, blocks, "id").collect()] == [1]


def test_a_box_without_cells_stays(spark):
    grid = spark.createDataFrame([(1, 0, 0, 0)], "id long, x int, y int, value int")
    boxes = spark.createDataFrame([(1, 1, 0, 0, 0, 1), (1, 2, 0, 0, 1, 1)], "id long, box_id int, x1 int, y1 int, x2 int, y2 int")
    assert [r["box_id"] for r in m.dense_boxes(boxes, grid, "id").collect()] == [1]
