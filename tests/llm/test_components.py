import random

from leafscan.llm.components import components

from .helpers import Groups


def test_equals_union_find(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(600, 700)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(3, 3), (None, 4), (7, None)]
    groups = Groups()
    for a, b in links:
        if a is not None and b is not None and a != b:
            groups.join(a, b)
    for held in (1 << 20, 0):
        got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), held_links=held).collect()}
        assert got == {(x, groups.find(x)) for x in list(groups.up)}


def test_no_links(spark):
    for held in (1 << 20, -1):
        assert components(spark.createDataFrame([], "a long, b long"), held_links=held).count() == 0
