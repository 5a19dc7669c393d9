import numpy as np
import pyarrow as pa
import pytest

from leafscan.operators import runs
from leafscan.plans.queries import QUERIES


def test_a_page_may_span_batches():
    table = pa.table({"page_id": [1, 1, 1, 2, 3, 3, 3, 3, 3]})
    for size in range(1, 10):
        got = [sorted(set(t.column("page_id").to_pylist())) for t in runs.whole(iter(table.to_batches(size)), "page_id")]
        assert [k for pages in got for k in pages] == [1, 2, 3]
    assert runs.edges(np.array([1, 1, 2]), np.array([5, 6, 6])) == [0, 1, 2, 3] and runs.edges(np.array([])) == [0]


@pytest.mark.parametrize("name", ["page_layout", "merge_lines", "split_blocks", "nms", "iou_match", "first_fit_match", "eval_page", "eval_total"])
def test_many_pages_in_a_batch(name, spark, sf_dir):
    """No pandas frame for each page."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
