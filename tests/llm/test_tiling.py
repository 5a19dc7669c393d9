from hypothesis import given, settings
from hypothesis import strategies as st

from leafscan.llm import tiling

from .helpers import docs_of, no_docs, odd_docs, words


def longest_first(item, text, least):
    """Greedy tiling by trying all lengths."""
    used_i, used_t, total = [False] * len(item), [False] * len(text), 0
    for n in range(min(len(item), len(text)), least - 1, -1):
        for i in range(len(item) - n + 1):
            for j in range(len(text) - n + 1):
                if item[i : i + n] == text[j : j + n] and not any(used_i[i : i + n]) and not any(used_t[j : j + n]):
                    used_i[i : i + n] = used_t[j : j + n] = [True] * n
                    total += n
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=20))
def test_tiles_do_not_overlap_and_are_maximal(item, text):
    found = tiling.tiles(item, text, 3)
    assert all(item[i : i + n] == text[j : j + n] and n >= 3 for i, j, n in found)
    for side in (0, 1):
        places = [p for t in found for p in range(t[side], t[side] + t[2])]
        assert len(places) == len(set(places))
    best = longest_first(item, text, 3)
    assert bool(found) == bool(best)
    if found:  # the longest match is always one of the tiles
        longest = max(n for n in range(1, len(item) + 1) if any(item[i : i + n] == text[j : j + n] for i in range(len(item) - n + 1) for j in range(len(text) - n + 1)))
        assert max(n for _, _, n in found) == longest


def bench(spark):
    return spark.createDataFrame([(k, " ".join(words(40, 100 + k))) for k in range(6)] + [(6, "too short"), (7, None), (8, "")], "item_id long, text string")


def planted():
    clean = " ".join(words(200, 1))
    item = [words(40, 100 + k) for k in range(6)]
    turned = item[2][25:] + ["x"] + item[2][10:25] + ["y"] + item[2][:10]
    return [(1, clean), (2, clean + " " + " ".join(item[0])), (3, " ".join(item[1]).upper()), (4, " ".join(turned)), (5, " ".join(item[3][:15])), (6, " ".join(item[4] + item[5])), (7, " ".join(item[0][k] + " z" for k in range(40)))]


def test_planted_passages(spark):
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in tiling.leaks(docs_of(spark, planted()), bench(spark)).collect()}
    assert set(got) == {(2, 0), (3, 1), (4, 2), (6, 4), (6, 5)}
    assert got[4, 2] == (1.0, 3) and got[2, 0] == (1.0, 1)


def test_a_large_test_set_is_joined(spark):
    docs = docs_of(spark, planted())
    one, other = (sorted(map(tuple, tiling.leaks(docs, bench(spark), held_bytes=n).collect())) for n in (1 << 30, 0))
    assert one == other and len(one) == 5


def test_both_paths_agree_on_nulls_and_repeats(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, "some words before " + item), (1, "some words before " + item), (None, item + " and after"), (2, None), (3, "nothing here at all of it"), (1, "zz another text " + item)]
    docs = docs_of(spark, [(i or 0, t) for i, t in rows]).selectExpr("nullif(doc_id, 0) AS doc_id", "text", "lang AS item_id", "source AS row")
    items = spark.createDataFrame([(7, item), (7, item), (None, item.upper()), (8, None), (9, "too short")], "item_id long, text string")
    one, other = (sorted(map(repr, map(tuple, tiling.leaks(docs, items, held_bytes=n).collect()))) for n in (1 << 30, 0))
    assert one == other and len(one) == 12


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(odd_docs(spark), bench(spark)).count() == 0
    assert tiling.leaks(odd_docs(spark), none).count() == 0 and tiling.leaks(no_docs(spark), bench(spark)).count() == 0
    own = spark.createDataFrame([(1, " ".join(words(120, 2)))], "item_id long, text string")
    assert sorted((r["doc_id"] for r in tiling.leaks(odd_docs(spark), own).collect()), key=str) == [11, 11, None]
