from itertools import combinations

import numpy as np
import pyarrow as pa

from leafscan.llm import fuzzylines as z

from .helpers import Groups, docs_of, no_docs, odd_docs, words


def expected(rows):
    found = [(i, n, line) for i, t in rows for n, line in z.lines_of(t)]
    first = {}
    for i, n, line in found:
        first[line] = min(first.get(line, (i, n)), (i, n))
    groups, sets = Groups(), {line: z.shingles(line) for line in first}
    for a, b in combinations(first, 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and z.similarity(sets[a], sets[b]) >= 0.8:
            groups.join(first[a], first[b])
    return sorted({(i, n, *groups.find(first[line]), (i, n) == groups.find(first[line])) for i, n, line in found})


def got(df):
    return sorted({tuple(r) for r in df.collect()})


def test_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(z.deduplicated(docs_of(spark, rows))) == expected(rows)


def variants(n):
    base = words(60, 9)
    return [(k, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for k in range(n)]


def test_long_lists_in_blocks_and_passed_on(spark, monkeypatch):
    rows = variants(30) + [(100 + k, " ".join(words(40, 50 + k))) for k in range(5)]
    want = expected(rows)
    assert got(z.deduplicated(docs_of(spark, rows))) == want
    assert got(z.deduplicated(docs_of(spark, rows), block=4)) == want
    monkeypatch.setattr(z, "LONGEST", 6)
    assert got(z.deduplicated(docs_of(spark, rows), block=4)) == want


def test_odd_rows(spark):
    out = {(r["doc_id"], r["line_no"]): (r["keeper_doc_id"], r["keeper_line_no"], r["kept"]) for r in z.deduplicated(odd_docs(spark)).collect()}
    assert out[1, 0] == (1, 0, True) and out[2, 0] == (1, 0, False) and out[9, 1] == (9, 0, False)
    assert out[None, 0] == (None, 0, True) and out[11, 0] == (None, 0, False)
    assert not any(k[0] in (3, 4, 6) for k in out)
    assert z.deduplicated(no_docs(spark)).count() == 0


def test_dropped_lines_are_cut_out(spark):
    rows = [(1, "first line here\n\nsecond line here"), (2, "second line here\nthird one, quite new\n")]
    out = {r["doc_id"]: r["text"] for r in z.without_repeats(docs_of(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "third one, quite new\n"}


def test_short_lines_are_one_set():
    assert z.shingles("ab") == {"ab"} and z.bands_of(["ab"]).tolist() == z.bands_of(["ab", "abc"])[:1].tolist()


def lists_of(rows):
    """A table as the comparison reads it: (list, text) by list."""
    name = [z._name(text) for _, text in rows]
    none = np.zeros(len(rows), np.int64)
    return pa.table({"list": pa.array([k for k, _ in rows], pa.int64()), "cell": none - 1, "side": none, "line": pa.array(name, pa.int64()), "text": [t for _, t in rows]})


def linked(batches):
    return {frozenset(p) for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


def test_pairs_that_cannot_be_similar_are_not_compared(monkeypatch):
    alike = [t for _, t in variants(5)]
    rows = [(1, t) for t in alike] + [(2, t) for t in alike] + [(3, " ".join(words(40, k))) for k in range(8)]
    compared, similar = [], z._similar
    monkeypatch.setattr(z, "_similar", lambda h, ends, i, j, limit: compared.append(len(i)) or similar(h, ends, i, j, limit))
    got = linked(z._verified(0.8)(iter(lists_of(rows).to_batches())))
    assert sum(compared) == len(got) == 4  # as many as connect five lines, of 38 pairs


def test_marks_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abc "), rng.integers(1, 400))) for _ in range(60)] + ["ab" * k for k in range(1, 40)]
    lines += [s[:c] + s[c + 1 :] for s in lines for c in rng.integers(0, len(s), 2)]
    sets, (h, ends) = [z.shingles(s) for s in lines], z._places(lines)
    i, j = np.triu_indices(len(lines), 1)
    for limit in (0.5, 0.8, 1.0):
        similar = np.array([z.similarity(sets[a], sets[b]) >= limit for a, b in zip(i, j, strict=True)])
        possible = z._possible(z._marks(h, ends), np.diff(ends), i, j, limit)
        assert not (similar & ~possible).any() and similar.any() and not possible.all()


def test_lists_in_any_batches():
    rng = np.random.default_rng(4)
    band, line = rng.integers(-40, 40, 300), rng.integers(-9, 9, 300)
    order = np.lexsort((line, band))
    table = pa.table({"band": band[order], "line": line[order]})
    want = {tuple(sorted(set(line[band == b].tolist()))) for b in set(band.tolist())}
    for longest in (1 << 20, 3):
        for size in (1, 2, 7, 300):
            found = {}
            for b in z._shared(longest)(iter(table.to_batches(max_chunksize=size))):
                for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found.setdefault(k, set()).add(n)
            assert {tuple(sorted(x)) for x in found.values()} == {x for x in want if len(x) > 1}
            if longest > 3:
                assert all(k >> z.LOW == z.mixed(np.array([min(x)]).view(np.uint64)).view(np.int64)[0] >> z.LOW for k, x in found.items())


def test_long_lists_of_one_least_line_lie_apart():
    line = np.arange(z.SMALL + 1)
    table = pa.table({"band": np.repeat(np.arange(10), len(line) + 1), "line": np.tile(np.append(line, 0), 10) + np.repeat(np.arange(10), len(line) + 1) * np.tile(np.append(line > 5, False), 10)})
    order = np.lexsort((table.column("line").to_numpy(), table.column("band").to_numpy()))
    number = np.concatenate([b.column(0).to_numpy() for b in z._shared(z.LONGEST)(iter(table.take(pa.array(order)).to_batches()))])
    assert len(set(number.tolist())) == len(set((number >> z.LOW).tolist())) == 10
