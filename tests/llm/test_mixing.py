import numpy as np
import pytest

from leafscan.llm import mixing

from .helpers import docs_of, no_docs, odd_docs, words


def test_raking_meets_all_marginals():
    cells = [(s, lang, t, 10 + 7 * k) for k, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in "xyz" for t in "01")]
    targets = mixing.Targets({"source": {"a": 3, "b": 1}, "lang": {"x": 0.5, "y": 0.3, "z": 0.2}, "topic": {"0": 1, "1": 1}})
    factor, miss = mixing.rake(cells, targets)
    weight = np.array([c[3] for c in cells]) * factor
    share = lambda k, v: weight[[c[k] == v for c in cells]].sum()
    assert miss < 1e-8 and [share(0, "a"), share(1, "y"), share(2, "1")] == pytest.approx([0.75, 0.3, 0.5])


def test_no_target_with_tokens_is_an_error():
    with pytest.raises(ValueError):
        mixing.rake([("a", "x", "0", 5)], mixing.Targets({"source": {"z": 1.0}}))


def test_table_equals_driver(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    targets = mixing.Targets(tolerance=1e-6, rounds=12)
    one = {r["doc_id"]: r for r in mixing.mix(docs, targets).collect()}
    other = {r["doc_id"]: r for r in mixing.mix(docs, targets, held_cells=0).collect()}
    assert one.keys() == other.keys()
    assert all(one[k]["probability"] == pytest.approx(other[k]["probability"], rel=1e-6) and one[k]["n_tokens"] == other[k]["n_tokens"] for k in one)
    assert max(r["probability"] for r in one.values()) == pytest.approx(1.0)


def test_kept_tokens_near_the_targets(spark):
    rows = [(k, " ".join(words(30, k))) for k in range(3000)]
    out = mixing.mix(docs_of(spark, rows), mixing.Targets({"source": {"s0": 2, "s1": 1, "s2": 1}}), topics=1).where("kept")
    tokens = {r["source"]: r["n"] for r in out.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert tokens["s0"] / sum(tokens.values()) == pytest.approx(0.5, abs=0.03)


def test_topics_are_learned_from_the_texts(spark):
    kinds = [[f"{name}{k}" for k in range(30)] for name in ("ship", "tree", "coin")]
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(kinds[k % 3], 40).tolist() + rng.choice([f"the{j}" for j in range(9)], 20).tolist())) for k in range(300)]
    out = {r["doc_id"]: r["topic"] for r in mixing.facts(docs_of(spark, rows), 3).collect()}
    assert sorted(out.values()) == ["0"] * 100 + ["1"] * 100 + ["2"] * 100
    assert all(out[k] == out[k % 3] for k in out)


def test_topics_come_from_every_word_and_text(spark):
    """Kinds differ in words beyond the 64 most frequent of a text; rarities and centres equal a loop over all of 5,000 texts."""
    rng = np.random.default_rng(6)
    kinds = [[f"{name}{k}" for k in range(12)] for name in ("ship", "tree", "coin")]
    common = [f"the{j}" for j in range(400)]
    rows = [(k, " ".join(rng.choice(common, 70, replace=False).tolist() * 2 + rng.choice(kinds[k % 3], 10, replace=False).tolist())) for k in range(5000)]
    docs = docs_of(spark, rows)
    out = {r["doc_id"]: r["topic"] for r in mixing.facts(docs, 3).collect()}
    assert len(set(out.values())) == 3 and sum(out[k] == out[k % 3] for k in out) > 0.99 * len(out)
    turned = docs.orderBy(docs["doc_id"].desc()).repartition(7)
    assert {r["doc_id"]: r["topic"] for r in mixing.facts(turned, 3).collect()} == out
    counted = docs.selectExpr("doc_id", "source", "lang", "text").mapInArrow(mixing._counted, mixing._COUNTED)
    rarity, centre = mixing.learned(counted, 3)
    owner, word, n, _ = mixing._counts([t.encode() for _, t in rows])
    assert rarity == pytest.approx(np.log((1 + len(rows)) / (1 + np.bincount(word, minlength=mixing.FEATURES))))
    x = np.zeros((len(rows), mixing.FEATURES))
    x[owner, word] = np.log1p(n) * rarity[word]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = np.argmax(np.round(x @ centre.T, 9), axis=1)
    assert [str(k) for k in of] == [out[k] for k, _ in rows]
    mean = np.array([x[of == k].sum(0) for k in range(3)])
    assert centre == pytest.approx(mean / np.linalg.norm(mean, axis=1, keepdims=True), abs=1e-3)


def test_rows_equal_a_loop(spark):
    """Every weight, probability and draw by a loop over cells, given the topics."""
    rows = [(k, " ".join(words(5 + k % 40, k))) for k in range(400)]
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang", "source", "concat('t', doc_id % 4) AS subject")
    out = {r["doc_id"]: r for r in mixing.mix(docs, topic="subject").collect()}
    cell = {k: (f"s{k % 3}", "(none)" if k % 7 == 0 else "en", f"t{k % 4}") for k, _ in rows}
    n = {k: len(t.split()) for k, t in rows}
    tokens = {}
    for k, c in cell.items():
        tokens[c] = tokens.get(c, 0) + n[k]
    total, factor = sum(tokens.values()), dict.fromkeys(tokens, 1.0)
    want = []
    for d in range(3):
        sums = {}
        for c, t in tokens.items():
            sums[c[d]] = sums.get(c[d], 0) + t
        raw = {v: (s / total) ** 0.7 for v, s in sums.items()}
        want.append({v: s / sum(raw.values()) for v, s in raw.items()})
    for _ in range(500):
        for d in range(3):
            now = {}
            for c, t in tokens.items():
                now[c[d]] = now.get(c[d], 0) + t * factor[c]
            factor = {c: f * want[d][c[d]] / now[c[d]] for c, f in factor.items()}
    most = max(factor.values())
    for k, r in out.items():
        assert (r["source"], r["lang"], r["topic"], r["n_tokens"]) == (*cell[k], n[k])
        assert r["probability"] == pytest.approx(factor[cell[k]] / most, rel=1e-6) and r["weight"] == pytest.approx(factor[cell[k]] * total, rel=1e-6)
        assert r["miss"] < 1e-9
    assert len(out) == 400 and all(r["kept"] for r in out.values() if r["probability"] == 1.0)


def test_targets_that_cannot_be_met_are_told(spark):
    docs = docs_of(spark, [(1, "a b"), (2, "c d")]).selectExpr("doc_id", "text", "concat('l', doc_id) AS lang", "concat('s', doc_id) AS source")
    targets = mixing.Targets({"lang": {"l1": 0.9, "l2": 0.1}, "source": {"s1": 0.1, "s2": 0.9}})
    with pytest.warns(UserWarning, match="off its targets"):
        assert mixing.mix(docs, targets, topics=1).first()["miss"] > 0.1


def test_odd_rows_and_empty_tables(spark):
    out = mixing.mix(odd_docs(spark)).collect()
    assert len(out) == 14 and all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in out)
    assert {r["source"] for r in out} == {"s0", "s1", "s2", "(none)"} and {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 6)} == {0}
    assert mixing.mix(no_docs(spark)).count() == 0
    blank = docs_of(spark, [(1, ""), (2, None)])
    assert [r["kept"] for r in mixing.mix(blank).collect()] == [False, False]
    named = mixing.mix(odd_docs(spark), topic="fp").collect()
    assert {r["topic"] for r in named} == {"x"}


def test_default_targets_leave_most_documents(spark, sf_dir):
    out = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len({r["topic"] for r in out}) > 2 and max(r["miss"] for r in out) < 1e-6
    assert sum(r["kept"] for r in out) > 0.2 * len(out)
