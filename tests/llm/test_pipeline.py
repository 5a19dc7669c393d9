import re

import numpy as np

import corpus_pipeline as pipeline
from leafscan.llm import hashtree, mixing, rules, tiling

from .helpers import Groups, docs_of, no_docs, odd_docs
from .test_simhash import fingerprint


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in rules.quality(docs).collect() if r["kept"]}

    prints, groups = {i: fingerprint(texts[i]) for i in kept}, Groups()
    for i in kept:
        for j in kept:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    kept = {i for i in kept if groups.find(i) == i}

    def leaked(text):
        own = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        number = {w: k for k, w in enumerate(dict.fromkeys(own))}
        for b in benchmark:
            item = [number.get(w, -1 - k) for k, w in enumerate(b["text"].encode().lower().split())]
            if len(item) >= 5 and sum(n for _, _, n in tiling.tiles(item, [number[w] for w in own])) >= tiling.COVERAGE * len(item):
                return True
        return False

    kept = {i for i in kept if not leaked(texts[i])}
    left = docs.where(docs["doc_id"].isin(*kept))
    kept = {r["doc_id"] for r in mixing.mix(left).collect() if r["kept"]}
    left = docs.where(docs["doc_id"].isin(*kept))
    want = sorted(map(tuple, hashtree.shard(left, hashtree.even_tree(16), hashtree.even_tree(17)).collect()))
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == want and want


def test_stages_return_documents(spark, sf_dir):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_one_of_each_group_stays(spark, sf_dir):
    rows = pipeline.near_duplicates(spark, odd_docs(spark), sf_dir).collect()
    ids = [r["doc_id"] for r in rows]
    # 2 copies 1; 4, 6 and a row without an id are blank as 3; 11 comes once and stands for a row without an id
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8, 9, 10, 11] and ids.count(None) == 0


def test_rows_without_an_id_are_judged(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id = 7")
    more = spark.createDataFrame([(None, item, "en", "s", 1), (None, "quite another text without an id of its own", "en", "s", 1)], docs.schema)
    left = pipeline.decontamination(spark, docs.unionByName(more), sf_dir).collect()
    assert sorted(r["text"][:13] for r in left if r["doc_id"] is None) == ["quite another"]


def test_mixing_learns_topics_from_every_word_and_text(spark, sf_dir, monkeypatch):
    """Eight kinds of over 4,000 texts, told apart by words beyond the 64 most frequent of a text, are the topics that are raked."""
    rng = np.random.default_rng(9)
    common = [f"the{j}" for j in range(100)]
    rows = [(k, " ".join(rng.choice(common, 70, replace=False).tolist() * 2 + [f"kind{k % 8}x{j}" for j in range(20)])) for k in range(4400)]
    raked, rake = [], mixing.rake
    monkeypatch.setattr(mixing, "rake", lambda cells, targets: raked.append(cells) or rake(cells, targets))
    docs = docs_of(spark, rows)
    assert pipeline.mix(spark, docs, sf_dir).columns == docs.columns
    tokens = {}
    for _, _, topic, n in raked[0]:
        tokens[topic] = tokens.get(topic, 0) + n
    assert sorted(tokens.values()) == [550 * 160] * 8
