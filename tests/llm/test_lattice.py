import math
import zlib
from collections import Counter

import numpy as np
import pytest

from leafscan.llm import lattice

from .helpers import no_docs, odd_docs, odd_rows


def every_segmentation(word, weight):
    """Sum of products over all ways to cut the word."""
    if not word:
        return 1.0
    return sum(weight[word[:n]] * every_segmentation(word[n:], weight) for n in range(1, len(word) + 1) if word[:n] in weight)


def pieces():
    held = {b" ": 2.0, b" a": 3.0, b"ab": 1.5, b"b": 0.5, b"abc": 1.0, b"c": 0.4, b" ab": 0.7}
    held |= {bytes([x]): 0.01 for x in range(256) if bytes([x]) not in held}
    total = sum(held.values())
    names = sorted(held)
    return names, np.log([held[p] / total for p in names])


def test_forward_sums_all_segmentations():
    names, weight = pieces()
    table = dict(zip(names, np.exp(weight), strict=True))
    batch = [b"abc", b"ab", b"z", b"aabcbc", "é".encode()]
    want = [math.log(every_segmentation(b" " + w, table)) for w in batch]
    assert lattice.Lattice(names, weight).log_marginals(batch) == pytest.approx(want)


def test_expected_counts_are_the_derivative():
    names, weight = pieces()
    batch = [b"abc", b"abab", b"cab"]
    counts = lattice.Lattice(names, weight).expected(batch)
    k = names.index(b"ab")
    total = lambda w: float(lattice.Lattice(names, w).log_marginals(batch).sum())
    step = np.zeros(len(names))
    step[k] = 1e-5
    assert counts[k] == pytest.approx((total(weight + step) - total(weight - step)) / 2e-5, rel=1e-4)


def test_long_words_do_not_underflow():
    names, weight = pieces()
    assert np.isfinite(lattice.Lattice(names, weight).log_marginals([b"ab" * 5000])).all()


def test_vocabulary_sums_to_one():
    names, weight = lattice.load_pieces()
    assert np.exp(weight).sum() == pytest.approx(1) and len(names) > 10_000 and len({*names} & {bytes([x]) for x in range(256)}) == 256


def base(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not out(i):
            counts.update(split(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    score = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    got = []
    for i, t in rows:
        each = split(t)
        got.append((str(i), out(i), len(each) + 1, sum(counts[w] > 0 for w in each) + (ends > 0), n, round(sum(score(counts[w]) for w in each) + score(ends), 6)))
    return sorted(got)


def scored(df):
    rows = df.collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_base_equals_a_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert scored(lattice.documents_scored(docs)) == base([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    assert scored(lattice.documents_scored(odd_docs(spark))) == base([(i, t) for i, t, *_ in odd_rows()])
    assert lattice.documents_scored(no_docs(spark)).count() == 0


def test_words_beyond_the_held_table_score_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    out = []
    for held in (1 << 18, 50, 0):
        model = lattice.fit(docs, ~lattice.held_out(1), held_words=held)
        out.append({r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lattice.score(docs, model).collect()})
    assert out[0] == out[1] == out[2]


def test_score_is_the_mixture(spark):
    docs = spark.createDataFrame([(k, "abc abc ab") for k in range(20)], "doc_id long, text string")
    model = lattice.fit(docs, ~lattice.held_out(1))
    n, v, d = model.tokens, model.distinct, model.discount
    counts = {r["word"].decode(): r["c"] for r in model.counts.collect()}
    marginal = np.exp(lattice.Lattice(model.pieces, model.weight).log_marginals([b"abc", b"ab"]))
    p = [max(counts[w] - d, 0) / n + d * v / n * m for w, m in zip(("abc", "ab"), marginal, strict=True)]
    want = 2 * math.log10(p[0]) + math.log10(p[1]) + math.log10((model.ends - d) / n)
    assert lattice.score(docs, model).first()["score"] == pytest.approx(want)
    assert sum(max(c - d, 0) for c in counts.values()) / n + (model.ends - d) / n + d * v / n == pytest.approx(1)


def test_long_words_are_summed_whole(monkeypatch):
    """Words over LONG, in chunks or not, have the marginal of the plain recursion over every piece."""
    pieces, weight = lattice.load_pieces()
    assert max(map(len, pieces)) > 16
    lat = lattice.Lattice(pieces, weight)
    number = {p: k for k, p in enumerate(pieces)}
    word = ("http://example.org/" + "abstract-и-нтерес-" * 30).encode()
    assert len(word) > lattice.LONG

    def plain(raw):
        alpha = [0.0] + [-np.inf] * len(raw)
        for e in range(1, len(raw) + 1):
            for s in range(max(0, e - lat.longest), e):
                k = number.get(raw[s:e])
                if k is not None:
                    alpha[e] = np.logaddexp(alpha[e], alpha[s] + weight[k])
        return alpha[-1]

    want = plain(b" " + word)
    assert lat.log_marginals([b"ab", word, b"cd"])[1] == pytest.approx(want, rel=1e-9)
    once = lat.expected([word])
    monkeypatch.setattr(lattice, "CHUNK", 100)
    assert lat.log_marginals([word])[0] == pytest.approx(want, rel=1e-9)
    assert np.allclose(lat.expected([word]), once)
    monkeypatch.setattr(lattice, "LONG", 10_000)
    assert lat.log_marginals([word])[0] == pytest.approx(want, rel=1e-9)
    assert np.allclose(lat.expected([word]), once)
