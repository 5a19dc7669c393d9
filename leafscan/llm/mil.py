"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of 64 words.  Every passage is encoded (shares of hashed byte pairs and a
few form measures, projected to a small vector); gated attention, learned from document labels alone,
weights the passages; the weighted sum is the document's representation, which a logistic unit scores:

    h = tanh(x W + b)    a = softmax over passages of w . (tanh(h V) * sigmoid(h U))    p = sigmoid(c . sum a h + c0)

The model is fitted on the driver on at most ``MAX_BAGS`` labelled texts of at most ``MAX_BYTES``
together, those with the least hash of their id; every text is scored, whole, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import bounded_batches

PASSAGE_WORDS = 64
PAIRS = 512
FORMS = 12
MAX_BAGS = 5000
MAX_BYTES = 48 << 20
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[128:] = 128 + (np.arange(128, 256) & 15)
_KIND = np.zeros((5, 256), bool)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>=_{}[]\\^~@", b"!?", b".,;:")):
    _KIND[_k, list(_chars)] = True


def encode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, text of each passage); a text without words is one passage of zeros."""
    w = words.split(raw)
    counts = np.diff(w.first)
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.cumsum(passages) - passages
    n = int(passages.sum())
    owner = np.repeat(np.arange(len(raw)), passages)
    x = np.zeros((n, PAIRS + FORMS), np.float32)
    if len(w.start):
        doc = w.document()
        place = first[doc] + (np.arange(len(doc)) - w.first[doc]) // PASSAGE_WORDS
        size = np.bincount(place, minlength=n).astype(np.float32)
        per = np.maximum(size, 1)
        buffer = np.frombuffer(w.buffer, np.uint8)
        # bytes from a passage's first word to the next passage's first are its own
        opens = np.flatnonzero(np.diff(place, prepend=-1))
        at = np.zeros(len(buffer), np.int64)
        at[w.start[opens]] = np.diff(place[opens], prepend=0)
        at = np.cumsum(at)
        folded = _FOLD[buffer]
        pair = (folded[:-1] * 37 + folded[1:]) & (PAIRS - 1)
        x[:, :PAIRS] = np.bincount(at[:-1] * PAIRS + pair, minlength=n * PAIRS)[: n * PAIRS].reshape(n, PAIRS)
        total = np.maximum(x[:, :PAIRS].sum(1, keepdims=True), 1)
        x[:, :PAIRS] = np.sqrt(x[:, :PAIRS] / total)
        length = (w.end - w.start).astype(np.float32)
        f = x[:, PAIRS:]
        f[:, 0] = np.bincount(place, length, n) / per / 10
        f[:, 1] = np.log1p(size) / 5
        for k in range(5):
            f[:, 2 + k] = np.bincount(at[_KIND[k][buffer]], minlength=n)[:n] / total[:, 0] * 5
        for lag in (1, 2, 3):
            same = np.flatnonzero((w.hash[lag:] == w.hash[:-lag]) & (place[lag:] == place[:-lag]))
            f[:, 6 + lag] = np.bincount(place[same], minlength=n) / per
        order = np.lexsort((w.hash, place))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (place[order][1:] != place[order][:-1])
        f[:, 10] = np.bincount(place[order[new]], minlength=n) / per
        f[:, 11] = np.bincount(at[buffer == 10], minlength=n)[:n] / per
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """first: each bag's first passage; bags are not empty."""
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, o = self.weights, self.forward(x, first)
        h, v, u, a, bag = o["h"], o["v"], o["u"], o["a"], o["bag"]
        dy = (o["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, first)[bag])
        dgate = ds[:, None] * p["w"]
        dv, du = dgate * u * (1 - v**2), dgate * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dt = dh * (1 - h**2)
        return {"W": o["x"].T @ dt, "b": dt.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": o["z"].T @ dy, "c0": dy.sum()}


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.003, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on bags; x: passages of all bags, in order."""
    random = np.random.Generator(np.random.PCG64(seed))
    mean = x.mean(0, dtype=np.float64).astype(np.float32)
    scale = np.sqrt(np.maximum(x.astype(np.float32).var(0, dtype=np.float64), 1e-6)).astype(np.float32)
    d = x.shape[1]
    share = float(np.clip(label.mean(), 0.01, 0.99))
    weights = {
        "W": random.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": random.normal(0, GATE**-0.5, GATE), "c": random.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.array(np.log(share / (1 - share))),
    }
    model = Model(mean, scale, {k: v.astype(np.float32) for k, v in weights.items()})
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    s = {k: np.zeros_like(v) for k, v in model.weights.items()}
    size = np.diff(np.append(first, len(x)))
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(first))
        for begin in range(0, len(order), batch):
            bags = order[begin : begin + batch]
            rows = np.concatenate([np.arange(first[k], first[k] + size[k]) for k in bags])
            g = model.gradient(x[rows].astype(np.float32), np.cumsum(size[bags]) - size[bags], label[bags].astype(np.float32))
            step += 1
            for k, v in model.weights.items():
                grad = g[k] + decay * v
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                model.weights[k] = (v - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_bags: int = MAX_BAGS, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model of ``quality`` from texts of the rows given; None where both classes aren't there.

    Rows of labels with a null doc_id or quality are passed over; of several labels the mean counts, 1 from a half on.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sizes = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.octet_length("text")).alias("size"))
    rows = known.join(sizes, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.coalesce("size", F.lit(0)).alias("size")).orderBy("h", "doc_id").limit(max_bags).collect()
    chosen, total = {}, 0
    for r in rows:
        if total + r["size"] <= max_bytes:
            chosen[r["doc_id"]] = r["label"]
            total += r["size"]
    if len(set(chosen.values())) < 2:
        return None
    ids = spark.createDataFrame([(k,) for k in chosen], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
    found, x, sizes_of = [], [], []
    for r in texts.toLocalIterator():
        features, _ = encode([words.as_bytes(r["text"], False)])
        found.append(chosen[r["doc_id"]])
        x.append(features.astype(np.float16))
        sizes_of.append(len(features))
    sizes_of = np.array(sizes_of)
    return train(np.concatenate(x), np.cumsum(sizes_of) - sizes_of, np.array(found))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row; without a model 0.5.  Null and empty texts are one passage of zeros."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for begin, raw in words.slices(batch.column(1).to_pylist(), size=1 << 20):
                    x, owner = encode(raw)
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    out[begin : begin + len(raw)] = model.forward(x, first)["y"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    bounded_batches(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: learn from rows whose crc32(doc_id) mod 5 is not 0, score every row."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(docs.where(~out), labels.where(~out))
    return scored(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
