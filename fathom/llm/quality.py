"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network from
its characters and words; gated attention weighs the passages, and the weighted
sum is scored. Labels belong to documents, so which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import blocks
from fathom.llm.base import bounded_batches, written

#: Words of a passage; labelled documents that train the model, and steps of the training.
PASSAGE, SAMPLE, STEPS = 64, 6000, 1500
THRESHOLD = 0.3
_HIDDEN, _GATE, _BATCH = 32, 16, 64
#: Character classes: the printable ASCII ones, white space, control characters, the rest.
_CLASS = np.full(256, 96)
_CLASS[33:127] = np.arange(94)
_CLASS[:33], _CLASS[127] = 95, 95
_CLASS[[32, 9, 10, 11, 12, 13]] = 94
_CLASSES = 97
FEATURES = _CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, the first passage of each text); an empty text has one."""
    start, end, text = blocks.words(data, offsets, blocks.SOLID)
    n = len(offsets) - 1
    words = np.bincount(text, minlength=n)
    parts = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(parts) - parts
    total = int(parts.sum())
    of = first[text] + (np.arange(len(text)) - (np.cumsum(words) - words)[text]) // PASSAGE
    begin = np.zeros(total, np.int64)
    if len(of):
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        begin[of[lead]] = start[lead]
    begin[first] = offsets[:-1]
    length = np.diff(np.append(begin, len(data)))
    where = np.repeat(np.arange(total), length)
    chars = np.bincount(where * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES)
    count = np.bincount(of, minlength=total)
    size = (end - start).astype(float)
    some = np.maximum(count, 1)
    mean = np.bincount(of, size, total) / some
    spread = np.sqrt(np.maximum(np.bincount(of, size * size, total) / some - mean**2, 0))
    hashes = blocks.span_hashes(data, start, end)
    _, at = np.unique(blocks.mix(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    distinct = np.bincount(of[at], minlength=total) / some
    again = np.zeros(len(of))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    extra = [np.log1p(count) / 5, mean / 10, spread / 10, distinct, np.bincount(of, again, total) / some, (count == 0).astype(float)]
    shares = np.sqrt(chars / np.maximum(length, 1)[:, None])
    return np.concatenate([shares, np.stack(extra, axis=1)], axis=1).astype(np.float32), first


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    shape = {"mean": (FEATURES,), "scale": (FEATURES,), "w": (FEATURES, _HIDDEN), "b": (_HIDDEN,), "v": (_HIDDEN, _GATE), "u": (_HIDDEN, _GATE), "a": (_GATE,), "c": (_HIDDEN,), "d": (1,)}
    return {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shape.items()}


def _forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    size = np.diff(np.append(first, len(x)))
    h = np.tanh((x - m["mean"]) * m["scale"] @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * s) @ m["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    a = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    return size, h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))


def _gradients(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    size, h, t, s, a, z, p = _forward(m, x, first)
    do = (p - y) / len(y)
    dz = np.repeat(do[:, None] * m["c"], size, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
    dg = de[:, None] * m["a"]
    dv, du = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = a[:, None] * dz + dv @ m["v"].T + du @ m["u"].T
    dx = dh * (1 - h * h)
    return {"w": ((x - m["mean"]) * m["scale"]).T @ dx, "b": dx.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (t * s).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, rate: float = 0.005) -> dict[str, np.ndarray]:
    """Adam on the log-loss of the bags' labels, in an order that a fixed seed draws."""
    rng = np.random.default_rng(0)
    m = _start(rng)
    every = np.concatenate(bags).astype(float)
    m["mean"], m["scale"] = every.mean(axis=0), 1 / (every.std(axis=0) + 0.01)
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(bags))
        some, order = order[:_BATCH], order[_BATCH:]
        size = np.array([len(bags[i]) for i in some])
        g = _gradients(m, np.concatenate([bags[i] for i in some]).astype(float), np.cumsum(size) - size, labels[some])
        for k in g:
            one[k] = 0.9 * one[k] + 0.1 * g[k]
            two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
            m[k] = m[k] - rate * (1 - step / (steps + 1)) * (one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8) + 1e-3 * m[k])
    return m


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for _, _, data, offsets in blocks.text_slices(batch.column("text")):
            x, first = passages(data, offsets)
            bags += [x[a:b].tobytes() for a, b in zip(first.tolist(), np.append(first[1:], len(x)).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array(bags, pa.binary())], ["h", "label", "bag"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["label"], r["bag"]))
    if rows:
        m = train([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array(list(m)), pa.array([v.astype(float).tobytes() for v in m.values()], pa.binary())], ["name", "value"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """A model of labels (doc_id, label 0 or 1) from the texts of docs (doc_id, text):
    `sample` labels at most, chosen by hash, and as many texts, in that order. None
    without labelled documents."""
    bounded_batches(docs.sparkSession)
    few = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("label").cast("int").alias("label")).where("k is not null and label in (0, 1)")
    few = few.withColumn("h", F.xxhash64("k")).orderBy("h", "label").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text"))
    bags = text.join(F.broadcast(few), "k").select("h", "label", "text").mapInArrow(_encoded, "h long, label int, bag binary")  # `sample` rows of three numbers
    shape = {k: v.shape for k, v in _start(np.random.default_rng(0)).items()}
    bags = written(bags, "bags").orderBy("h", "label", "bag").limit(sample)  # a label's id may have many texts
    found = bags.repartition(1).mapInArrow(_fitted, "name string, value binary").collect()  # nine arrays
    return {r["name"]: np.frombuffer(r["value"], float).reshape(shape[r["name"]]) for r in found} or None


def _scored(m: dict[str, np.ndarray] | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [np.zeros(0)]
            for _, _, data, offsets in blocks.text_slices(batch.column("text")):
                x, first = passages(data, offsets)
                score.append(_forward(m, x.astype(float), first)[-1] if m else np.full(len(first), 0.5))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(np.concatenate(score))], [*keep, "score"])

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text and any other columns) with score, 0 to 1, and predicted, 1
    from `threshold` on. Only texts are scored: null as empty, repeated rows alike, and
    without a model all as 0.5. Columns named score and predicted are replaced; text
    is left out on request."""
    bounded_batches(docs.sparkSession)
    rows = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    fields = [f for f in rows.schema.fields if with_text or f.name != "text"]
    kind = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_scored(model, [f.name for f in fields]), kind)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
