"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are the n-grams of one to three characters of the lower-cased text, with
ASCII digits, punctuation, white space and control characters as spaces, hashed to
a fixed number of columns. Document frequencies are counted over all learnable documents; the
regression is trained on a bounded sample with the follow-the-regularised-leader
algorithm and an elastic-net penalty, then calibrated by a temperature that is
fitted on a part of the sample which the training doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import blocks
from fathom.llm.base import bounded_batches

COLUMNS = 1 << 14
#: Training documents of all languages together, and passes over them.
SAMPLE, EPOCHS = 6000, 3
UNKNOWN = "und"
#: Bytes and texts of a slice, whose counts are held as one dense array.
_CHUNK, _ROWS = 1 << 18, 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[*range(97), *range(123, 128)]] = 32


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    n, raw = len(offsets) - 1, data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    plain = chars < 128
    chars[plain] = _FOLD[chars[plain]]
    text = np.repeat(np.arange(n), [len(t) for t in texts])
    out = np.zeros(n * COLUMNS, np.int64)
    code = chars = chars.astype(np.uint64)
    for k in range(1, 4):
        if k > 1:
            code = (code[:-1] << np.uint64(21)) | chars[k - 1 :]
        row = text[: len(code)]
        inside = row == text[k - 1 :]
        column = (((code * np.uint64(4) + np.uint64(k)) * _FACTOR) >> np.uint64(50)).astype(np.int64)
        out += np.bincount((row * COLUMNS + column)[inside], minlength=len(out))
    return out.reshape(n, COLUMNS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COLUMNS, np.int64)
    for batch in batches:
        for _, _, data, offsets in blocks.text_slices(batch.column("text"), _CHUNK, _ROWS):
            total += (_features(data, offsets) > 0).sum(axis=0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["feature", "n"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal weights (columns, classes) from (columns, values, class) rows."""
    z, n = np.zeros((COLUMNS, classes)), np.zeros((COLUMNS, classes))

    def weights(at) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0, w)

    for _ in range(epochs):
        for at, x, label in texts:
            w = weights(at)
            p = _softmax((x[:, None] * w).sum(axis=0))
            p[label] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, on a grid."""
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _trained(idf: np.ndarray, classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["text"]))
        data = []
        for r in rows:
            raw = np.frombuffer(r["text"].encode(), np.uint8)
            x = _weighted(_features(raw, np.array([0, len(raw)])), idf)[0]
            at = np.flatnonzero(x)
            data.append((at, x[at].astype(float), classes.index(r["lang"])))
        kept = [d for k, d in enumerate(data) if k % 5] or data
        apart = data[::5]
        w = train(kept, len(classes))
        logits = np.array([(x[:, None] * w[at]).sum(axis=0) for at, x, _ in apart])
        t = temperature(logits, np.array([c for *_, c in apart])) if apart else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([t])], ["weights", "temperature"])

    return run


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any alphabet."""
    ascii_ = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.append(0, np.cumsum(ascii_))
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~found).tolist():
        found[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _predicted(w: np.ndarray, idf: np.ndarray, t: float, classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, _, data, offsets in blocks.text_slices(batch.column("text"), _CHUNK, _ROWS):
                p = _softmax(_weighted(_features(data, offsets), idf) @ w / t)
                some = _letters(data, offsets)
                best += [classes[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1).tolist(), some.tolist(), strict=True)]
                score += np.where(some, p.max(axis=1), 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for each row of docs (doc_id,
    text, lang).

    Learns from text and lang of the rows that are not held out and have both; at most
    `sample` distinct texts, an equal number of each language at most and drawn by
    hash, train the regression. A
    text without a letter, null or empty, is `und` with score 0, and so is every text
    if there is nothing to learn from. Rows that repeat get equal predictions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(out, F.lit(False)).alias("held_out"))
    known = rows.where("not held_out and lang is not null and text is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    shape = "doc_id long, held_out boolean, lang_pred string, score double"
    if not sizes:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    classes = sorted(sizes)
    idf = np.full(COLUMNS, 1 + np.log1p(sum(sizes.values())), np.float32)
    for r in known.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # COLUMNS rows at most
        idf[r["feature"]] -= np.log1p(r["n"])
    each = max(1, sample // len(classes))
    # about twice as many texts as are asked for get past the filter, however many there are
    share = F.coalesce(*(F.when(F.col("lang") == c, F.lit(int(min(1.0, (2 * each + 1000) / n) * (1 << 62)))) for c, n in sizes.items()))
    few = known.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 62))).where(F.col("h") <= share).dropDuplicates(["lang", "h"])
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each).drop("n")
    model = few.repartition(1).mapInArrow(_trained(idf, classes), "weights binary, temperature double").first()
    w = np.frombuffer(model["weights"], np.float32).reshape(COLUMNS, len(classes))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(w, idf, model["temperature"], classes), shape)
