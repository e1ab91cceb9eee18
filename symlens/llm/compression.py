"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad text.

A text is cut into chunks, so that the dictionaries and not the text's own
repeats decide, and each chunk is compressed with both. The difference of the
summed sizes over their sum, with the compressed share of the text, goes through
a logistic calibration. Dictionaries and calibration are fitted on a sample of
labelled rows whose size is a parameter; the calibration sees only texts that its
dictionaries were not built from (two folds). Scoring is one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import id_value, rows_of

LEVEL = 3


def fold_of(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Classifier:
    """Two dictionaries and the calibration; small enough for a closure (some 230 kB)."""

    good: bytes
    bad: bytes
    mean: tuple[float, float]
    scale: tuple[float, float]
    weights: tuple[float, float, float]
    chunk: int = 1024

    def scorer(self):
        if not self.good:  # no labels of one class: nothing is known
            return lambda texts: np.full(len(texts), 0.5)
        good, bad = _compressor(self.good), _compressor(self.bad)

        def score(texts: list[bytes]) -> np.ndarray:
            x = (features(texts, good, bad, self.chunk) - self.mean) / self.scale
            return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -60, 60)))

        return score


def _dictionary(texts: list[bytes], size: int, chunk: int) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples: their plain end."""
    pieces = [t[i : i + 2 * chunk] for t in texts for i in range(0, len(t), 2 * chunk)]
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b"\n"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, chunk: int) -> np.ndarray:
    """Normalised size difference and logarithm of the compressed share, a row a text."""
    out = np.empty((len(texts), 2))
    for k, t in enumerate(texts):
        a = b = 0
        for i in range(0, max(1, len(t)), chunk):
            piece = t[i : i + chunk]
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        out[k] = (b - a) / (a + b), np.log((a + b) / 2 / (len(t) + 20))
    return out


def fit(good: list[bytes], bad: list[bytes], dict_bytes: int = 112 << 10, chunk: int = 1024) -> Classifier:
    """A classifier from labelled texts; one that answers 0.5 where a class has fewer than two."""
    if min(len(good), len(bad)) < 2:
        return Classifier(b"", b"", (0, 0), (1, 1), (0, 0, 0), chunk)
    xs, ys = [], []
    for f in (0, 1):
        a, b = (_compressor(_dictionary(t[f::2], dict_bytes, chunk)) for t in (good, bad))
        xs.append(features(good[1 - f :: 2] + bad[1 - f :: 2], a, b, chunk))
        ys += [1.0] * len(good[1 - f :: 2]) + [0.0] * len(bad[1 - f :: 2])
    x, y = np.concatenate(xs), np.array(ys)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(3)
    for _ in range(50):  # Newton's method; the small ridge keeps separable classes finite
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3), a.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Classifier(_dictionary(good, dict_bytes, chunk), _dictionary(bad, dict_bytes, chunk), tuple(mean), tuple(scale), tuple(w), chunk)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1200, sample_bytes: int = 65536) -> Classifier:
    """Fit on at most ``sample_rows`` labelled rows a class, of texts of at most ``sample_bytes`` bytes.

    The rows are those with the least hash of their id; rows whose
    ``crc32(id) % 5`` is 0 are held out. The bound keeps the driver's share at
    2 * sample_rows * sample_bytes, whatever the size of the tables.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
    marks = marks.filter(fold_of("key") != 0).withColumn("h", F.xxhash64("key"))
    # twice as many are drawn, as some of their texts may be missing or too long
    drawn = [marks.filter(F.col("label") == k).orderBy("h", "key").limit(2 * sample_rows) for k in (0, 1)]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("binary").alias("body")).filter(F.length("body").between(1, sample_bytes))
    found = texts.join(picked, "key")
    rows = [r for k in (0, 1) for r in found.filter(F.col("label") == k).orderBy("h", "key", "body").limit(sample_rows).collect()]
    return fit(*[[bytes(r.body) for r in rows if r.label == k] for k in (1, 0)])


def quality_scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    A null text counts as empty and is scored like any other; null ids stay
    null and aren't held out; repeated rows give equal rows; an empty table
    none. Whole texts are read. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], ["key", "score"])

    out = rows_of(docs, id_col, text_col).mapInArrow(run, "key long, score double").withColumn("doc_id", id_value(F.col("key")))
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
