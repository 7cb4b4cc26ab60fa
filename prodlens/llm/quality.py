"""Quality by co-training: a text view and a metadata view teach each other.

Each view's classifier labels, in every round, the pool documents it is surest of, and the other view learns
them with its own. The last classifiers are calibrated on labelled documents that neither has learned, and the
calibrated log-odds of both views add up, less the prior that both contain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .scratch import sliced

#: Labelled documents and unlabelled pool documents that the classifiers are fitted on, about.
LABELLED, POOL = 3000, 3000
ROUNDS, TAUGHT = 5, 150
#: Of the labelled documents, every so many are for calibration only.
FOLD = 4
DIM = 512
SOURCES = 64

#: All bytes for the text view: digits, marks and case matter to quality.
BYTES = np.arange(256, dtype=np.uint8)
STYLE = 8


def text_view(texts: pa.Array) -> np.ndarray:
    """Scaled n-gram counts, and shares of capitals, digits, marks, spaces, line ends, letters and repeated words."""
    x = ngrams.scaled(ngrams.counts(texts, BYTES, DIM))
    style = np.zeros((len(texts), STYLE), np.float32)
    for i, t in enumerate(texts.to_pylist()):
        if t:
            b = np.frombuffer(t.encode(), np.uint8)
            h, n = np.bincount(b, minlength=256), len(b)
            w = t.split()
            style[i] = h[65:91].sum() / n, h[48:58].sum() / n, (h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / n, h[32] / n, h[10] / n, (h[65:91].sum() + h[97:123].sum() + h[128:].sum()) / n, 1 - len(set(w)) / max(1, len(w)), min(1.0, np.log1p(n) / 16)
    return np.concatenate([x, 3 * style], 1)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One of SOURCES hashed places for the source, one of 16 for the language, and the length on a log scale in steps."""
    out = np.zeros((len(source), SOURCES + 16 + 20), np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32((s or "").encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32((g or "").encode()) % 16] = 1
        out[i, SOURCES + 16 + min(19, int(np.log2(max(0, n or 0) + 1)))] = 1
    return out


@dataclass
class View:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * ngrams.applied(x, self.weights) + self.shift


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return ngrams.sigmoid(a), ngrams.sigmoid(b), ngrams.sigmoid(a + b - self.prior)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model | None:
    """The model of labelled rows and a pool; None if only one class is there."""
    fold = np.arange(len(y)) % FOLD == FOLD - 1
    learn, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    if len(set(y[learn].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    views, pools = (text, meta), (pool_text, pool_meta)
    xs, ys = [v[learn] for v in views], [y[learn].astype(float) for _ in views]
    left = np.ones(len(pool_text), bool)
    rate = y[learn].mean()

    def fitted(i: int) -> View:
        weight = np.where(ys[i] == 1, 0.5 / max(ys[i].mean(), 1e-9), 0.5 / max(1 - ys[i].mean(), 1e-9))
        return View(ngrams.ridge(xs[i], (2 * ys[i] - 1)[:, None], weight, 1.0)[:, 0])

    for _ in range(ROUNDS):
        given: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in (0, 1):
            free = np.flatnonzero(left)
            s = fitted(i).log_odds(pools[i][free])
            good, bad = max(1, int(TAUGHT * rate)), max(1, int(TAUGHT * (1 - rate)))
            order = np.argsort(s, kind="stable")
            low, high = order[:bad][s[order[:bad]] < 0], order[::-1][:good][s[order[::-1][:good]] > 0]
            picked = np.concatenate([free[high], free[low]])
            left[picked] = False
            given.append((1 - i, picked, np.concatenate([np.ones(len(high)), np.zeros(len(low))])))
        for to, picked, labels in given:
            xs[to] = np.concatenate([xs[to], pools[to][picked]])
            ys[to] = np.concatenate([ys[to], labels])
    out = []
    for i in (0, 1):
        v = fitted(i)
        w = ngrams.logistic(v.log_odds(views[i][held])[:, None], y[held].astype(float), strength=0.05)
        v.slope, v.shift = float(max(w[0], 0.0)), float(w[1])
        out.append(v)
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    return Model(out[0], out[1], float(np.log(p / (1 - p))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    """Co-train on about LABELLED labelled and POOL other documents, chosen by a hash of the id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n")).filter("k is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    at = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 20))
    n_known, n_rows = known.count(), rows.count()
    if not n_known or not n_rows:
        return None
    some = F.broadcast(known.filter(at < (1 << 20) * min(1.0, LABELLED / n_known)))  # about LABELLED rows, whatever the table's size
    chosen = rows.join(some, "k").unionByName(rows.filter(at >= (1 << 20) - (1 << 20) * min(0.5, POOL / n_rows)).join(some.select("k"), "k", "left_anti").withColumn("y", F.lit(None).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            t, m = text_view(b.column(1)), meta_view(*(b.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["k", "y", "t", "m"])

    got = chosen.select("k", "text", "source", "lang", "n", "y").mapInArrow(run, "k long, y int, t binary, m binary").toArrow().sort_by("k")
    matrix = lambda c, p: np.frombuffer(b"".join(p[c].to_pylist()), np.float32).reshape(len(p), -1)
    own, pool = got.filter(pc.is_valid(got["y"])), got.filter(pc.is_null(got["y"]))
    if len(own) < 2 * FOLD:
        return None
    width = matrix("t", own).shape[1], matrix("m", own).shape[1]
    pools = [matrix(c, pool) if len(pool) else np.zeros((0, w), np.float32) for c, w in zip("tm", width, strict=True)]
    return co_train(matrix("t", own), matrix("m", own), own["y"].to_numpy(), *pools)


def scored(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, quality (0 to 1) and keep (quality >= threshold) of every row; without a model 0.5 and kept.

    A null or empty text, source, language or length is a value like any other. Repeated rows get equal scores.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            if model is None:
                parts = [np.full(b.num_rows, 0.5)] * 3
            else:
                parts = model.scores(text_view(b.column(1)), meta_view(*(b.column(i).to_pylist() for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(p, np.float64)) for p in parts), pa.array(np.asarray(parts[2]) >= threshold)], names=["doc_id", "p_text", "p_meta", "quality", "keep"])

    return docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n")).mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, quality double, keep boolean")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(docs, fit(docs, labels), threshold)
