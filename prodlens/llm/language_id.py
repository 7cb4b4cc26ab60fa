"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit. A text goes to the
language whose codeword costs least under the logistic loss of the bits' margins, so one wrong bit doesn't decide. The
score is the soft minimum's share of that language, and a text is ambiguous if two languages come close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .scratch import sliced

#: Documents of each language that the classifiers are fitted on, about; fewer of each where there are so many languages that
#: they would be more than LARGEST_SAMPLE together, which bounds the one task that fits.
SAMPLE, LARGEST_SAMPLE = 500, 20_000
#: Besides each whole sampled text, a piece of it of this many bytes is learned, so that short texts are known.
PIECE_BYTES = 60
#: Texts whose best two languages' shares are closer are ambiguous.
CLOSE = 0.2
#: Least mean loss over a codeword's bits from which a text can be taken to be in none of the languages. On sf0.1 the largest of
#: 10,000 documents is 0.500; Greek, Chinese and Russian sentences have 0.571 to 0.579 there.
FAR = 0.54


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one a language: all distinct splits of up to 7 languages, else random bits far apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        bits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range((1 << (n - 1)) - 1)]
        return np.array(bits, float).T
    rng, length = np.random.default_rng(11), int(np.ceil(12 * np.log2(n)))
    tries = (rng.choice([-1.0, 1.0], (n, length)) for _ in range(50))
    return max(tries, key=lambda m: -(m @ m.T - 2 * length * np.eye(n)).max())


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # [features + 1, bits]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the language's number, its share, the share's lead over the next, and its codeword's loss."""
        margins = np.clip(4 * ngrams.applied(ngrams.scaled(counts), self.weights), -30, 30)
        plus = self.code.T > 0
        losses = (np.log1p(np.exp(-margins)) @ plus + np.log1p(np.exp(margins)) @ ~plus) / len(plus)
        e = np.exp(6 * (losses.min(1, keepdims=True) - losses))
        share = e / e.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else ranked[:, -1]
        return losses.argmin(1), ranked[:, -1], lead, losses.min(1)


def _held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Classifiers fitted on about SAMPLE documents of each language, chosen by a hash; None without a labelled text.

    One task fits them, so that the driver gets the weights alone. All languages are learned, however many there are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), _held_out(id_col).alias("h")).filter("not h and t is not null and l is not null")
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    most = max(1, min(SAMPLE, LARGEST_SAMPLE // len(counts)))
    share = spark.createDataFrame([(r.l, min(1.0, most / r.n)) for r in counts], "l string, share double")  # a row for each language
    chosen = rows.join(F.broadcast(share), "l").filter(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("l", "t", "k")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [x.encode() for x in b.column(1).to_pylist()]
            start = [len(x) * 7919 % max(1, len(x) - PIECE_BYTES) for x in texts]
            parts = pa.array([x[s : s + PIECE_BYTES].decode(errors="ignore") for x, s in zip(texts, start, strict=True)], pa.string())
            for kind, t in enumerate((b.column(1), parts)):
                x = ngrams.scaled(ngrams.counts(t)).astype(np.float32)
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), b.column(0), pa.array([f"{k}/{kind}" for k in b.column(2).to_pylist()]), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], names=["one", "l", "k", "at", "x"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.filter(pc.greater(pc.binary_length(table["at"]), 0)).sort_by([("l", "ascending"), ("k", "ascending"), ("x", "ascending")])
        names = sorted(set(table["l"].to_pylist()))
        if not names:
            return pa.table({"names": pa.array([], pa.list_(pa.string())), "weights": pa.array([], pa.binary())})
        own = np.searchsorted(names, table["l"].to_pylist())
        weight, code = (len(own) / len(names) / np.bincount(own, minlength=len(names)))[own], codewords(len(names))
        gram, right = np.zeros((ngrams.DIM + 1, ngrams.DIM + 1)), np.zeros((ngrams.DIM + 1, code.shape[1]))
        for lo in range(0, len(own), 1024):
            part = table.slice(lo, 1024)
            x = np.zeros((len(part), ngrams.DIM + 1))
            x[:, -1] = 1
            for r, (at, v) in enumerate(zip(part["at"].to_pylist(), part["x"].to_pylist(), strict=True)):
                x[r, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
            xw = x.T * weight[lo : lo + len(part)]
            gram += xw @ x
            right += xw @ code[own[lo : lo + len(part)]]
        gram[np.diag_indices_from(gram)] += 2.0
        weights = np.linalg.solve(gram, right).astype(np.float32)
        return pa.table({"names": pa.array([names], pa.list_(pa.string())), "weights": pa.array([weights.tobytes()], pa.binary())})

    got = chosen.mapInArrow(features, "one int, l string, k string, at binary, x binary").groupBy("one").applyInArrow(learn, "names array<string>, weights binary").first()
    if got is None:
        return None
    code = codewords(len(got.names))
    return Model(list(got.names), code, np.frombuffer(bytes(got.weights), np.float32).reshape(-1, code.shape[1]))


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", far: float | None = None) -> DataFrame:
    """All columns and rows of docs, then lang_pred, lang_score and lang_ambiguous.

    A text that is null or has no letter is `und` with score 0 and not ambiguous, as is every text without a model and,
    with `far`, one whose loss is more than that with every language.
    Columns of those names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")]
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    where = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(where)
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                letter = np.zeros(len(texts), bool)
                best, score, lead = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts))
                names = ["und"]
            else:
                best, score, lead, loss = model.predict(ngrams.counts(texts))
                letter &= loss <= (np.inf if far is None else far)
                names = model.languages
            pred = pa.array([names[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)], pa.string())
            new = [pred, pa.array(np.where(letter, score, 0.0).astype(np.float64)), pa.array(letter & (lead < CLOSE))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.select(*columns).mapInArrow(run, schema)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score, ambiguous of every row, learned from rows that are not held out and have a language.

    A null id is not held out. Rows are judged by their texts alone, so repeated ones get equal results.
    """
    model = fit(docs, id_col, text_col, lang_col)
    out = identified(docs.select(id_col, text_col), model, id_col, text_col)
    return out.select(id_col, _held_out(id_col).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
