"""Counts over the words of a corpus, in Arrow batches: words are coded as numbers once and everything else is done on arrays.

A phrase is never more frequent than a phrase inside it. So for a list of the most frequent ones, pairs are counted only of words
that could be on the list, and triples only of such pairs: what is shuffled is a small part of all n-grams, and the list is exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that a Python worker looks at together.
ROWS = 4096
#: Counts of one level that the driver takes at most.
LIST_ROWS = 200_000


#: As in text.term_words.
WORD = re.compile(r"\b(?:[a-z][a-z0-9\-]*[a-z0-9]|[a-z])\b", re.ASCII)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df on the executors' disks while it is read several times; as it is if the caller holds it already."""
    if df.is_cached:
        yield df
        return
    df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Words:
    """Words of some documents in order, with the document of each."""

    words: pa.Array
    doc: np.ndarray

    @property
    def follows(self) -> np.ndarray:
        """Whether the next word is one of the same document."""
        return self.doc[:-1] == self.doc[1:]


def words_of(texts: pa.Array) -> Words:
    """Words between spaces; null and empty texts have none."""
    lists = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), " ")
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    return Words(flat.filter(some), doc[some.to_numpy(zero_copy_only=False)])


def tokenised(texts: DataFrame, stop_words: list[str]) -> DataFrame:
    """One column, words: those of the texts (one column) that start with an ASCII letter, hyphens inside, without stop words, between spaces."""
    stop = frozenset(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w for w in WORD.findall(t) if w not in stop) if t else "" for t in column.to_pylist()], pa.string())], names=["words"])

    return texts.mapInArrow(run, "words string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.column(0).slice(i, ROWS)


def _counted(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the documents that each is in, and its occurrences."""
    own, code, total = np.unique(keys, return_inverse=True, return_counts=True)
    df = np.bincount(np.unique(doc * max(len(own), 1) + code) % max(len(own), 1), minlength=len(own))
    return own, df.astype(np.int64), total.astype(np.int64)


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _place(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted known ones, -1 for others."""
    if len(known) == 0:
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _pairs(w: Words, code: np.ndarray, n: int) -> np.ndarray:
    """Of each word and the next one, code * n + code; -1 where there is no such pair."""
    fits = w.follows & (code[:-1] >= 0) & (code[1:] >= 0)
    return np.where(fits, code[:-1] * n + code[1:], -1)


def _triples(pair: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Of each pair (its number) and the word after it, pair * n + code; -1 where either this pair or the next one is none."""
    return np.where((pair[:-1] >= 0) & (pair[1:] >= 0), pair[:-1] * n + code[2:], -1)


def _level(texts: DataFrame, key: str, count: Callable[[pa.Array], tuple]) -> DataFrame:
    """(key, df, total) of what count() finds in some documents, summed over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _slices(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in count(column)], names=["key", "df", "total"])

    return texts.mapInArrow(run, f"key {key}, df bigint, total bigint").groupBy("key").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _count_words(column: pa.Array) -> tuple:
    w = words_of(column)
    coded = w.words.dictionary_encode()
    own, df, total = _counted(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), w.doc)
    return coded.dictionary.take(pa.array(own)).cast(pa.string()), df, total


def _count_pairs(column: pa.Array, words: pa.Array) -> tuple:
    w = words_of(column)
    pair = _pairs(w, _codes(w.words, words), len(words))
    return _counted(pair[pair >= 0], w.doc[:-1][pair >= 0])


def _count_triples(column: pa.Array, words: pa.Array, pairs: np.ndarray) -> tuple:
    w = words_of(column)
    code = _codes(w.words, words)
    triple = _triples(_place(_pairs(w, code, len(words)), pairs), code, len(words))
    return _counted(triple[triple >= 0], w.doc[:-2][triple >= 0])


Row = tuple[tuple[str, ...], int, int]


def most_frequent(texts: DataFrame, cap: int, by: str, least: int, qualifies: Callable[[tuple[str, ...], int], bool], most: int = 3) -> list[Row] | None:
    """(words, df, total) of qualifying 1- to `most`-grams, with every one of the `cap` first by `by` (df or total, both at least `least`).

    texts has one column: words between spaces. None where the lists would be too long for the driver, as in corpora of very many
    phrases that are all equally rare; then all n-grams have to be counted.
    """
    place = 1 if by == "df" else 2
    found: list[Row] = []
    bound = least
    words = pairs = None
    for level in range(1, most + 1):
        if level == 1:
            counts = _level(texts, "string", _count_words)
        elif level == 2:
            counts = _level(texts, "bigint", lambda c, words=words: _count_pairs(c, words))
        elif level == 3:
            counts = _level(texts, "bigint", lambda c, words=words, pairs=pairs: _count_triples(c, words, pairs))
        else:
            raise ValueError("n-grams of up to three words")
        rows = [tuple(r) for r in counts.filter(F.col(by) >= bound).orderBy(F.desc(by)).limit(LIST_ROWS).collect()]
        full = len(rows) == LIST_ROWS
        last = rows[-1][place] if full else 0
        if level == 1:
            named = {r[0]: (r[0],) for r in rows}
        else:
            n = len(words)
            inner = (lambda k: (k,)) if level == 2 else (lambda k: divmod(int(pairs[k]), n))
            name = lambda k: tuple(words[int(i)].as_py() for i in (*inner(k // n), k % n))
            named = {r[0]: name(r[0]) for r in rows}
        found += [(named[r[0]], r[1], r[2]) for r in rows if qualifies(named[r[0]], r[1])]
        # what comes below the cap-th found so far is not on the list, nor is anything that holds it
        ordered = sorted((r[place] for r in found), reverse=True)
        bound = max(bound, ordered[cap - 1] if len(ordered) >= cap else least)
        if full and last >= bound:
            return None
        kept = [r[0] for r in rows if r[place] >= bound]
        if level == 1:
            words = pa.array(sorted(kept), pa.large_string())
        else:
            pairs = np.array(sorted(kept), dtype=np.int64)
        if not kept:
            break
    return [r for r in found if r[place] >= bound]


def summed_weights(texts: DataFrame, phrases: list[tuple[str, ...]], idf: list[float]) -> DataFrame:
    """(i, w): of each phrase the sum over all documents of count * idf, divided by the length of the document's vector of these."""
    words = pa.array(sorted({w for p in phrases for w in p}), pa.large_string())
    code = {w: i for i, w in enumerate(words.to_pylist())}
    n, levels = len(code), []
    for length in (1, 2, 3):
        keyed = sorted((sum(code[w] * n ** (length - 1 - j) for j, w in enumerate(p)), i) for i, p in enumerate(phrases) if len(p) == length)
        levels.append((np.array([k for k, _ in keyed], dtype=np.int64), np.array([i for _, i in keyed], dtype=np.int64)))
    scale, size = np.array(idf), len(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for column in _slices(batches):
            w = words_of(column)
            c = _codes(w.words, words)
            two = _pairs(w, c, n)
            hits = []
            for keys, doc, (known, number) in zip((c, two, _triples(two, c, n)), (w.doc, w.doc[:-1], w.doc[:-2]), levels, strict=True):
                at = _place(keys, known)
                hits.append(doc[at >= 0] * size + number[at[at >= 0]])
            own, count = np.unique(np.concatenate(hits), return_counts=True)
            weight = count * scale[own % size]
            norm = np.sqrt(np.bincount(own // size, weight * weight, minlength=len(column)))
            out += np.bincount(own % size, weight / norm[own // size], minlength=size)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["i", "w"])

    return texts.mapInArrow(run, "i bigint, w double").groupBy("i").agg(F.sum("w").alias("w"))


def substring_counts(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """(i, n): of each phrase the occurrences in all texts that do not overlap."""
    lines = any("\n" in p for p in phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(phrases), dtype=np.int64)
        for column in _slices(batches):
            each = [t for t in column.to_pylist() if t]
            for text in each if lines else ["\n".join(each)]:
                out += np.array([text.count(p) if p else 0 for p in phrases], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(phrases))), pa.array(out)], names=["i", "n"])

    return texts.mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"))


def noun_counts(texts: DataFrame, adjectives: list[str], suffixes: list[str]) -> DataFrame:
    """(phrase, doc_freq, total_occurrences): words of four letters or more with a noun's ending, and pairs that start with an adjective or end so.

    A pair of two such endings counts twice.
    """
    first, ends = frozenset(adjectives), tuple(suffixes)

    def count(column: pa.Array) -> tuple:
        w = words_of(column)
        coded = w.words.dictionary_encode()
        own, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = own.to_pylist()
        noun = np.array([x.endswith(ends) for x in names], dtype=bool)
        single = noun & np.array([len(x) >= 4 for x in names], dtype=bool)
        leads = np.array([x in first for x in names], dtype=bool)
        k1, df1, n1 = _counted(code[single[code]], w.doc[single[code]])
        fits = w.follows & (leads[code[:-1]] | noun[code[1:]])
        k2, df2, n2 = _counted(code[:-1][fits] * max(len(own), 1) + code[1:][fits], w.doc[:-1][fits])
        a, b = np.divmod(k2, max(len(own), 1))
        both = pc.binary_join_element_wise(own.take(pa.array(a)), own.take(pa.array(b)), pa.scalar(" ", pa.large_string()))
        phrase = pa.concat_arrays([own.take(pa.array(k1)), both]).cast(pa.string())
        return phrase, np.concatenate([df1, df2]), np.concatenate([n1, n2 * (1 + (noun[a] & noun[b]))])

    return _level(texts, "string", count).select(F.col("key").alias("phrase"), F.col("df").alias("doc_freq"), F.col("total").alias("total_occurrences"))
