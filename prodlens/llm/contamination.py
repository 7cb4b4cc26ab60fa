"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: a row is a segment of some thousand documents with, for each term, the
ascending positions of its tokens, counted through the segment. Documents never move for it; no term's
postings meet in one task, however frequent the term. Each segment answers all queries for its own
documents: the posting lists of a phrase are intersected from the rarest term on, each moved back by the
term's offset, so what is left are the starts of exact occurrences.

Queries (benchmark items) are taken in blocks of bounded size; a block's terms are what is sent to the
executors. Segments hold postings of the terms that the block asks for, or of all terms where there are more blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced
from .words import ALNUM, buffers, pieces, word_hashes, words

#: Bytes of benchmark text in a block of queries, about (a longer item stands alone).
BLOCK_BYTES = 16 << 20
#: Bytes of text in a segment of the index, about.
SEGMENT_BYTES = 2 << 20

INDEX = "ids array<long>, n_words array<int>, starts array<int>, terms array<long>, ends array<int>, positions binary"


@dataclass
class Queries:
    """A block of items: the distinct phrases to look for, and which items each belongs to."""

    vocabulary: np.ndarray  # sorted hashes of all terms
    phrases: list[np.ndarray] = field(default_factory=list)  # term numbers of each distinct phrase
    items: list[list[str]] = field(default_factory=list)  # ids of the items that hold it
    by_term: dict[int, list[int]] = field(default_factory=dict)  # phrases of which the term is the one in fewest phrases

    @staticmethod
    def of(ids: list, texts: list[str | None], window: int) -> Queries:
        """Each item's windows of `window` words; an item of fewer words, but not none, is one phrase."""
        data, at = buffers(pa.array(texts, pa.string()))
        hashed, item, _, _ = words(data, at, ALNUM)
        vocabulary, numbers = np.unique(hashed, return_inverse=True)
        found: dict[bytes, int] = {}
        out = Queries(vocabulary)
        for i, name in enumerate(ids):
            own = numbers[np.searchsorted(item, i) : np.searchsorted(item, i, "right")].astype(np.int32)
            if not len(own) or name is None:
                continue
            for k in range(max(1, len(own) - window + 1)):
                p = own[k : k + window]
                n = found.setdefault(p.tobytes(), len(found))
                if n == len(out.phrases):
                    out.phrases.append(p)
                    out.items.append([])
                if not out.items[n] or out.items[n][-1] != str(name):
                    out.items[n].append(str(name))
        uses = np.bincount(np.concatenate([np.unique(p) for p in out.phrases]), minlength=len(vocabulary)) if out.phrases else []
        for n, p in enumerate(out.phrases):
            out.by_term.setdefault(int(p[np.argmin(uses[p])]), []).append(n)
        return out

    def possible(self, segment: Segment) -> Iterator[tuple[np.ndarray, list[str]]]:
        """The phrases, with their items, whose least used term the segment has; all others cannot occur there."""
        for t in segment.lists:
            for n in self.by_term.get(t, ()):
                yield self.phrases[n], self.items[n]


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of the positional index over whole texts: one row for about 2 MB of text, or for one longer text.

    Words are the maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` of the lower-cased text. With a vocabulary
    (sorted term hashes), only its terms have postings; positions count all words either way, with one
    unused position after each document, so that no phrase crosses two documents. A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            data, at = buffers(b.column(1))
            for lo, hi in pieces(data, at, SEGMENT_BYTES):
                part = at[lo : hi + 1]
                hashed, doc = word_hashes(data[part[0] : part[-1]], part - part[0], ALNUM)
                n_words = np.bincount(doc, minlength=hi - lo)
                starts = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]])
                position = np.arange(len(hashed)) + doc
                if vocabulary is None:
                    terms, which = np.unique(hashed, return_inverse=True)
                elif len(vocabulary):
                    terms, which = vocabulary, np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                    known = vocabulary[which] == hashed
                    which, position = which[known], position[known]
                else:
                    terms, which, position = vocabulary, np.zeros(0, np.int64), position[:0]
                order = np.argsort(which, kind="stable")
                counts = np.bincount(which, minlength=len(terms)) if len(terms) else np.zeros(0, np.int64)
                has = np.flatnonzero(counts)
                row = [b.column(0)[lo:hi].to_pylist(), n_words, starts, terms[has].view(np.int64), np.cumsum(counts[has]), position[order].astype(np.uint32).tobytes()]
                kinds = [pa.list_(b.column(0).type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["ids", "n_words", "starts", "terms", "ends", "positions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, INDEX.replace("array<long>", f"array<{kind}>", 1))


class Segment:
    """One row of the index, with the postings of the terms of a block of queries."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        self.ids = row["ids"]
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.starts = np.asarray(row["starts"], np.int64)
        positions, ends = np.frombuffer(row["positions"], np.uint32).astype(np.int64), np.asarray(row["ends"], np.int64)
        terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        self.lists: dict[int, np.ndarray] = {}
        begins = np.concatenate([[0], ends[:-1]])
        at = np.searchsorted(vocabulary, terms)
        for i, n in enumerate(at.tolist()):
            if n < len(vocabulary) and vocabulary[n] == terms[i]:
                self.lists[n] = positions[begins[i] : ends[i]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow one another."""
        lists = []
        for offset, t in enumerate(terms.tolist()):
            if (p := self.lists.get(t)) is None:
                return np.zeros(0, np.int64)
            lists.append((len(p), offset, p))
        lists.sort(key=lambda x: x[:2])
        left = lists[0][2] - lists[0][1]
        for n, offset, p in lists[1:]:
            if not len(left):
                break
            i = np.searchsorted(p, left + offset)
            left = left[(i < n) & (p[np.minimum(i, n - 1)] == left + offset)]
        return left

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest distinct term of `terms` from which all others lie within `span` words in the same document."""
        lists = [self.lists.get(t) for t in dict.fromkeys(terms.tolist())]
        if not lists or any(p is None for p in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=len)
        left = lists[0]
        for p in lists[1:]:
            i = np.searchsorted(p, left)
            doc = self.doc(left)
            ok = np.zeros(len(left), bool)
            for j in (i - 1, i):
                other = p[np.clip(j, 0, len(p) - 1)]
                ok |= (j >= 0) & (j < len(p)) & (np.abs(other - left) <= span) & (self.doc(other) == doc)
            left = left[ok]
        return left

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def matches(index: DataFrame, queries: Queries, near_span: int | None = None) -> DataFrame:
    """Each match of a phrase: the document's id, the item's id, first word (from 0), words in the phrase and kind.

    Kind is `exact`, or with near_span also `near`: all distinct words of the phrase within that many words of its
    rarest word in the segment, in any order; then the first word is that word's position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for row in b.to_pylist():
                s, out = Segment(row, queries.vocabulary), []
                for p, items in queries.possible(s):
                    found = [("exact", x) for x in s.phrase(p).tolist()]
                    if near_span is not None:
                        found += [("near", x) for x in s.near(p, near_span).tolist()]
                    for kind, x in found:
                        d = int(s.doc(np.array([x]))[0])
                        out += [(s.ids[d], i, x - int(s.starts[d]), len(p), kind) for i in items]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [b.schema.field(0).type.value_type, pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "word", "n_words", "kind"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"doc_id {kind}, item_id string, word long, n_words long, kind string")


def _verdicts(index: DataFrame, queries: Queries) -> DataFrame:
    """For each document of the index (with `segment`): its segment and place there, id, n_words, the ranges of hit words and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for row in b.to_pylist():
                s = Segment(row, queries.vocabulary)
                docs, begins, ends = [], [], []
                items: dict[int, set[str]] = {}
                for p, own in queries.possible(s):
                    if len(x := s.phrase(p)):
                        d = s.doc(x)
                        docs.append(d)
                        begins.append(x - s.starts[d])
                        ends.append(x - s.starts[d] + len(p))
                        for i in set(d.tolist()):
                            items.setdefault(i, set()).update(own)
                spans: dict[int, list[dict]] = {}
                if docs:
                    d, lo, hi = (np.concatenate(v) for v in (docs, begins, ends))
                    for i in np.lexsort((lo, d)).tolist():
                        own = spans.setdefault(int(d[i]), [])
                        if own and lo[i] <= own[-1]["hi"]:
                            own[-1]["hi"] = max(own[-1]["hi"], int(hi[i]))
                        else:
                            own.append({"lo": int(lo[i]), "hi": int(hi[i])})
                n = range(len(s.ids))
                cols = [pa.array([row["segment"]] * len(n), pa.int64()), pa.array(n, pa.int32()), pa.array(s.ids, b.schema.field(0).type.value_type), pa.array(s.n_words, pa.int64()), pa.array([spans.get(i, []) for i in n], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array([sorted(items.get(i, ())) for i in n], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["segment", "place", "k", "n_words", "spans", "items"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"segment long, place int, k {kind}, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>")


def _union_length(spans: Column) -> Column:
    """Words in the union of ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["hi"] - F.greatest(p["lo"], a["end"]))).alias("n"), F.greatest(a["end"], p["hi"]).alias("end")))["n"]


def query_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Queries]:
    """The benchmark as blocks of bounded size. Items without a word or an id ask for nothing."""
    sized = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    for k in range(blocks):
        rows = (sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)).collect()
        queries = Queries.of([r.i for r in rows], [r.t for r in rows], window)
        if queries.phrases or blocks == 1:
            yield queries


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted) of every document.

    A document word inside any occurrence of an item's window is hit. Null texts have no words and are clean.
    Items with equal texts each count; rows of one item id count once. Rows that repeat an id, and those with a null id, each
    have their own verdict. Other columns are not read. Without documents or items nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "postings")
    rest = query_blocks(benchmark, window)
    some = list(itertools.islice(rest, 2)) or [Queries.of([], [], window)]
    # Several blocks share one index of all terms; rows are told apart by where they lie in it, written once with it.
    index = build_index(docs, some[0].vocabulary if len(some) == 1 else None, id_col)
    index = scratch.keep(index.withColumn("segment", F.monotonically_increasing_id()))
    out = [_verdicts(index, queries) for queries in itertools.chain(some, rest)]
    if len(out) == 1:
        found = out[0].withColumn("n_hit", _union_length(F.col("spans"))).drop("spans")
    else:
        union = out[0]
        for o in out[1:]:
            union = union.unionAll(o)
        found = union.groupBy("segment", "place").agg(F.first("k").alias("k"), F.max("n_words").alias("n_words"), _union_length(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = scratch.keep(found)
    scratch.free(index)
    return found.select(F.col("k").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
