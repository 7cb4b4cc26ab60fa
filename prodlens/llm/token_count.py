"""Token counts by byte-pair merging with a heap over a linked list of symbols.

For a piece of text the lowest-ranked adjacent pair is popped again and again; each merge takes one
symbol away, so the count is the initial number of bytes less the merges, and no token identifier is
ever made. Ranks come from a public byte-level vocabulary file whose path is a parameter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sliced

#: Fixed value: how byte-level vocabularies split a text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker remembers, at most; then it starts anew.
REMEMBERED = 400_000
#: Longer pieces are counted afresh each time, so that what is remembered stays small.
SHORT = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairMerger(dict):
    """Token counts of pieces; a piece not yet seen is merged when it is asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = {s: i for i, s in enumerate(byte_symbols())}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = rank, ids.setdefault(a + b, len(ids))
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.pieces = regex.compile(PIECE).findall

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def merged(self, symbols: bytes) -> int:
        """Symbols left after all merges, leftmost first among equal ranks."""
        n = len(symbols)
        if n < 2:
            return n
        ids, ranks = list(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if r := ranks.get((made, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], made, ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], made))
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text. A special token's string inside it counts as one token."""
        if self.special is None:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p) + len(parts) - 1


@lru_cache(2)
def merger(path: str) -> PairMerger:
    """One a worker process, kept between its tasks."""
    return PairMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty: no bytes, no tokens. Rows with equal or null ids are counted one by one;
    other columns are not read, whatever their names. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for b in sliced(batches):
            texts = b.column(1).fill_null("")
            tokens = pa.array((m.count(t.as_py()) for t in texts), pa.int64())
            size = pc.binary_length(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, tokens, pc.greater(tokens, limit)], names=["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", id_col)
