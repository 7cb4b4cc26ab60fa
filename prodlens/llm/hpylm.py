"""Language-model scores from a hierarchical Pitman-Yor model of words.

Each context has a restaurant: every word that comes before another one in training, and the start of a text. All context
restaurants share one parent, the unigram restaurant, whose base spreads half of its mass over the known words and gives half
to the unknown word. A customer is a token; each table of a context restaurant sends one customer to the parent.

Seating is sampled by Gibbs in blocks: the number of tables of a dish in a restaurant is drawn given everything else. Up to 64
customers the draw is exact (generalised Stirling numbers); more are seated one after the other by the restaurant's conditional
probabilities, beyond 256 in stretches of a 64th of those seated. Pairs are dealt to buckets by their words' hashes, so that
all counts of a word lie in its bucket and a sweep needs from elsewhere only the totals of the restaurants in which its words
sit. Contexts are dealt to buckets of their own, which add these totals up and send them to the word buckets between rounds. Pairs of hot
words are dealt by both words, as one such word has too many contexts for one bucket; what the parent holds of them is summed, and their
tables there are drawn, on the driver (at most HOT words).

Within a round the totals stand still, and a predictive probability is linear in the table counts; so the mean of the counts over
the round's samples gives the mean of the probabilities. They sum to one in each context.

The logarithm of a pair that was not seen is the sum of its context's back-off and of its word's parent probability. So scores are
sums: of what a word's bucket says of seen pairs and words, and of what a context's bucket says of contexts of unseen pairs.
Frequent pairs, and counts of frequent words, are looked up where the texts are read. What travels is coded: a word among the CODES
most frequent ones of a sample is two bytes. The sample decides nothing but this code and which words count as hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced
from .words import NOT_SPACE, U64, buffers, mix, pieces, words

#: Pairs with at least one in so many of all training tokens are scored without a shuffle.
FREQUENT = 1 << 18
BUCKET_TOKENS, TOKEN_BYTES = 1_500_000, 6
#: Distinct pairs that a task gathers, and tokens that it scores, before it sends them on.
GATHERED, SEGMENT_TOKENS = 500_000, 1_500_000
#: Tokens, and segments' rows, that a bucket looks up together.
JUDGED_TOKENS, JUDGED_ROWS = 300_000, 256
#: Words that have a short code, bytes of text that they are found in, and words with at least one in HOT of its tokens, which are hot.
CODES, SAMPLE_BYTES, HOT = 65_535, 16 << 20, 2_048
EXACT, ONE_BY_ONE, STRETCH = 64, 256, 64
ROUNDS, BURN_IN, SAMPLES = 2, 2, 4
STRENGTH, UNKNOWN = 1.0, 0.5
END, START = mix(np.array([0x0123456789ABCDEF, 0x76543210FEDCBA98], U64))
NONE = np.zeros(0, U64)


def pack(*values: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane, compressed."""
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
    head = np.array([len(values), *map(len, values)], np.int64).tobytes() + "".join(v.dtype.char for v in values).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(planes, values)))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 9 * n, []
    for size, char in zip(sizes.tolist(), raw[8 + 8 * n : at].decode(), strict=True):
        kind = np.dtype(char)
        x = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T
        out.append(np.ascontiguousarray(x).view(kind).ravel())
        at += size * kind.itemsize
    return out


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key is in the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return i, keys[i] == asked


@dataclass
class Codes:
    """Short codes of frequent words, by rank, and the hot words in order of their hashes."""

    by_rank: np.ndarray = field(default_factory=lambda: NONE)
    hot: np.ndarray = field(default_factory=lambda: NONE)

    def __post_init__(self):
        self.rank = np.argsort(self.by_rank)
        self.sorted = self.by_rank[self.rank]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two bytes for each word, and in order the hashes of those without a code."""
        i, there = found(self.sorted, x)
        out = np.full(len(x), CODES, np.uint16)
        out[there] = self.rank[i[there]]
        return out, x[~there]

    def decoded(self, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(code), U64)
        short = code < CODES
        out[short], out[~short] = self.by_rank[code[short]], rest
        return out

    def bucket(self, w: np.ndarray, pair: np.ndarray, buckets: int) -> np.ndarray:
        return place(np.where(found(self.hot, w)[1], pair, w), buckets)

    def pack_runs(self, w: np.ndarray, ctx: np.ndarray, *values: np.ndarray) -> bytes:
        """Rows in order of their words: each word once with its number of rows, the contexts, and further values."""
        first = starts(w)
        return pack(*self.coded(w[first]), np.diff(np.append(first, len(w))).astype(np.uint32), *self.coded(ctx), *values)

    def unpack_runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Words, each one's number of rows, contexts, further values."""
        code, rest, sizes, ctx_code, ctx_rest, *values = unpack(data)
        return self.decoded(code, rest), sizes.astype(np.int64), self.decoded(ctx_code, ctx_rest), values


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, with the hashes of their tokens (words, then one end for each text) and the texts' numbers in the range."""
    data, at = buffers(texts)
    for lo, hi in pieces(data, at):
        part = at[lo : hi + 1]
        hashed, doc, _, _ = words(data[part[0] : part[-1]], part - part[0], NOT_SPACE)
        where = np.searchsorted(doc, np.arange(hi - lo), "right")
        yield lo, hi, np.insert(hashed, where, END), np.insert(doc, where, np.arange(hi - lo))


def context_of(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each token's context: the hash of the word before it, or START."""
    out = np.empty(len(hashed), U64)
    out[1:] = hashed[:-1]
    out[np.flatnonzero(np.diff(doc, prepend=-1))] = START
    return out


def pair_of(hashed: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(hashed ^ mix(context + U64(0x9E3779B97F4A7C15)))


def place(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> U64(24)) % U64(buckets)).astype(np.int64)


def dealt(bucket: np.ndarray, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by bucket and key, and each bucket's range in it."""
    order = np.argsort(keys)
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut)).tolist()]


# ---- seating


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), for c and t up to most."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(most):
        stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + s[c, :-1]
        s[c + 1, :-1] = np.logaddexp(stay, np.concatenate([[-np.inf], s[c, :-2]]))
    return s[:, :-1]


def drawn_tables(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, where a new table has weight `new` against the customers seated."""
    t = np.ones(len(c), np.int64)
    s, log_new = log_stirling(d), np.log(np.maximum(new, 1e-300))
    for n in range(2, EXACT + 1):
        at = np.flatnonzero(c == n)
        for part in np.array_split(at, len(at) // 200_000 + 1):
            if len(part):
                options = s[n, 1 : n + 1][None] + np.arange(1, n + 1)[None] * log_new[part][:, None]
                t[part] = 1 + (options + rng.gumbel(size=options.shape)).argmax(1)
    many = np.flatnonzero(c > EXACT)
    many = many[np.argsort(-c[many], kind="stable")]  # so that those not yet done are always in front
    total, x, tables, seated = c[many], new[many], np.ones(len(many)), 1
    while (left := int(np.searchsorted(-total, -seated))) > 0:
        stretch = 1 if seated < ONE_BY_ONE else seated // STRETCH
        own = np.minimum(stretch, total[:left] - seated)
        p = np.clip(x[:left] / np.maximum(seated + own / 2 - 0.5 - d * tables[:left] + x[:left], 1e-12), 0, 1)
        tables[:left] += rng.random(left) < p if stretch == 1 else rng.binomial(own, p)
        seated += stretch
    t[many] = np.minimum(tables, total).astype(np.int64)
    return t


@dataclass
class Totals:
    """What restaurants hold altogether: customers and tables of each context (in a bucket, of its own contexts), and of the parent; and hot words' parent probabilities and counts."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    known: float  # distinct words
    discount: float = 0.7
    parent_discount: float = 0.7
    tokens: int = 0
    hot_parent: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def new(self) -> np.ndarray:
        """Each context's weight of a new table."""
        return STRENGTH + self.discount * self.tables

    def back_off(self) -> np.ndarray:
        return self.new() / (STRENGTH + self.customers)

    def base(self) -> float:
        """The parent's weight of one known word's new table."""
        return (STRENGTH + self.parent_discount * self.parent_tables) * (1 - UNKNOWN) / max(self.known, 1.0)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of known words."""
        return (customers - self.parent_discount * tables + self.base()) / (STRENGTH + self.parent_customers)

    def unknown(self) -> float:
        return UNKNOWN * (STRENGTH + self.parent_discount * self.parent_tables) / (STRENGTH + self.parent_customers) if self.known else 1.0

    def pair(self, context: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The probability of words after contexts."""
        return (c - self.discount * t) / (STRENGTH + self.customers[context]) + self.back_off()[context] * parent

    def of(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """These totals with those of a bucket's own contexts."""
        return Totals(customers, tables, self.parent_customers, self.parent_tables, self.known, self.discount, self.parent_discount, self.tokens, self.hot_parent, self.hot_count)


class Bucket:
    """Pairs of one bucket in order of their words: customers and tables; and the words' tables in the parent, but for hot words."""

    def __init__(self, words_: np.ndarray, sizes: np.ndarray, ctx: np.ndarray, c: np.ndarray, t: np.ndarray | None = None, t0: np.ndarray | None = None, hot: np.ndarray = NONE):
        self.words, self.sizes, self.c = words_, sizes, c.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(words_)), sizes)
        self.contexts, self.context = np.unique(ctx, return_inverse=True)
        self.t = np.ones(len(c)) if t is None else t.astype(float)
        self.t0 = np.ones(len(words_)) if t0 is None else t0.astype(float)
        at, self.is_hot = found(hot, words_)
        self.hot_at, self.n_hot = at[self.is_hot], len(hot)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of pairs' values, for each word."""
        return np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0)

    def in_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts))

    def parent(self, totals: Totals) -> np.ndarray:
        """The words' parent probabilities."""
        out = totals.parent(self.sums(self.t), self.t0)
        out[self.is_hot] = totals.hot_parent[self.hot_at]
        return out

    def counts(self, totals: Totals) -> np.ndarray:
        """The words' training counts."""
        out = self.sums(self.c)
        out[self.is_hot] = totals.hot_count[self.hot_at]
        return out

    def sweep(self, totals: Totals, rng: np.random.Generator) -> None:
        parent = self.parent(totals)
        more = np.flatnonzero(self.c > 1)  # one customer has one table
        self.t[more] = drawn_tables(self.c[more], totals.new()[self.context[more]] * parent[self.of[more]], totals.discount, rng)
        m = self.sums(self.t).astype(np.int64)
        more = np.flatnonzero((m > 1) & ~self.is_hot)
        self.t0[:] = 1
        self.t0[more] = drawn_tables(m[more], np.full(len(more), totals.base()), totals.parent_discount, rng)

    def sampled(self, totals: Totals, seed: int, burn_in: int, samples: int) -> None:
        """Table counts become their means over the samples."""
        rng = np.random.default_rng(seed)
        t, t0 = np.zeros(len(self.t)), np.zeros(len(self.t0))
        for i in range(burn_in + samples):
            self.sweep(totals, rng)
            if i >= burn_in:
                t += self.t
                t0 += self.t0
        self.t, self.t0 = t / samples, t0 / samples

    def row(self, bucket: int, codes: Codes) -> pa.Table:
        m, own = self.sums(self.t), ~self.is_hot
        hot = np.zeros((2, self.n_hot))
        hot[0, self.hot_at], hot[1, self.hot_at] = m[self.is_hot], self.sums(self.c)[self.is_hot]
        whole = np.rint(m[own])
        sums = [m[own].sum(), self.t0[own].sum(), own.sum(), (self.c == 1).sum(), (self.c == 2).sum(), (whole == 1).sum(), (whole == 2).sum(), self.c.sum(), *hot.ravel()]
        data = codes.pack_runs(self.words[self.of], self.contexts[self.context], self.c.astype(np.uint32), self.t.astype(np.float32), self.t0.astype(np.float32))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "data": pa.array([data], pa.binary()), "parent": pa.array([sums], pa.list_(pa.float64()))})

    @classmethod
    def read(cls, data: bytes, codes: Codes) -> Bucket:
        w, sizes, ctx, (c, t, t0) = codes.unpack_runs(data)
        return cls(w, sizes, ctx, c, t, t0, codes.hot)


STATE = "bucket int, data binary, parent array<double>"
SENT = "bucket int, home int, data binary"


def totals_of(state: DataFrame, codes: Codes, before: Totals | None = None) -> Totals:
    """The parent's totals (the contexts' are left empty); discounts from how many dishes have one and two customers, or those of `before`."""
    sums = {r.pos: r.s for r in state.select(F.posexplode("parent")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    p = np.array([sums.get(i, 0.0) for i in range(8 + 2 * len(codes.hot))])
    m, count = p[8 : 8 + len(codes.hot)], p[8 + len(codes.hot) :]
    discount = lambda one, two: float(np.clip(one / max(one + 2 * two, 1.0), 0.1, 0.95))
    d, d0 = (discount(p[3], p[4]), discount(p[5], p[6])) if before is None else (before.discount, before.parent_discount)
    there = count > 0
    out = Totals(np.zeros(0), np.zeros(0), float(p[0] + m.sum()), float(p[1] + there.sum()), float(p[2] + there.sum()), d, d0, int(p[7]), np.zeros(len(m)), count)
    draws = [drawn_tables(np.rint(m[there]).astype(np.int64), np.full(there.sum(), out.base()), d0, np.random.default_rng(i)) for i in range(SAMPLES)] if there.any() else [np.zeros(0)]
    t0 = np.mean(draws, axis=0)
    out.parent_tables = float(p[1] + t0.sum())
    out.hot_parent[there] = out.parent(m[there], t0)
    return out


# ---- passes over the texts


def _is_held_out(id_col: str, folds: int, held: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held


def frequent_words(train: DataFrame, size: int) -> Codes:
    """Codes from texts of about SAMPLE_BYTES, chosen by a hash of the text."""
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    some = train.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < share * (1 << 20)).select("t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, _, hashed, _ in tokens(batch.column(0)):
                w, n = np.unique(hashed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    counts = some.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("n"), "w").limit(CODES).toArrow()
    w, n = got["w"].to_numpy().astype(np.int64).view(U64), got["n"].to_numpy()
    return Codes(w, np.sort(w[n * HOT >= size * min(1.0, share) / TOKEN_BYTES]) if len(n) else NONE)


def gathered(train: DataFrame, codes: Codes, buckets: int) -> DataFrame:
    """The state of each bucket with one table for each pair."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, waiting = [NONE, NONE, NONE, np.zeros(0, np.int64)], [], 0

        def settle() -> list[np.ndarray]:
            out = distinct(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))
            fresh.clear()
            return out

        def out() -> Iterator[pa.RecordBatch]:
            pair, w, ctx, c = held
            order, ranges = dealt(codes.bucket(w, pair, buckets), w, buckets)
            w, ctx, c = w[order], ctx[order], c[order].astype(np.uint32)
            for b, s in ranges:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([codes.pack_runs(w[s], ctx[s], c[s])], pa.binary())], names=["bucket", "data"])

        for batch in sliced(batches):
            for _, _, hashed, doc in tokens(batch.column(0)):
                ctx = context_of(hashed, doc)
                fresh.append((pair_of(hashed, ctx), hashed, ctx, np.ones(len(hashed), np.int64)))
                waiting += len(hashed)
                if waiting > GATHERED:
                    waiting, held = 0, settle()
                    if len(held[0]) > GATHERED:
                        yield from out()
                        held = [NONE, NONE, NONE, np.zeros(0, np.int64)]
        if fresh:
            held = settle()
        yield from out()

    def seat(table: pa.Table) -> pa.Table:
        parts = [codes.unpack_runs(x.as_py()) for x in table["data"]]
        w, ctx, c = np.concatenate([np.repeat(p[0], p[1]) for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3][0] for p in parts])
        parts.clear()
        _, w, ctx, c = distinct(pair_of(w, ctx), w, ctx, c.astype(np.int64))
        order = np.argsort(w, kind="stable")
        w = w[order]
        first = starts(w)
        return Bucket(w[first], np.diff(np.append(first, len(w))), ctx[order], c[order], hot=codes.hot).row(table["bucket"][0].as_py(), codes)

    return train.select("t").mapInArrow(gather, "bucket int, data binary").groupBy("bucket").applyInArrow(seat, STATE)


def distinct(pair: np.ndarray, w: np.ndarray, ctx: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs in order, their words and contexts, and the sum of each one's counts."""
    order = np.argsort(pair)
    pair = pair[order]
    first = starts(pair)
    return [pair[first], w[order[first]], ctx[order[first]], np.add.reduceat(c[order], first) if len(first) else c]


def context_totals(state: DataFrame, codes: Codes, buckets: int) -> DataFrame:
    """Customers and tables of contexts: for word bucket `bucket`, those of its contexts that lie in context bucket `home`, in order; and at bucket + buckets a
    context bucket's own contexts: keys, customers, tables."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            home, b = batch.column(0)[0].as_py(), Bucket.read(batch.column(1)[0].as_py(), codes)
            c, t = b.in_context(b.c).astype(np.uint32), b.in_context(b.t).astype(np.float32)
            order, ranges = dealt(place(b.contexts, buckets), b.contexts, buckets)
            data = [pack(*codes.coded(b.contexts[order[s]]), c[order[s]], t[order[s]]) for _, s in ranges]
            if data:
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in ranges], pa.int32()), pa.array([home] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "home", "data"])

    def down(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table["data"]]
        asked = [codes.decoded(p[0], p[1]) for p in parts]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        c, t = (np.bincount(at, np.concatenate([p[k] for p in parts]).astype(float)) for k in (2, 3))
        rows = []
        for a in asked:
            i = np.searchsorted(keys, a)
            rows.append(pack(c[i].astype(np.uint64), t[i].astype(np.float32)))
        j = table["bucket"][0].as_py()
        return pa.table({"bucket": pa.array([*table["home"].to_pylist(), j + buckets], pa.int32()), "home": pa.array([j] * (len(rows) + 1), pa.int32()), "data": pa.array([*rows, pack(*codes.coded(keys), c.astype(np.uint64), t.astype(np.float32))], pa.binary())})

    return state.select("bucket", "data").mapInArrow(up, SENT).groupBy("bucket").applyInArrow(down, SENT)


def _with_contexts(b: Bucket, sent: pa.Table, totals: Totals, buckets: int) -> Totals:
    """totals with those of the bucket's own contexts."""
    order, ranges = dealt(place(b.contexts, buckets), b.contexts, buckets)
    values = dict(zip(sent["home"].to_pylist(), sent["data"].to_pylist(), strict=True))
    c, t = np.zeros(len(order)), np.zeros(len(order))
    for j, s in ranges:
        c[order[s]], t[order[s]] = unpack(values[j])
    return totals.of(c, t)


def resampled(state: DataFrame, totals: Totals, codes: Codes, buckets: int, round_: int) -> DataFrame:
    """The state after more sweeps with renewed totals, table counts averaged over the last ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, b = left["bucket"][0].as_py(), Bucket.read(left["data"][0].as_py(), codes)
        b.sampled(_with_contexts(b, right, totals, buckets), round_ << 32 | bucket, BURN_IN, SAMPLES)
        return b.row(bucket, codes)

    sent = context_totals(state, codes, buckets).filter(F.col("bucket") < buckets)
    return state.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(run, STATE)


MODEL = "bucket int, data binary, pairs binary, counts binary"


def modelled(state: DataFrame, sent: DataFrame, totals: Totals, codes: Codes, buckets: int) -> DataFrame:
    """What scores are looked up in, a row for each bucket: log10 of pairs' probabilities, words' counts and log10 of parent probabilities; apart,
    frequent pairs (hash, log10) and counts of coded words and of theirs (hash, count; those of hot words are in totals)."""
    least = totals.tokens / FREQUENT

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket.read(left["data"][0].as_py(), codes)
        own = _with_contexts(b, right, totals, buckets)
        parent, count = b.parent(own), b.counts(own)
        logp = np.log10(own.pair(b.context, b.c, b.t, parent[b.of])).astype(np.float32)
        often = b.c >= least
        coded = found(codes.sorted, b.words)[1]
        coded[b.of[often]] = True  # tokens of frequent pairs do not come here to be counted
        coded &= ~b.is_hot
        data = codes.pack_runs(b.words[b.of], b.contexts[b.context], logp, count.astype(np.uint64), np.log10(parent).astype(np.float32))
        pairs = pack(pair_of(b.words[b.of[often]], b.contexts[b.context[often]]), logp[often])
        return pa.table({"bucket": left["bucket"], "data": pa.array([data], pa.binary()), "pairs": pa.array([pairs], pa.binary()), "counts": pa.array([pack(b.words[coded], count[coded].astype(np.int64))], pa.binary())})

    return state.groupBy("bucket").cogroup(sent.filter(F.col("bucket") < buckets).groupBy("bucket")).applyInArrow(run, MODEL)


#: Rows on their way to a bucket, or with bucket -1 sums of a segment's texts; a segment's ids come once.
ROW = "bucket int, segment long, ids array<long>, held array<boolean>, n binary, data binary"
ROW_KINDS = {"bucket": pa.int32(), "segment": pa.int64(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n": pa.binary(), "data": pa.binary()}


def _row_table(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [[]] * len(ROW_KINDS)
    return pa.table({k: pa.array(c, t) for c, (k, t) in zip(columns, ROW_KINDS.items(), strict=True)})


def _sums_rows(segments: list[int], row: np.ndarray, doc: np.ndarray, logp: np.ndarray, word_row: np.ndarray, word_doc: np.ndarray, count: np.ndarray) -> list[tuple]:
    """For each segment, sums over the tokens given for each of its texts: of log10 of the probability, and of log10(count + 1) and of known words."""
    width = 1 + max(int(doc.max(initial=0)), int(word_doc.max(initial=0)))
    grid = lambda r, d, v: np.bincount(r * width + d, v, len(segments) * width).reshape(len(segments), width)
    row, word_row, doc, word_doc = (x.astype(np.int64) for x in (row, word_row, doc, word_doc))
    score, base, known = grid(row, doc, logp), grid(word_row, word_doc, np.log10(count + 1.0)), grid(word_row, word_doc, (count > 0).astype(float))
    out = []
    for i, segment in enumerate(segments):
        a, b = np.flatnonzero(score[i]), np.flatnonzero(base[i])  # a text whose sum is zero needs no row; a known word has a positive base
        out.append((-1, segment, None, None, None, pack(np.diff(a, prepend=0).astype(np.uint32), score[i, a].astype(np.float32), np.diff(b, prepend=0).astype(np.uint32), base[i, b], known[i, b].astype(np.uint32))))
    return out


def _lookup(rows: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in rows]
    keys = np.concatenate([NONE, *(p[0] for p in parts)])
    values = np.concatenate([np.zeros(0, kind), *(p[1] for p in parts)])
    order = np.argsort(keys)
    return keys[order], values[order]


def partial_scores(docs: DataFrame, model: DataFrame, contexts: DataFrame, totals: Totals, codes: Codes, buckets: int, scratch: Scratch) -> DataFrame:
    """Rows of sums (ROW, bucket -1) of the texts of each segment."""
    spark = docs.sparkSession
    got = model.select("pairs", "counts").collect()  # at most FREQUENT pairs and CODES + FREQUENT words
    hot = totals.hot_count > 0
    counts = [bytes(r.counts) for r in got] + [pack(codes.hot[hot], totals.hot_count[hot].astype(np.int64))]
    frequent = spark.sparkContext.broadcast((_lookup([bytes(r.pairs) for r in got], np.float32), _lookup(counts, np.int64)))
    unknown = float(np.log10(totals.unknown()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (pairs, pair_logp), (common, common_count) = frequent.value
        segment = TaskContext.get().partitionId() << 32
        parts, ids, held, waiting = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            w, doc, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            pair = pair_of(w, ctx)
            i, usual = found(pairs, pair)
            j, counted = found(common, w)
            n = np.bincount(doc, minlength=len(ids)).astype(np.int32).tobytes()
            zeros = lambda x: np.zeros(len(x), np.int64)
            rows = [(-1, segment, ids, held, n, None), *_sums_rows([segment], zeros(doc[usual]), doc[usual], pair_logp[i[usual]], zeros(doc[counted]), doc[counted], common_count[j[counted]])]
            left = np.flatnonzero(~usual)
            bucket = codes.bucket(w[left], pair[left], buckets)
            pair = usual = i = j = counted = None
            order, ranges = dealt(bucket, w[left], buckets)
            left = left[order]
            yield from _row_table(rows).to_batches()
            for lo in range(0, len(ranges), 64):
                rows = [(b, segment, None, None, None, codes.pack_runs(w[left[s]], ctx[left[s]], doc[left[s]].astype(np.uint32))) for b, s in ranges[lo : lo + 64]]
                yield from _row_table(rows).to_batches()

        for batch in sliced(batches):
            for lo, hi, hashed, doc in tokens(batch.column(1)):
                parts.append((hashed, doc + len(ids), context_of(hashed, doc)))
                ids, held = ids + batch.column(0)[lo:hi].to_pylist(), held + batch.column(2)[lo:hi].to_pylist()
                waiting += len(hashed)
                if waiting > SEGMENT_TOKENS:
                    yield from out()
                    parts, ids, held, waiting, segment = [], [], [], 0, segment + 1
        if ids:
            yield from out()

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        common = frequent.value[1][0]
        if len(right):
            own_words, sizes, own_ctx, (own_logp, own_count, own_parent) = codes.unpack_runs(right["data"][0].as_py())
            key = pair_of(np.repeat(own_words, sizes), own_ctx)
            order = np.argsort(key)
            key, own_logp = key[order], own_logp[order]
        else:
            own_words, key, own_logp, own_count, own_parent = NONE, NONE, np.zeros(0, np.float32), NONE, np.zeros(0, np.float32)
        open_: list[tuple[np.ndarray, ...]] = []  # contexts of unseen pairs, segments and texts
        waiting: list[tuple] = []

        def settle() -> None:
            segments = [r[0] for r in waiting]
            w, size, ctx, doc = (np.concatenate([r[k] for r in waiting]) for k in (1, 2, 3, 4))
            row = np.repeat(np.arange(len(waiting)), [len(r[3]) for r in waiting])
            waiting.clear()
            at, there = found(own_words, w)
            count, parent = np.zeros(len(w)), np.full(len(w), unknown)
            count[there], parent[there] = own_count[at[there]], own_parent[at[there]]
            of = np.repeat(np.arange(len(w)), size)
            i, seen = found(key, pair_of(w[of], ctx))
            logp = parent[of]
            logp[seen] = own_logp[i[seen]]
            rare = ~found(common, w)[1][of]
            out.extend(_sums_rows(segments, row, doc, logp, row[rare], doc[rare], count[of[rare]]))
            open_.append((ctx[~seen], np.array(segments, np.int64)[row[~seen]], doc[~seen]))

        tokens_in = 0
        for bucket, segment, ids, held, n, data in zip(*(left[c] for c in ROW_KINDS), strict=True):
            if bucket.as_py() < 0:
                out.append((-1, segment.as_py(), ids.as_py(), held.as_py(), n.as_py(), data.as_py()))
                continue
            w, size, ctx, (doc,) = codes.unpack_runs(data.as_py())
            waiting.append((segment.as_py(), w, size, ctx, doc))
            tokens_in += len(doc)
            if tokens_in > JUDGED_TOKENS or len(waiting) == JUDGED_ROWS:
                settle()
                tokens_in = 0
        if waiting:
            settle()
        if open_:
            ctx, segment, doc = (np.concatenate(x) for x in zip(*open_, strict=True))
            order, ranges = dealt(place(ctx, buckets), ctx, buckets)
            for b, s in ranges:
                some, number = np.unique(segment[order[s]], return_inverse=True)
                out.append((buckets + b, -1, None, None, None, pack(*codes.coded(ctx[order[s]]), doc[order[s]], number.astype(np.uint32), some)))
        return _row_table(out)

    def judge_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        out, keys, value = [], NONE, np.zeros(0)
        if len(right):
            code, rest, c, t = unpack(right["data"][0].as_py())
            keys, value = codes.decoded(code, rest), np.log10(totals.of(c.astype(float), t.astype(float)).back_off())
        parts = [unpack(x.as_py()) for x in left["data"]]
        if not parts:
            return _row_table(out)
        ctx, doc, segment = (np.concatenate(x) for x in zip(*((codes.decoded(p[0], p[1]), p[2], p[4][p[3]]) for p in parts), strict=True))
        i, there = found(keys, ctx)
        segments, row = np.unique(segment[there], return_inverse=True)
        doc, logp, order = doc[there], value[i[there]], np.argsort(row, kind="stable")
        for lo in range(0, len(segments), JUDGED_ROWS):
            a, b = np.searchsorted(row[order], [lo, lo + JUDGED_ROWS])
            own = order[a:b]
            out += _sums_rows(segments[lo : lo + JUDGED_ROWS].tolist(), row[own] - lo, doc[own], logp[own], row[:0], doc[:0], logp[:0])
        return _row_table(out)

    asked = docs.select("k", "t", "held").mapInArrow(spread, ROW)
    first = scratch.keep(asked.groupBy("bucket").cogroup(model.select("bucket", "data").groupBy("bucket")).applyInArrow(judge, ROW))
    apart = first.filter("bucket >= 0").groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(judge_contexts, ROW)
    return first.filter("bucket < 0").unionAll(apart)


def scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows not held out.

    A null text is empty and has one token, its end. A null id is not held out. Rows that repeat an id each count and are each
    scored. Without training rows all tokens are unknown and have probability 1. Ids are whole numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hpylm")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), _is_held_out(id_col, folds, held).alias("held"))
    train = rows.filter("not held")
    size = train.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = size // (TOKEN_BYTES * BUCKET_TOKENS) + 1
    codes = frequent_words(train, size)
    state = scratch.keep(gathered(train, codes, buckets))
    totals = totals_of(state, codes)
    for i in range(ROUNDS):
        before, state = state, scratch.keep(resampled(state, totals, codes, buckets, i))
        scratch.free(before)
        totals = totals_of(state, codes, totals)
    sent = scratch.keep(context_totals(state, codes, buckets))
    contexts = scratch.keep(sent.filter(F.col("bucket") >= buckets).select("bucket", "data"))
    model = scratch.keep(modelled(state, sent, totals, codes, buckets))
    scratch.free(state, sent)
    parts = scratch.keep(partial_scores(rows, model, contexts, totals, codes, buckets, scratch))
    scratch.free(model, contexts)
    tokens_in, known = totals.tokens, int(totals.known)
    per_token = float(np.log10(tokens_in + known + 1))

    def add(table: pa.Table) -> pa.Table:
        own = next(i for i, n in enumerate(table["n"]) if n.is_valid)
        n = np.frombuffer(table["n"][own].as_py(), np.int32).astype(np.int64)
        out = np.zeros((3, len(n)))
        for data in table["data"]:
            if data.is_valid:
                a, score, b, base, sure = unpack(data.as_py())
                out[0, np.cumsum(a, dtype=np.int64)] += score
                at = np.cumsum(b, dtype=np.int64)
                out[1, at] += base
                out[2, at] += sure
        return pa.table({"k": pa.array(table["ids"][own].as_py(), pa.int64()), "held_out": pa.array(table["held"][own].as_py(), pa.bool_()), "n_tokens": n, "n_known": np.rint(out[2]).astype(np.int64), "base_score": out[1] - n * per_token, "score": out[0]})

    result = parts.groupBy("segment").applyInArrow(add, "k long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select(F.col("k").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens_in).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"))
