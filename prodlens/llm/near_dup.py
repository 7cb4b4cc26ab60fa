"""Near-duplicate groups by MinHash.

Documents are sets of distinct five-word shingles. Equal sets are one class from the start. Classes that
share a band of universal-hash minima meet in a bucket, and each bucket is compared in two rounds:

1. every member with one pivot of the bucket, the class with most copies (signatures first, then full sets);
2. where the buckets of one pivot together still hold several components, members of different components, block by block:
   first by signatures, then, of members that agree with any such other, by full sets.

Links are confirmed on full sets. A block's pairs never leave it: it gives members or, of the links, those that join
components. A component's inner pairs are not compared; links of a class go through its representative.
With 32 bands of 4 rows, a pair of similarity 0.75 meets in no bucket with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, sliced
from .words import NOT_SPACE, U64, buffers, mix, pieces, words

WIDTH = 5
BANDS, ROWS = 32, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Signature agreement under which a pair is not compared in full: 5 standard deviations under the threshold.
LEAST_AGREEMENT = 0.55
#: Members and shingles of a block, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 400_000
#: Rows of two or three numbers that are broadcast, at most; beyond that Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
PLACES = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's set as sorted 64-bit hashes: of all runs of five words, or of the whole sequence of fewer."""
    data, at = buffers(texts)
    for lo, hi in pieces(data, at):
        part = at[lo : hi + 1]
        hashed, doc, _, _ = words(data[part[0] : part[-1]], part - part[0], NOT_SPACE)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        n = len(hashed)
        runs = np.zeros(max(0, n - WIDTH + 1), U64)
        for j in range(WIDTH):
            runs += hashed[j : n - WIDTH + 1 + j] * PLACES[j] if n >= WIDTH else U64(0)
        runs = mix(runs)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield np.unique(runs[a : b - WIDTH + 1])
            elif b > a:
                yield mix((hashed[a:b] * PLACES[: b - a]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of 128 universal (multiply-shift) hashes of each non-empty set, 32 bits each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat((flat * FACTORS[j] + SHIFTS[j]) >> U64(32), starts)
    return out


def document_signatures(docs: DataFrame) -> DataFrame:
    """k, n (set size), two hashes of the set, signature; of rows (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = list(shingle_sets(b.column(1)))
            n = np.array([len(s) for s in sets], np.int64)
            h = np.zeros((2, len(sets)), U64)
            sig: list[bytes | None] = [None] * len(sets)
            some, at = np.flatnonzero(n), 0
            while at < len(some):
                upto = at + max(1, int(np.searchsorted(np.cumsum(n[some[at:]]), BLOCK_SHINGLES, "right")))
                own = [sets[i] for i in some[at:upto]]
                for i, s, row in zip(some[at:upto].tolist(), own, signatures(own), strict=True):
                    h[0, i], h[1, i], sig[i] = mix(s).sum(), mix(s ^ FACTORS[0]).sum(), row.tobytes()
                at = upto
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(sig, pa.binary())], names=["k", "n", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "k long, n long, h1 long, h2 long, sig binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, c, n, copies): one row for each of a class's bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(U64)
            key = np.arange(BANDS, dtype=U64)[None] * FACTORS[1]
            for r in range(ROWS):
                key = mix(key * FACTORS[2] + sig[:, :, r])
            each = lambda c: pa.array(np.repeat(b.column(c).to_numpy(), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), each(0), each(1), each(2)], names=["band", "c", "n", "copies"])

    return classes.select("c", "n", "copies", "sig").mapInArrow(run, "band long, c long, n long, copies long")


def small(df: DataFrame) -> DataFrame:
    """df, broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (p, c) whose signatures agree in enough places."""
    ids = small(pairs.select(F.col("p").alias("x")).union(pairs.select("c")).distinct())
    sig = classes.join(ids, classes.c == ids.x, "left_semi").select("c", "sig")
    both = pairs.join(sig, "c").withColumnRenamed("sig", "s1").join(sig.select(F.col("c").alias("p"), F.col("sig").alias("s2")), "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            a, z = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (3, 4))
            yield b.select(["p", "c", "n"]).filter(pa.array((a == z).mean(1) >= LEAST_AGREEMENT))

    return both.select("p", "c", "n", "s1", "s2").mapInArrow(run, "p long, c long, n long").distinct()


def linked(inter: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


def star_links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (p, c) that full sets confirm, as edges (a, b). A pivot's members are dealt to blocks of bounded size."""
    sizes = pairs.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = pairs.join(small(sizes), "p").select("p", F.pmod(F.xxhash64("c"), "blocks").alias("block"), "c")
    rows = placed.union(placed.select("p", "block", F.col("p").alias("c")).distinct())
    texts = docs.join(small(rows), docs.k == rows.c).select("p", "block", "c", "t")

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table["c"].to_pylist(), np.int64)
        p = table["p"][0].as_py()
        sets = list(shingle_sets(table["t"]))
        pivots = [sets[i] for i in np.flatnonzero(ids == p)]  # several where rows of one id have different texts
        common = lambda s, pivot: (pivot[np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)] == s).sum()
        ok = [i for i, s in zip(ids.tolist(), sets, strict=True) if i != p and len(s) and any(len(x) and linked(common(s, x), len(s), len(x)) for x in pivots)]
        return pa.table({"a": pa.array([p] * len(ok), pa.int64()), "b": pa.array(ok, pa.int64())})

    return texts.groupBy("p", "block").applyInArrow(run, "a long, b long")


def dealt(members: DataFrame) -> DataFrame:
    """Rows (p, i, j, x, c, comp, n): the members (p, c, comp, n) of groups of several components, in pairs (i, j) of blocks of bounded size.

    Any two members of different components meet, in one block x or from both blocks of a pair. The members of a group's most
    common component lie in blocks of their own, which are not paired with one another; a group that fits is one block.
    """
    counts = members.groupBy("p", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = counts.groupBy("p").agg(F.max(F.struct("m", "comp", "s")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK_MEMBERS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    main_blocks = F.when(blocks(F.col("m"), F.col("s")) > 1, blocks(F.col("main.m"), F.col("main.s"))).otherwise(0)
    sizes = sizes.select("p", F.col("main.comp").alias("main"), main_blocks.alias("mains"), blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("others"))
    apart = (F.col("comp") == F.col("main")) & (F.col("mains") > 0)
    place = lambda n: F.pmod(F.xxhash64("c"), F.greatest(n, F.lit(1))).cast("int")
    own = members.join(small(sizes), "p").withColumn("x", F.when(apart, F.col("others") + place(F.col("mains"))).otherwise(place(F.col("others"))))
    rows = own.select("p", "c", "comp", "n", "x", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(apart, 0).otherwise(F.col("mains")))).alias("y"))
    return rows.select("p", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "c", "comp", "n")


def _strangers(table: pa.Table, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a pair of blocks, each row that is not of the most common component, and which rows it is to be compared with.

    comp may change meanwhile; of two rows of different components one is not of the most common.
    """
    side = np.array(table["x"].to_pylist(), np.int64)
    one_block = table["i"][0].as_py() == table["j"][0].as_py()
    values, counts = np.unique(comp, return_counts=True)
    for m in np.flatnonzero(comp != values[counts.argmax()]).tolist():
        others = comp != comp[m]
        yield m, others if one_block else others & (side != side[m])


def agreeing_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members (p, c, comp, n) whose signature agrees in enough places with one of another component of the group p."""
    rows = dealt(members)
    signed = classes.select("c", "sig").join(small(rows), "c").select("p", "i", "j", "x", "c", "comp", "n", "sig")

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        agrees = np.zeros(len(sig), bool)
        for m, others in _strangers(table, np.array(table["comp"].to_pylist(), np.int64)):
            found = others & ((sig == sig[m]).mean(1) >= LEAST_AGREEMENT)
            agrees |= found
            agrees[m] |= found.any()
        return table.select(["p", "c", "comp", "n"]).filter(pa.array(agrees))

    found = signed.groupBy("p", "i", "j").applyInArrow(run, "p long, c long, comp long, n long")
    return found.distinct()


def joining_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) between members (p, c, comp, n) of a group p, confirmed on full sets: of each pair of blocks those that join components."""
    rows = dealt(members)
    texts = docs.join(small(rows), docs.k == rows.c).select("p", "i", "j", "x", "c", "comp", "t")

    def run(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(table["t"]))
        some = [i for i, s in enumerate(sets) if len(s)]
        a, b = [], []
        if some:
            table, sets = table.take(some), [sets[i] for i in some]
            ids, comp = (np.array(table[c].to_pylist(), np.int64) for c in ("c", "comp"))
            n = np.array([len(s) for s in sets])
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            for m, others in _strangers(table, comp):
                if not others.any():
                    continue
                mark = np.zeros(len(values), np.int32)
                mark[flat[ends[m] - n[m] : ends[m]]] = 1
                found = np.flatnonzero(others & linked(np.add.reduceat(mark[flat], ends - n), n, n[m]))
                joined, first = np.unique(comp[found], return_index=True)
                a += [ids[m]] * len(first)
                b += ids[found[first]].tolist()
                comp[np.isin(comp, joined)] = comp[m]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return texts.groupBy("p", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable through links, itself included), kept (id = component_id).

    Texts that are null or without words have the empty set and link with nothing; a null id has a null component, is
    kept, and links with nothing. Rows that repeat an id each count; where their texts differ, each one's links are the id's. Ids are whole numbers. An empty table gives an
    empty table, and columns other than the two are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    signed = scratch.keep(document_signatures(rows))
    some = signed.filter("n > 0 and k is not null")
    classes = scratch.keep(some.groupBy("h1", "h2", "n").agg(F.min("k").alias("c"), F.count("*").alias("copies"), F.first("sig").alias("sig")))

    bands = band_keys(classes)
    pivots = scratch.keep(bands.groupBy("band").agg(F.min(F.struct((-F.col("copies")).alias("r"), "c")).alias("m"), F.count("*").alias("size")).filter("size > 1").select("band", F.col("m.c").alias("p")))
    met = scratch.keep(bands.select("band", "c", "n").join(pivots, "band"))
    pairs = scratch.keep(met.filter("c <> p").select("p", "c", "n").distinct())
    close = scratch.keep(agreeing(pairs, classes))
    texts = rows.filter("k is not null")
    links = scratch.keep(star_links(close, texts))
    scratch.free(pivots, pairs, close)
    joined = components(links, scratch)

    comp = F.coalesce("v", "c").alias("comp")
    mates = met.groupBy("p", "c").agg(F.max("n").alias("n"))
    members = scratch.keep(mates.join(joined, mates.c == joined.u, "left").select("p", "c", comp, "n"))
    agreed = scratch.keep(agreeing_members(members, classes))
    scratch.free(met, members)
    more = scratch.keep(joining_links(agreed, texts))
    final = components(links.union(more), scratch)
    scratch.free(joined, agreed, links, more)

    of_class = classes.join(final, classes.c == final.u, "left").select("h1", "h2", F.coalesce("v", "c").alias("component"))
    grouped = some.select("k", "n", "h1", "h2").join(of_class, ["h1", "h2"]).select("k", "n", "component")
    alone = signed.filter("n = 0 or k is null").select("k", "n", F.col("k").alias("component"))
    out = scratch.keep(grouped.unionAll(alone))
    scratch.free(signed, classes, final)
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("k").eqNullSafe(F.col("component")).alias("kept"))
