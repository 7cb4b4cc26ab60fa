"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

A shard's graph is flat arrays: for each layer the numbers of its nodes and a matrix of neighbour
numbers, -1 where a node has fewer. Largest inner product becomes smallest distance by one more
component, sqrt(M^2 - |x|^2) with M the shard's largest norm, so the graphs work in a metric space.
Equal vectors are one node that lists their ids, as copies would fill each other's neighbour lists.
Shards are searched independently and their results merged; scores are inner products of the original
vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

#: Distinct vectors in a shard, about; a shard is built in one task's memory.
SHARD_ROWS = 8192
#: Neighbours of a node in the upper layers (twice as many in the lowest), and candidates kept while building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 96, 256
#: Points that are added to a graph at once, and queries searched at once.
BATCH = 256
#: Queries sent to all shards together, at most.
QUERY_BLOCK = 32768

GRAPHS = "shard int, ids array<array<long>>, vectors binary, dim int, levels binary, neighbours binary, entry int"


class Graph:
    """Flat neighbour arrays of one shard over points that carry the extra component."""

    def __init__(self, points: np.ndarray, levels: np.ndarray, links: int = LINKS):
        n = len(points)
        self.points, self.levels, self.links = points, levels, links
        self.square = np.einsum("ij,ij->i", points, points)
        self.top = int(levels.max(initial=0))
        self.layers = [np.full((n, links * 2 if k == 0 else links), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(np.argmax(levels)) if n else -1

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 7, width: int = BUILD_WIDTH, links: int = LINKS) -> Graph:
        n = len(points)
        rng = np.random.default_rng(seed)
        levels = np.minimum(-np.log(rng.random(n) + 1e-12) / np.log(links), 12).astype(np.int32)
        order = np.argsort(-levels, kind="stable")  # the upper layers first, so that each point descends through finished ones
        g = cls(np.ascontiguousarray(points[order]), levels[order], links)
        g.far = [np.full(x.shape, np.inf, np.float32) for x in g.layers]
        g.entry = at = 0
        while at < n:
            size = max(1, min(BATCH, at))  # a batch is never larger than the graph it is added to
            g.add(np.arange(at, min(n, at + size)), width)
            at += size
        g.order = order
        return g

    def distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, up to a constant for each query, of queries [b, d] to points [b, m]."""
        return self.square[ids] - 2 * np.einsum("bd,bmd->bm", q, self.points[ids])

    def search_layer(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `width` found for each query, in order, from starts [b, s]: ids (-1 for none) and distances."""
        b, near, rows = len(q), self.layers[layer], np.arange(len(q))[:, None]
        seen = np.zeros((b, len(self.points) + 1), bool)
        ids = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        s = min(width, start.shape[1])
        ids[:, :s] = start[:, :s]
        dist[:, :s] = np.where(ids[:, :s] >= 0, self.distance(q, np.maximum(ids[:, :s], 0)), np.inf)
        seen[rows, ids[:, :s]] = True
        done = ids < 0
        live = np.arange(b)
        while len(live):
            left = np.where(done[live], np.inf, dist[live])
            pick = left.argmin(1)
            go = left[np.arange(len(live)), pick] < np.inf
            live, pick = live[go], pick[go]
            if not len(live):
                break
            done[live, pick] = True
            new = near[ids[live, pick]]
            fresh = (new >= 0) & ~seen[live[:, None], new]
            seen[live[:, None], new] |= new >= 0
            seen[:, -1] = False
            far = np.where(fresh, self.distance(q[live], np.maximum(new, 0)), np.inf)
            all_ids = np.concatenate([ids[live], new], 1)
            all_dist = np.concatenate([dist[live], far], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            keep = np.argpartition(all_dist, width - 1, 1)[:, :width]
            at = np.arange(len(live))[:, None]
            ids[live], dist[live], done[live] = all_ids[at, keep], all_dist[at, keep], all_done[at, keep]
            ids[live] = np.where(np.isinf(dist[live]), -1, ids[live])
        order = np.argsort(dist, 1, kind="stable")
        return ids[rows, order], dist[rows, order]

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Start points [b, 1] in layer `to`, by greedy search through the layers above it."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(self.top, to, -1):
            at = self.search_layer(q, at, layer, 1)[0]
        return at

    def spread(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates in order of distance from a point, the positions of those nearer to it than to any chosen before; then the nearest others."""
        ids = ids[:64]
        p = self.points[ids]
        apart = self.square[ids][:, None] + self.square[ids][None] - 2 * p @ p.T
        own = dist[: len(ids)]
        chosen: list[int] = []
        bound = np.full(len(ids), np.inf, np.float32)  # from each candidate to the nearest one chosen
        for i, d in enumerate(own.tolist()):
            if d < bound[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(bound, apart[i], out=bound)
        taken = set(chosen)
        chosen += [i for i in range(len(ids)) if i not in taken][: most - len(chosen)]
        return np.array(chosen, np.intp)

    def add(self, new: np.ndarray, width: int) -> None:
        """Link a batch of points with those added before and with one another."""
        if new[0] == 0 and len(new) == 1:
            return
        q = self.points[new]
        start = np.zeros((len(new), 1), np.int32)
        for layer in range(self.top, -1, -1):
            ids, dist = self.search_layer(q, start, layer, width if self.levels[new].max() >= layer else 1)
            members = np.flatnonzero(self.levels[new] >= layer)
            back: dict[int, list[tuple[float, int]]] = {}
            inner = self.square[new][None] - 2 * q @ q.T
            np.fill_diagonal(inner, np.inf)
            for i in members.tolist():
                peers = members[np.argsort(inner[i, members])[:16]]
                peers = peers[np.isfinite(inner[i, peers])]
                known = ids[i] >= 0
                c = np.concatenate([ids[i][known], new[peers]])
                d = np.concatenate([dist[i][known], inner[i, peers]]) + self.square[new[i]]
                o = np.argsort(d, kind="stable")
                c, d = c[o], d[o]
                at = self.spread(c, d, self.links)
                picked, apart = c[at], d[at]
                self.layers[layer][new[i]][: len(at)] = picked
                self.far[layer][new[i]][: len(at)] = apart
                for j, x in zip(picked.tolist(), apart.tolist(), strict=True):
                    back.setdefault(j, []).append((x, int(new[i])))
            for node, links in back.items():
                self.link_back(layer, node, links)
            start = ids[:, :1]

    def link_back(self, layer: int, node: int, links: list[tuple[float, int]]) -> None:
        """Let the points of links (distance, number) be neighbours of `node`; without room, those of all that `spread` chooses."""
        row, far = self.layers[layer][node], self.far[layer][node]
        held = set(row[row >= 0].tolist())
        every = sorted([*zip(far.tolist(), row.tolist(), strict=True)][: len(held)] + [x for x in links if x[1] not in held])
        d, ids = np.array([x[0] for x in every], np.float32), np.array([x[1] for x in every], np.int32)
        if len(ids) > len(row):
            at = self.spread(ids, d, len(row))
            d, ids = d[at], ids[at]
        row[: len(ids)], far[: len(ids)] = ids, d

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """The nearest `width` points found for each query, -1 where there are fewer."""
        out = [self.search_layer(part, self.descend(part, 0), 0, width)[0] for part in (q[i : i + BATCH] for i in range(0, len(q), BATCH))]
        return np.concatenate(out) if out else np.zeros((0, width), np.int32)

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in self.layers)

    @classmethod
    def unpack(cls, points: np.ndarray, levels: np.ndarray, packed: bytes, entry: int, links: int = LINKS) -> Graph:
        g, at = cls(points, levels, links), 0
        for k, layer in enumerate(g.layers):
            g.layers[k] = np.frombuffer(packed, np.int32, layer.size, at).reshape(layer.shape)
            at += layer.nbytes
        g.entry = entry
        return g


def extended(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the component that turns largest inner product into smallest distance."""
    v = vectors.astype(np.float64)
    square = np.einsum("ij,ij->i", v, v)
    return np.concatenate([v, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], 1).astype(np.float32)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (k, v double array) that can take part: an id, and a vector that is not null, empty, zero, or partly null or not finite."""
    v = F.col(vec_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return df.filter(ok).select(F.col(id_col).cast("long").alias("k"), v.alias("v"))


def build_index(df: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: its graph in flat arrays. Vectors of each length have shards of their own.

    A node keeps the k + 1 smallest ids of its equal vectors: no search for k, ties to smaller ids and the query's own
    left out, can return another.
    """
    rows = usable(df, id_col, vec_col)
    n = rows.count()
    shards = max(1, round(n / shard_rows))
    keyed = rows.select("k", "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("s"), F.size("v").alias("d"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each vector's ids in this partition the k + 1 smallest, so that no vector's copies meet in one task."""
        kept: dict[tuple, list] = {}
        for b in sliced(batches, 4096):
            cols = [b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()]
            for i, (key, h, s, d) in enumerate(zip(*cols, strict=True)):
                own = kept.setdefault((h, s, d), [None, set()])
                if own[0] is None:
                    own[0] = np.asarray(b.column(1)[i].values)
                own[1].add(key)
                if len(own[1]) > 4 * k + 8:
                    own[1] = set(sorted(own[1])[: k + 1])
            if len(kept) >= 50_000:
                yield packed(kept)
                kept = {}
        if kept:
            yield packed(kept)

    def packed(kept: dict) -> pa.RecordBatch:
        hs, ss, ds = zip(*kept, strict=True)
        vs, ks = [v.tolist() for v, _ in kept.values()], [sorted(x)[: k + 1] for _, x in kept.values()]
        return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ss, pa.int32()), pa.array(ds, pa.int32()), pa.array(vs, pa.list_(pa.float64())), pa.array(ks, pa.list_(pa.int64()))], names=["h", "s", "d", "v", "ks"])

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, shard = int(pdf.d.iloc[0]), int(pdf.s.iloc[0])
        v = np.stack(pdf.v.to_numpy()).astype(np.float64)
        _, first, which = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        ids: list[set] = [set() for _ in first]
        for w, ks in zip(which.ravel().tolist(), pdf.ks, strict=True):
            ids[w].update(ks.tolist() if isinstance(ks, np.ndarray) else ks)
        least_id = np.array([min(x) for x in ids])
        order = np.argsort(least_id, kind="stable")  # the same order, and so the same graph, whatever order rows came in
        v = v[first][order]
        g = Graph.build(extended(v))
        return pd.DataFrame({"shard": [shard], "ids": [[sorted(ids[order[i]])[: k + 1] for i in g.order]], "vectors": [v[g.order].tobytes()], "dim": [dim], "levels": [g.levels.tobytes()], "neighbours": [g.pack()], "entry": [g.entry]})

    fewest = keyed.mapInArrow(least, "h long, s int, d int, v array<double>, ks array<long>")
    return fewest.groupBy("s", "d").applyInPandas(graph, GRAPHS)


def search(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, ties to the smaller vec_id, its own id left out.

    The graphs choose about `width` nodes of each shard; their scores are then computed in double precision. Queries go
    to all shards in blocks of bounded size; a query whose vector cannot take part, or of a length no shard has, has no rows.
    Repeated rows of one query id count once.
    """
    spark = index.sparkSession
    wanted = usable(queries, id_col, vec_col)
    n = wanted.count()
    blocks = n // QUERY_BLOCK + 1
    out = []
    for b in range(blocks):
        got = (wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)).toArrow()
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own: dict[int, dict[int, list]] = {}
        for key, v in zip(got["k"].to_pylist(), got["v"].to_pylist(), strict=True):
            own.setdefault(len(v), {}).setdefault(key, v)
        for dim, rows in own.items():
            by_dim[dim] = np.array(list(rows), np.int64), np.array(list(rows.values()))
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                for row in batch.to_pylist():
                    if row["dim"] not in sent.value:
                        continue
                    keys, q = sent.value[row["dim"]]
                    v = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                    g = Graph.unpack(extended(v), np.frombuffer(row["levels"], np.int32), row["neighbours"], row["entry"])
                    flat = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
                    found = g.search(flat, min(max(width, k + 1), max(1, len(v))))
                    cols: list[list] = [[], [], []]
                    for i, key in enumerate(keys.tolist()):
                        nodes = found[i][found[i] >= 0]
                        scores = v[nodes] @ q[i]
                        if len(nodes) > k + 1:
                            best = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                            nodes, scores = nodes[best], scores[best]
                        near = sorted((-s, x) for s, j in zip(scores.tolist(), nodes.tolist(), strict=True) for x in row["ids"][j] if x != key)
                        for s, x in near[:k]:
                            for col, value in zip(cols, (key, x, -s), strict=True):
                                col.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        out.append(index.mapInArrow(run, "query_id long, vec_id long, score double"))
    union = out[0]
    for o in out[1:]:
        union = union.unionAll(o)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return union.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index all rows of df, and search it for the queries. Empty tables give an empty table."""
    scratch = Scratch(df.sparkSession, "hnsw")
    index = scratch.keep(build_index(df, k, id_col, vec_col))
    return search(index, queries, k, id_col=id_col, vec_col=vec_col)
