"""Operator 1, approximate nearest neighbours by one HNSW graph per shard.

Vectors are dealt by a hash of their id into shards of a bounded size. Each
shard is one task: equal vectors become one node, nodes are inserted in small
groups by the usual layered beam search, and the graph is one row of flat
neighbour arrays. Queries are packed into blocks, every block meets every
shard once, and the shards' results are merged.

Graphs are built and searched on vectors scaled by a power of two, in single
precision where their sizes are near enough to each other and in double where
not, so that no finite vector overflows or vanishes; scores are computed from
the vectors as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mixed
from .components import ensure_checkpoint_dir

INSERT = 256  # nodes inserted at once


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows in double precision; differences are scaled, so that their squares neither overflow nor vanish."""
    with np.errstate(over="ignore"):
        d = np.abs(x.astype(np.float64) - y.astype(np.float64))
    most = d.max(-1, initial=0.0)
    plain = (most > 1e-140) & (most < 1e140)
    scale = np.where(plain | (most == 0) | ~np.isfinite(most), 1.0, most)
    with np.errstate(over="ignore"):
        return np.sqrt(np.square(d / scale[..., None]).sum(-1)) * scale


def comparable(*arrays: np.ndarray) -> list[np.ndarray]:
    """Vectors by the rows, all divided by one power of two so that no component exceeds 1; single precision if no row is far smaller than the largest."""
    sizes = np.concatenate([np.abs(a).max(1, initial=0.0).astype(np.float64) for a in arrays])
    top = sizes.max(initial=0.0)
    if not top:
        return [a.astype(np.float32) for a in arrays]
    kind = np.float32 if sizes[sizes > 0].min() > top * 2.0**-30 else np.float64
    shift = -int(np.frexp(top)[1])
    return [np.ldexp(a.astype(np.float64), shift).astype(kind) for a in arrays]


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step. entry: (queries, e) distinct nodes. Returns ef nodes (-1: none) and squared distances, nearest first."""
    n_q, e = entry.shape
    seen = np.zeros((n_q, len(x)), bool)
    node = np.full((n_q, ef), -1, np.int64)
    dist = np.full((n_q, ef), np.inf, x.dtype)
    done = np.zeros((n_q, ef), bool)
    e = min(e, ef)
    node[:, :e] = entry[:, :e]
    dist[:, :e] = distances(x[entry[:, :e]], q[:, None])
    np.put_along_axis(seen, entry[:, :e], True, 1)
    active = np.arange(n_q)
    while len(active):
        open_ = np.where(done[active] | (node[active] < 0), np.inf, dist[active])
        at = open_.argmin(1)
        more = np.isfinite(open_[np.arange(len(active)), at])
        active, at = active[more], at[more]
        if not len(active):
            break
        done[active, at] = True
        around = near[node[active, at]]
        row, col = np.nonzero((around >= 0) & ~seen[active[:, None], around])
        found = around[row, col]
        seen[active[row], found] = True
        far = np.full(around.shape, np.inf, x.dtype)
        far[row, col] = distances(x[found], q[active[row]])
        all_d = np.concatenate((dist[active], far), axis=1)
        best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[active] = np.take_along_axis(all_d, best, 1)
        node[active] = np.take_along_axis(np.concatenate((node[active], np.where(np.isfinite(far), around, -1)), axis=1), best, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], np.zeros(around.shape, bool)), axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1)


def diverse(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) up to m that are nearer to the row's node than to those taken; then the nearest of the rest."""
    rows, c = cand.shape
    v = x[cand]
    square = np.einsum("rci,rci->rc", v, v)
    between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    valid = (cand >= 0) & np.isfinite(dist)
    taken = np.zeros((rows, c), bool)
    count = np.zeros(rows, np.int64)
    close = np.full((rows, c), np.inf, x.dtype)
    for j in range(c):
        r = np.flatnonzero(valid[:, j] & (count < m) & (dist[:, j] < close[:, j]))
        taken[r, j] = True
        count[r] += 1
        close[r] = np.minimum(close[r], between[r, j])
    rank = np.where(taken, np.arange(c), np.where(valid, c + np.arange(c), 3 * c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(valid, cand, -1), order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of flat neighbour arrays; nodes are ordered by falling layer, so layer l holds nodes 0 .. sizes[l]-1."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray]):
        self.x, self.near = x, near

    @classmethod
    def build(cls, x: np.ndarray, m: int, ef: int) -> Graph:
        """x: distinct vectors in any order that depends on their ids alone."""
        n = len(x)
        level = np.floor(-np.log((mixed(np.arange(1, n + 1, dtype=U64)) >> U64(11)) * 2.0**-53 + 2.0**-60) / math.log(m)).astype(int)
        level = np.sort(level)[::-1]
        sizes = [int((level >= l).sum()) for l in range(int(level[0]) + 1)] if n else [0]
        graph = cls(x, [np.full((s, 2 * m if l == 0 else m), -1, np.int32) for l, s in enumerate(sizes)])
        low = 1
        while low < n:
            high = min(n, low + min(INSERT, low))
            graph.insert(low, high, m, ef)
            low = high
        return graph

    def insert(self, low: int, high: int, m: int, ef: int) -> None:
        """Links nodes low .. high-1 to those before them, and to each other within the group."""
        x = self.x
        entry = np.zeros((high - low, 1), np.int64)
        for l in range(len(self.near) - 1, -1, -1):
            near = self.near[l]
            here = min(max(len(near) - low, 0), high - low)  # of the group, those on this layer come first
            known = min(low, len(near))
            if not known:
                continue
            if here < high - low:  # the others only pass through
                node, _ = beam(x[:known], near[:known], x[low + here : high], entry[here:], 1)
                entry[here:] = node
            if here:
                group = np.arange(low, low + here)
                node, dist = beam(x[:known], near[:known], x[group], entry[:here], ef)
                entry[:here, 0] = node[:, 0]
                inner = distances(x[group][:, None], x[group][None])
                inner[np.arange(here)[:, None] <= np.arange(here)[None]] = np.inf  # each to those before it
                k = min(m, here)
                best = np.argpartition(inner, k - 1, axis=1)[:, :k]
                node = np.concatenate((node, group[best]), axis=1)
                dist = np.concatenate((dist, np.take_along_axis(inner, best, 1)), axis=1)
                order = np.argsort(dist, axis=1, kind="stable")
                chosen = diverse(x, np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1), m)
                near[group, :m] = chosen
                self.link_back(near, group, chosen)

    def link_back(self, near: np.ndarray, group: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the reverse of each new link; a node with too many keeps a diverse choice."""
        r, c = np.nonzero(chosen >= 0)
        to, come = chosen[r, c].astype(np.int64), group[r]
        order = np.argsort(to, kind="stable")
        to, come = to[order], come[order]
        heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        rank = np.arange(len(to)) - np.repeat(heads, np.diff(np.concatenate((heads, [len(to)]))))
        target = to[heads]
        width = near.shape[1]
        fresh = np.full((len(heads), int(rank.max()) + 1), -1, np.int64)
        fresh[np.searchsorted(target, to), rank] = come
        for a in range(0, len(target), 512):
            some = target[a : a + 512]
            cand = np.concatenate((near[some].astype(np.int64), fresh[a : a + 512]), axis=1)
            dist = np.where(cand >= 0, distances(self.x[cand], self.x[some][:, None]), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * width]
            cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
            full = np.isfinite(dist).sum(1) > width
            if full.any():
                near[some[full]] = diverse(self.x, cand[full], dist[full], width)
            if not full.all():
                part = np.where(np.isfinite(dist[~full]), cand[~full], -1)[:, :width]
                near[some[~full], : part.shape[1]] = part

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """(queries, k) nodes, nearest first, -1 where there are fewer."""
        out = np.full((len(q), k), -1, np.int64)
        for a in range(0, len(q) if len(self.x) else 0, INSERT):
            some = q[a : a + INSERT]
            entry = np.zeros((len(some), 1), np.int64)
            for near in self.near[:0:-1]:
                entry = beam(self.x[: len(near)], near, some, entry, 1)[0]
            found = beam(self.x, self.near[0], some, entry, max(ef, k))[0][:, :k]
            out[a : a + INSERT] = found
        return out


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(np.asarray(column.flatten(), kind).reshape(-1, dim))


SHARD = "dim int, shard int, ids binary, first binary, vectors binary, sizes array<int>, near binary"


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Distinct (vec_id, embedding, dim) of the vectors that take part: not null, empty or zero, without null or non-finite components, with an id."""
    bad = F.expr(f"exists({embedding}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    some = F.expr(f"exists({embedding}, x -> x <> 0)")
    return table.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(~bad & some).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.size(embedding).alias("dim")).distinct()


def build_shards(vectors: DataFrame, shard_rows: int = 1 << 15, least: int = 8, m: int = 16, ef: int = 96, k: int = 10) -> tuple[DataFrame, int]:
    """One row per shard and dimension with its graph as flat arrays, and the number of shards."""
    shards = max(least, -(-vectors.count() // shard_rows))
    kind = np.float64 if "double" in vectors.schema["embedding"].dataType.simpleString() else np.float32

    def run(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        ids = table.column("vec_id").combine_chunks().to_numpy()
        x = _matrix(table.column("embedding"), dim, kind) + kind(0)  # -0 and 0 are equal
        order = np.lexsort((ids, mixed(ids.astype(np.int64).view(U64))))  # an order that is random but fixed
        ids, x = ids[order], x[order]
        rows = x.view(np.dtype((np.void, x.dtype.itemsize * dim)))[:, 0]
        _, at, own = np.unique(rows, return_index=True, return_inverse=True)
        rank = np.empty(len(at), np.int64)
        rank[np.argsort(at)] = np.arange(len(at))  # distinct vectors in the order of their first row
        own = rank[own]
        place = np.lexsort((ids, own))
        own, ids = own[place], ids[place]
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        keep = np.arange(len(own)) - start[own] <= k  # of equal vectors the k+1 least ids are enough
        own, ids = own[keep], ids[keep]
        first = np.searchsorted(own, np.arange(len(at) + 1))
        x = x[np.sort(at)]
        graph = Graph.build(comparable(x)[0], m, ef)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "first": [first.astype(np.int64).tobytes()], "vectors": [x.tobytes()], "sizes": pa.array([[len(a) for a in graph.near]], pa.list_(pa.int32())), "near": [b"".join(a.tobytes() for a in graph.near)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    # a set number of partitions: few bytes make long work here, so small ones must not be joined into one task
    return dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, SHARD), shards


def nearest(table: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 1 << 15, m: int = 16, ef_build: int = 96, ef_search: int = 400, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision) of each query's k nearest found.

    Vectors as in ``valid_vectors``; only vectors of the query's dimension are
    candidates. A query's own id is no candidate. Ties go to the smaller
    vec_id; fewer than k candidates give fewer rows; an empty table gives none;
    repeated rows count once. A distance beyond double precision is infinite.
    """
    ensure_checkpoint_dir(table.sparkSession)
    vectors = valid_vectors(table)
    kind = np.float64 if "double" in vectors.schema["embedding"].dataType.simpleString() else np.float32
    graphs, shards = build_shards(vectors, shard_rows, m=m, ef=ef_build, k=k)
    graphs = graphs.checkpoint()  # a lost executor then costs no graph
    queries = vectors.where(is_query)
    blocks = max(1, -(-queries.count() // block))

    def pack(part: pa.Table) -> pa.Table:
        dim = part.column("dim")[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "q_ids": [part.column("vec_id").combine_chunks().to_numpy().astype(np.int64).tobytes()], "q": [_matrix(part.column("embedding"), dim, kind).tobytes()]})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))).groupBy("dim", "block").applyInArrow(pack, "dim int, q_ids binary, q binary")
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                dim = row["dim"].as_py()
                read = lambda c, t: np.frombuffer(row[c].as_buffer(), t)  # noqa: E731, B023
                x, ids, first, flat, sizes = read("vectors", kind).reshape(-1, dim), read("ids", np.int64), read("first", np.int64), read("near", np.int32), row["sizes"].as_py()
                near, at = [], 0
                for l, s in enumerate(sizes):
                    width = m if l else 2 * m
                    near.append(flat[at : at + s * width].reshape(s, width))
                    at += s * width
                q, q_ids = read("q", kind).reshape(-1, dim), read("q_ids", np.int64)
                own, asked = comparable(x, q)
                found = Graph(own, near).search(asked, k + 1, ef_search)
                i, j = np.nonzero(found >= 0)
                node = found[i, j]
                exact = euclidean(x[node], q[i])
                many = first[node + 1] - first[node]
                i, exact = np.repeat(i, many), np.repeat(exact, many)
                vec = ids[np.repeat(first[node] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                other = vec != q_ids[i]
                i, exact, vec = i[other], exact[other], vec[other]
                order = np.lexsort((vec, exact, i))
                i, exact, vec = i[order], exact[order], vec[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[keep]]), pa.array(vec[keep]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"])

    hits = asked.join(graphs, ["dim", "shard"]).mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
