"""Approximate nearest neighbours over balanced posting lists.

Vectors of one direction fold into one first. A bounded sample gives centroids: k-means, with clusters cut in two while they hold too much.
Every vector is posted under its nearest centroid and, near boundaries, under others almost as near. Centroids are found by
best-first search of a graph in memory, whose size is bounded. A query opens the lists whose centroids are within a ratio of the
distance of its nearest one, up to a share of all lists. Lists are cut into blocks of bounded expected size, and so are the queries
that open one; a block is read as a stream, its queries first. The lists are compared in single precision; the few nearest of
each query are then measured again, one by one, on the original vectors.
"""

from __future__ import annotations

import heapq
from math import sqrt, sumprod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import materialize

#: Vectors that training looks at, centroids at most, vectors a list should hold: the bounds of what is trained and broadcast.
SAMPLE, CENTROIDS, LIST = 20_000, 4096, 48
#: Lists a vector is posted in at most, and how much farther than the nearest centroid (squared) they may be.
REPLICAS, BOUNDARY = 4, 1.25
#: Lists that a query opens: no farther than so often the nearest one's distance (squared), and no more than this share of all
#: lists, which only binds where nearly all centroids are about as far; but so many at least.
RATIO, SHARE, LEAST = 2.2, 0.13, 18
#: Edges of a centroid in the graph; centroids held open during a search.
DEGREE, OPEN = 24, 96
#: Vectors and queries that a task should hold of a list; queries multiplied at once; candidates measured again besides k.
ROWS, ASKED, QUERIES, SPARE = 8192, 8192, 4096, 8
#: Queries whose nearest a task holds, beyond those of one list, before it tells them.
TOLD = 50_000


def _valid(batch_ids, column, dim: int | None):
    """(positions, (n, dim) float64) of the vectors that take part."""
    at, out = [], []
    for i, v in enumerate(column):
        if batch_ids[i] is None or not v.is_valid:
            continue
        x = v.values
        if len(x) == 0 or x.null_count or dim is not None and len(x) != dim:
            continue
        a = x.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(a).all() and np.any(a):
            at.append(i)
            out.append(a)
    return at, out


def _direction(v: np.ndarray) -> np.ndarray:
    """A vector by its largest part: what the cosine is measured on, the same for all vectors that are told apart by their length only."""
    return v / np.abs(v).max() + 0.0


def _fold(vectors: DataFrame, dim: int, keep: int) -> DataFrame:
    """(h, rep, ids, vec): each distinct direction, with the `keep` smallest ids of the vectors that have it."""

    def part(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            at, vecs = _valid(ids, b.column(1), dim)
            own: dict[bytes, list[int]] = {}
            for i, v in zip(at, vecs):
                own.setdefault(_direction(v).tobytes(), []).append(ids[i])
            rows = [(xxhash.xxh3_64_intdigest(v) >> 1, i, v) for v, x in own.items() for i in heapq.nsmallest(keep, x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["h", "id", "vec"])

    def whole(batches):
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([key[1]], pa.binary())], ["h", "rep", "ids", "vec"])

        for b in batches:
            out = []
            for h, i, v in zip(*(b.column(c).to_pylist() for c in range(3))):
                if (h, v) != key:
                    if key:
                        out.append(row())
                    key, ids = (h, v), []
                if len(ids) < keep and i not in ids[-1:]:
                    ids.append(i)
            if out:
                yield from out
        if key:
            yield row()

    parts = vectors.mapInArrow(part, "h long, id long, vec binary")
    return parts.repartition("h").sortWithinPartitions("h", "vec", "id").mapInArrow(whole, "h long, rep long, ids array<long>, vec binary")


def _two(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cuts a cluster in two along its widest direction, at the median: the halves are equal."""
    y = x - x.mean(0)
    axis = rng.standard_normal(x.shape[1])
    for _ in range(6):
        axis = y.T @ (y @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    p = y @ axis
    side = np.zeros(len(x), bool)
    side[np.argsort(p, kind="stable")[len(x) // 2 :]] = True
    return side


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T - (c * c).sum(1) / 2, axis=1) for k in range(0, len(x), 4096)])


def centroids(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """About k centroids of balanced clusters: halved until small enough, refined by k-means, and halved again where one grew."""
    rng = np.random.default_rng(seed)
    limit = max(2, -(-len(x) // k))
    groups, small = [np.arange(len(x))], []
    while groups:
        g = groups.pop()
        if len(g) <= limit:
            small.append(g)
            continue
        side = _two(x[g], rng)
        groups += [g[side], g[~side]]
    c = np.stack([x[g].mean(0) for g in small])
    for _ in range(4):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    near = _nearest(x, c)
    extra = []
    for j in np.flatnonzero(np.bincount(near, minlength=len(c)) > 3 * limit):
        g = np.flatnonzero(near == j)
        side = _two(x[g], rng)
        c[j] = x[g[side]].mean(0)
        extra.append(x[g[~side]].mean(0))
    return np.concatenate([c, np.stack(extra)]) if extra else c


class Graph:
    """Best-first search over the centroids: near neighbours, and a few far ones that keep all parts in reach."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE, seed: int = 5):
        self.c = np.ascontiguousarray(c, np.float32)
        n = len(c)
        rng = np.random.default_rng(seed)
        near = min(degree, n - 1)
        edges: list[set[int]] = [set() for _ in range(n)]
        sq = (self.c * self.c).sum(1)
        for k in range(0, n, 1024):
            d = sq[None, :] - 2 * self.c[k : k + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
            if near:
                for i, js in enumerate(np.argpartition(d, near - 1, axis=1)[:, :near].tolist(), k):
                    edges[i].update(js)
                    for j in js:
                        edges[j].add(i)
        for i in range(n):
            edges[i].update(int(j) for j in rng.integers(0, n, 4) if j != i)
        self.edges = [np.array(sorted(e), np.int32) for e in edges]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int32))
        self.sq = sq

    def search(self, q: np.ndarray, want: int, hold: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, centroids) of about the `want` nearest, nearest first."""
        q = q.astype(np.float32)
        qq = float(q @ q)
        seen = np.zeros(len(self.c), bool)
        todo: list[tuple[float, int]] = []
        best: list[tuple[float, int]] = []
        hold = max(hold, want)

        def meet(ids: np.ndarray) -> None:
            ids = ids[~seen[ids]]
            seen[ids] = True
            d = self.sq[ids] - 2 * (self.c[ids] @ q) + qq
            for x, i in zip(d.tolist(), ids.tolist()):
                if len(best) < hold or x < -best[0][0]:
                    heapq.heappush(todo, (x, i))
                    heapq.heappush(best, (-x, i))
                    if len(best) > hold:
                        heapq.heappop(best)

        meet(self.entries)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= hold and d > -best[0][0]:
                break
            meet(self.edges[i])
        out = sorted((max(0.0, -d), i) for d, i in best)[:want]
        return np.array([d for d, _ in out]), np.array([i for _, i in out], np.int64)

    def home(self, v: np.ndarray, replicas: int = REPLICAS, boundary: float = BOUNDARY) -> list[int]:
        """The lists of a vector: its nearest centroid, and those almost as near."""
        d, at = self.search(v, replicas, 4 * replicas)
        return at[d <= boundary * d[0] + 1e-12].tolist()

    def probe(self, q: np.ndarray, ratio: float = RATIO, share: float = SHARE) -> list[int]:
        """The lists that a query opens."""
        d, at = self.search(q, max(LEAST, round(share * len(self.c))))
        near = d <= ratio * d[0] + 1e-12
        near[:LEAST] = True
        return at[near].tolist()


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, the same whatever else is computed."""
    a, b = (x / np.abs(x).max() for x in (a, b))  # lengths neither overflow nor vanish
    a, b = a.tolist(), b.tolist()
    return max(-1.0, min(1.0, sumprod(a, b) / sqrt(sumprod(a, a) * sumprod(b, b))))


OUT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", ratio: float = RATIO, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, nearest first, ties to smaller ids.

    queries are rows (vec_id, embedding) too; a row with the query's own id is no candidate. Vectors that are null, empty, zero, or
    hold null or non-finite values take no part on either side, nor do null ids. Vectors of different lengths are compared with
    their like only: each length is a search of its own. Vectors of one direction are searched once and all rows get the result; of
    candidates of one direction, the k + 1 smallest ids are enough for any query. With fewer candidates than k, all of them are returned; tables of
    up to LEAST lists are searched whole. Other columns are not read.
    """

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")

    some = [r["d"] for r in rows(vectors).select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = vectors.sparkSession.createDataFrame([], OUT)
    for dim in some:
        found = _search(rows(vectors).where(F.size("v") == dim), rows(queries).where(F.size("v") == dim), dim, k, ratio, share, sample)
        out = found if len(some) == 1 else out.unionByName(found)
    return out


def _search(vectors: DataFrame, queries: DataFrame, dim: int, k: int, ratio: float, share: float, sample: int) -> DataFrame:
    spark = vectors.sparkSession
    reps = materialize(_fold(vectors, dim, k + 1), "vectors")
    wanted = materialize(_fold(queries, dim, 1).select("h", "rep", "vec"), "queries")
    n, asked = reps.count(), wanted.count()
    if not n or not asked:
        return spark.createDataFrame([], OUT)
    # by hash, so that the sample is the same whatever way the rows lie
    x = np.stack([_unit(r["vec"]) for r in reps.orderBy(F.xxhash64("rep", F.lit(1)), "rep").select("vec").limit(sample).collect()])
    own = Graph(centroids(x, max(1, min(CENTROIDS, n // LIST))))
    lists = len(own.c)
    blocks = -(-REPLICAS * n // (lists * ROWS))
    groups = -(-asked * max(LEAST, round(share * lists)) // (lists * ASKED))
    graph = spark.sparkContext.broadcast(own)
    schema = "list int, block int, part int, q long, rep long, vec binary"

    def posted(queries: bool):
        """Rows of vectors under the lists they are posted in, one for each group of queries; or of queries, one for each block of a list."""

        def run(batches):
            g = graph.value
            for b in batches:
                out: list[tuple] = []
                for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v = _unit(raw)
                    short = v.astype(np.float32).tobytes()
                    if queries:
                        out += [(j, s, r % groups, r, None, short) for j in g.probe(v, ratio, share) for s in range(blocks)]
                    else:
                        out += [(j, r % blocks, s, None, r, short) for j in g.home(v) for s in range(groups)]
                    if len(out) > 20_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

        return run

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["list", "block", "part", "q", "rep", "vec"])

    stream = reps.select("rep", "vec").mapInArrow(posted(False), schema).unionByName(wanted.select("rep", "vec").mapInArrow(posted(True), schema))
    most = k + 1 + SPARE

    def scanned(batches):
        """(q, rep, score) of the nearest of each query in the lists of this task; those of very many queries are told in parts."""
        key, names, held, q = None, [], [], None
        best: dict[int, list[tuple[float, int]]] = {}

        def told():
            rows = [(i, r, s) for i, x in best.items() for s, r in x]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([-r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["q", "rep", "score"])

        for b in batches:
            lists, blocks, parts, qs, rs, vecs = (b.column(i).to_pylist() for i in range(6))
            at = 0
            while at < len(lists):
                here = (lists[at], blocks[at], parts[at])
                end = at
                while end < len(lists) and (lists[end], blocks[end], parts[end]) == here:
                    end += 1
                if here != key:
                    if len(best) >= TOLD:
                        yield told()
                    key, names, held, q = here, [], [], None
                mid = at
                while mid < end and qs[mid] is not None:
                    mid += 1
                names += qs[at:mid]
                held += vecs[at:mid]
                if mid < end and names:
                    if q is None:
                        q, held = np.frombuffer(b"".join(held), np.float32).reshape(-1, dim), []
                    v = np.frombuffer(b"".join(vecs[mid:end]), np.float32).reshape(-1, dim)
                    ids = np.array(rs[mid:end])
                    for lo in range(0, len(q), QUERIES):
                        s = q[lo : lo + QUERIES] @ v.T
                        few = min(most, s.shape[1])
                        last = np.partition(s, s.shape[1] - few, axis=1)[:, -few]
                        for i in range(len(s)):
                            x = best.setdefault(names[lo + i], [])
                            bar = max(last[i], x[0][0]) if len(x) == most else last[i]
                            for j in np.flatnonzero(s[i] >= bar):  # all that are as near as the last one: the smallest ids stay
                                e = (float(s[i, j]), -int(ids[j]))
                                if any(y[1] == e[1] for y in x):
                                    continue  # met in another list
                                if len(x) < most:
                                    heapq.heappush(x, e)
                                elif e > x[0]:
                                    heapq.heapreplace(x, e)
                at = end
        if best:
            yield told()

    found = stream.repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", F.col("q").asc_nulls_last()).mapInArrow(scanned, "q long, rep long, score double")
    near = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= most).select("q", "rep")

    def measured(batches):
        for b in batches:
            score = [cosine(np.frombuffer(x), np.frombuffer(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), b.column(1)], ["q", "score", "ids"])

    pairs = near.join(reps.select("rep", "ids", F.col("vec").alias("v")), "rep").join(wanted.select(F.col("rep").alias("q"), "vec"), "q").select("q", "ids", "v", "vec")
    ids = pairs.mapInArrow(measured, "q long, score double, ids array<long>").select("q", "score", F.explode("ids").alias("id"))
    # of a query's vector, the k + 1 nearest ids: enough for any row that has it, whichever of them is its own
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    answer = ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))

    def named(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            at, vecs = _valid(own, b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in at], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(_direction(v).tobytes()) >> 1 for v in vecs], pa.int64())], ["query_id", "hq"])

    every = queries.mapInArrow(named, "query_id long, hq long").join(wanted.select(F.col("h").alias("hq"), F.col("rep").alias("q")), "hq").join(answer, "q")
    mine = every.select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("f")).distinct()
    return mine.select("query_id", F.posexplode("f").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
