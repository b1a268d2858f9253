"""Nearest neighbours by cosine through a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is indexed by the leaf it descends to. A query visits leaves in the order of a priority
queue of the nodes seen so far. How many it visits is calibrated: exact neighbours of some queries are found by brute force, and
the visits are widened until enough of these neighbours lie in visited leaves. Leaves are searched in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsift.llm.staging import staged

NEIGHBOURS, EVERY = 5, 50
# Vectors the tree is fitted on, queries the visits are calibrated with, and the share of their neighbours to be found.
SAMPLE, CALIBRATION, RECALL = 20_000, 256, 0.97
# Children of a node, vectors a leaf should hold, and vectors or queries of a tile.
BRANCH, LEAF, TILE = 8, 1000, 4096
ROWS = 1024
NEAR = 1e-12


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines do not change."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and that of ``b``; the same for a pair wherever it is computed."""
    return np.clip(np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))), -1.0, 1.0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors; fewer where vectors repeat."""
    centres = np.unique(x[: 4 * k], axis=0)[:k] if len(x) else x
    for _ in range(rounds):
        best = closest(x, centres)
        count = np.bincount(best, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        centres = sums[count > 0] / count[count > 0][:, None]
    return centres


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres)).argmax(1)


@dataclass
class Tree:
    """Nodes by number, the root first: its centre, its children; leaves have a number of their own."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def fit(sample: np.ndarray, total: int, leaf_rows: int = LEAF, branch: int = BRANCH) -> Tree:
        """A tree over unit vectors that stand for ``total``, split until a leaf stands for ``leaf_rows`` or the sample is used up."""
        tree, share = Tree(), total / max(len(sample), 1)
        todo = [(sample, sample.mean(0), None)]
        while todo:
            x, centre, parent = todo.pop(0)
            node = len(tree.centres)
            tree.centres.append(centre), tree.children.append([]), tree.leaf.append(-1)
            if parent is not None:
                tree.children[parent].append(node)
            want = int(min(branch, np.ceil(len(x) * share / leaf_rows)))
            centres = kmeans(x, want) if want > 1 and len(x) >= 4 * branch else x[:0]
            if len(centres) > 1:
                best = closest(x, centres)
                todo += [(x[best == i], centres[i], node) for i in range(len(centres)) if (best == i).any()]
            else:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
        return tree

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            best = closest(x[rows], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(c, rows[best == i]) for i, c in enumerate(self.children[node]) if (best == i).any()]
        return out

    def best_bins(self, x: np.ndarray, visits: int) -> Iterator[list[int]]:
        """For each unit vector the first ``visits`` leaves of a best-bin-first traversal."""
        centres = np.stack(self.centres)
        away = np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T)
        for far in away:
            queue, seen = [(far[0], 0)], []
            while queue and len(seen) < visits:
                node = heapq.heappop(queue)[1]
                if self.leaf[node] >= 0:
                    seen.append(self.leaf[node])
                for c in self.children[node]:
                    heapq.heappush(queue, (far[c], c))
            yield seen


class Index:
    """A tree for each length of vector in the sample; vectors of any other length share one leaf."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees = trees

    def __call__(self, vectors: list[bytes], place: Callable[[Tree, np.ndarray], Iterator]) -> list:
        """``place`` of each vector in the tree of its length, 0 or [0] where there is none."""
        out: list = [None] * len(vectors)
        for dim, rows, x in by_length(vectors):
            tree = self.trees.get(dim) or Tree([np.zeros(dim)], [[]], [0], 1)
            for i, found in zip(rows, place(tree, units(x))):
                out[i] = found
        return out


def by_length(vectors: list[bytes]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Vectors of one length at a time: the length, their places, the scaled rows."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        groups.setdefault(len(v) // 8, []).append(i)
    for dim, rows in groups.items():
        yield dim, rows, scaled(np.frombuffer(b"".join(vectors[i] for i in rows), "<f8").reshape(-1, dim))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, key (128 bits of the vector's content), vector (doubles, little-endian) of the rows that take part."""

    def read(batches):
        for batch in batches:
            ids, found = [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                x = None if v.values is None else v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if vec_id is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
                    ids.append(vec_id), found.append(x.tobytes())
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "key": pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in found], pa.binary()), "vector": pa.array(found, pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(read, "vec_id long, key binary, vector binary")


def different(rows: DataFrame, ids: int) -> DataFrame:
    """One row a different vector, with the least ``ids`` of its vec_ids: what equal vectors beyond these could add never ranks.

    Repeated rows are one; of a vector that fills much of the table a task passes on ``ids`` rows.
    """
    once = rows.groupBy("key", "vec_id").agg(F.first("vector").alias("vector"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= ids)
    return first.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def best_pairs(q: np.ndarray, c: np.ndarray, ids: list[list[int]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of ``q`` the ``most`` nearest ids among those of the rows of ``c``: row of q, id, score; nearest first, ties to the smaller id."""
    unit, count = units(c), np.array([len(x) for x in ids])
    flat, begin = np.concatenate(ids), np.concatenate(([0], np.cumsum(count)[:-1]))
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        near = units(part) @ unit.T
        last = np.partition(near, -most, axis=1)[:, -most] if near.shape[1] > most else near.min(1)
        row, col = np.nonzero(near >= last[:, None] - NEAR)
        score = cosine(part[row], c[col])
        times = count[col]
        place = np.repeat(begin[col], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, score, found = np.repeat(row, times), np.repeat(score, times), flat[place]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[rank < most] + at, found[rank < most], score[rank < most]


HITS = "key binary, vec_id long, score double"


def brute_force(candidates: DataFrame, queries: list[tuple[bytes, bytes]], most: int) -> DataFrame:
    """The ``most`` nearest rows of each of a bounded list of queries (key, vector), by a pass over all candidates: HITS and their leaf."""

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors, leaves, ids = part.column("vector").to_pylist(), part.column("leaf").to_pylist(), part.column("ids").to_pylist()
                asked = {dim: (rows, x) for dim, rows, x in by_length([v for _, v in queries])}
                for dim, rows, c in by_length(vectors):
                    if dim not in asked:
                        continue
                    leaf_of = {i: leaves[r] for r in rows for i in ids[r]}
                    for row, found, score in best_pairs(asked[dim][1], c, [ids[r] for r in rows], most):
                        yield pa.record_batch({"key": pa.array([queries[asked[dim][0][r]][0] for r in row], pa.binary()), "vec_id": pa.array(found), "score": pa.array(score),
                                               "leaf": pa.array([leaf_of[i] for i in found.tolist()], pa.int64())})

    return nearest_of(candidates.mapInArrow(read, HITS + ", leaf long"), most)


def nearest_of(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each key; each task passes on as many at most."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def calibrated(index: Index, queries: list[tuple[bytes, bytes, int]], exact: dict[bytes, list[tuple[int, int]]], most: int, recall: float) -> int:
    """Leaves to visit so that, of all the exact neighbours (id, leaf) of the given queries (key, vector, own id), a share of ``recall`` lies in them."""
    ranks = []
    seen = index([v for _, v, _ in queries], lambda tree, x: tree.best_bins(x, tree.leaves))
    for (key, _, own), leaves in zip(queries, seen):
        turn = {leaf: i + 1 for i, leaf in enumerate(leaves)}
        ranks += [turn[leaf] for i, leaf in [x for x in exact.get(key, []) if x[0] != own][:most]]
    return int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) if ranks else 1


@dataclass
class Search:
    """An index over all rows of a table and how it is searched."""

    index: Index
    visits: int
    candidates: DataFrame  # key, vector, ids, dim, leaf

    def probes(self, queries: DataFrame, visits: int, with_vector: bool) -> DataFrame:
        index = self.index

        def read(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    vectors = part.column("vector").to_pylist()
                    leaves = index(vectors, lambda tree, x: tree.best_bins(x, visits))
                    times = np.array([len(x) for x in leaves])
                    rows = pa.array(np.repeat(np.arange(len(leaves)), times))
                    out = {"dim": pa.array(np.repeat([len(v) // 8 for v in vectors], times), pa.int32()), "leaf": pa.array(np.concatenate(leaves), pa.int64()), "key": part.column("key").take(rows)}
                    yield pa.record_batch(out | ({"vector": part.column("vector").take(rows)} if with_vector else {}))

        return queries.mapInArrow(read, "dim int, leaf long, key binary" + ", vector binary" * with_vector)

    def nearest(self, queries: DataFrame, most: int, visits: int | None = None) -> DataFrame:
        """The ``most`` nearest rows of each different query (key, vector) in the leaves it visits, its own ones among them.

        Candidates and queries of a leaf are dealt by their keys into tiles of about ``TILE``, so no leaf is a hot spot.
        """
        visits = self.visits if visits is None else visits
        asked = self.probes(queries, visits, False).groupBy("dim", "leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("rows"))
        held = self.candidates.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("columns"))
        tiles = F.broadcast(staged(asked.join(held, ["dim", "leaf"]), "tiles"))  # a row a leaf
        spread = lambda own, other, salt: (F.pmod(F.xxhash64("key", F.lit(salt)), F.col(own)).cast("int").alias(own[0]),
                                           F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))
        left = self.candidates.join(tiles, ["dim", "leaf"]).select("dim", "leaf", "vector", "ids", *spread("columns", "rows", 1))
        right = self.probes(queries, visits, True).join(tiles, ["dim", "leaf"]).select("dim", "leaf", "key", "vector", *spread("rows", "columns", 2))
        at = ["dim", "leaf", "r", "c"]

        def tile(own: pa.Table, ask: pa.Table) -> pa.Table:
            none = pa.table({"key": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not own.num_rows or not ask.num_rows:
                return none
            keys = ask.column("key").combine_chunks()
            q, c = (scaled(np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(t.num_rows, -1)) for t in (ask, own))
            found = best_pairs(q, c, own.column("ids").to_pylist(), most)
            return pa.concat_tables([none, *(pa.table({"key": keys.take(pa.array(r)), "vec_id": pa.array(i), "score": pa.array(s)}) for r, i, s in found)])

        return nearest_of(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(tile, HITS), most)


def built(vectors: DataFrame, neighbours: int = NEIGHBOURS, every: int = EVERY, sample: int = SAMPLE, leaf_rows: int = LEAF, recall: float = RECALL) -> Search:
    """Index all rows of ``vectors`` and calibrate the visits.

    The tree is fitted on the ``sample`` different vectors with the least hash of their content; the calibration queries are the
    ``CALIBRATION`` different ones with the least such hash among those with an id divisible by ``every``. Both are bounds whatever the size.
    """
    most = neighbours + 1
    rows = staged(different(valid(vectors), most), "vectors")
    total = rows.count()
    picked = [r["vector"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()]
    index = Index({dim: Tree.fit(units(x), round(total * len(x) / len(picked)), leaf_rows) for dim, _, x in by_length(picked)})

    def place(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            leaves = [leaf for at in range(0, len(vectors), ROWS) for leaf in index(vectors[at : at + ROWS], lambda tree, x: tree.descend(x).tolist())]
            yield pa.record_batch([*(batch.column(c) for c in ("key", "vector", "ids")), pa.array([len(v) // 8 for v in vectors], pa.int32()), pa.array(leaves, pa.int64())],
                                  ["key", "vector", "ids", "dim", "leaf"])

    candidates = staged(rows.mapInArrow(place, "key binary, vector binary, ids array<long>, dim int, leaf long"), "leaves")
    trial = rows.where(F.exists("ids", lambda i: i % every == 0)).orderBy(F.xxhash64("key"), "key").limit(CALIBRATION).collect()
    exact: dict[bytes, list[tuple[int, int]]] = {}
    if trial:
        for r in brute_force(candidates, [(r["key"], r["vector"]) for r in trial], most).orderBy(F.desc("score"), "vec_id").collect():  # a bounded list
            exact.setdefault(r["key"], []).append((r["vec_id"], r["leaf"]))
    tried = [(r["key"], r["vector"], next(i for i in r["ids"] if i % every == 0)) for r in trial]
    return Search(index, calibrated(index, tried, exact, neighbours, recall), candidates)


def neighbours(vectors: DataFrame, count: int = NEIGHBOURS, every: int = EVERY, **options) -> DataFrame:
    """The ``count`` nearest rows found for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: the cosine in double precision; ties go to the smaller vec_id. Embeddings that are
    null, empty or all zero or hold a null, NaN or infinite component take no part, nor do rows without a vec_id. Vectors of different
    length are no neighbours. Repeated rows count once; rows with the query's vec_id are its own. A vec_id with several vectors is a
    query for each. Where visited leaves hold fewer than ``count`` candidates, all leaves are searched. An empty table gives no rows.
    """
    most = count + 1
    search = built(vectors, count, every, **options)
    rows = valid(vectors).where(F.col("vec_id") % every == 0)
    asked = staged(rows.groupBy("vec_id", "key").agg(F.first("vector").alias("vector")), "queries")
    different_ones = staged(asked.groupBy("key").agg(F.first("vector").alias("vector")), "asked")
    hits = staged(search.nearest(different_ones, most), "hits")
    found = hits.groupBy("key").agg(F.count("*").alias("n"))
    full = max((t.leaves for t in search.index.trees.values()), default=1)
    if search.visits < full:
        short = staged(different_ones.join(found.where(F.col("n") >= most).select("key"), "key", "left_anti"), "short")
        if not short.isEmpty():
            again = search.nearest(short, most, full)
            hits = hits.join(short.select("key"), "key", "left_anti").unionByName(again)
    lists = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("hits"))
    own = asked.select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, count)
    return own.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
