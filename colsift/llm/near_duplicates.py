"""MinHash near-duplicates from bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsift.llm.components import components
from colsift.llm.staging import discard, staged
from colsift.llm.words import shingle_sets, slices, text_bytes

SKETCH = 192
PERCENT = 75
# Standard errors below the threshold at which a sketch still lets a pair pass.
ERRORS = 4.5
# Ids of texts to fetch are broadcast up to this many (16 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1 << 20


def required(k: int, percent: int = PERCENT) -> int:
    """Values that the sketches of two linked sets share, but for a chance of a few in a million."""
    t = percent / 100
    return max(1, math.floor(t * k - ERRORS * math.sqrt(k * t * (1 - t))))


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of its shingle set and the set's k least hashes."""

    def read(batches):
        for batch in slices(batches):
            sets = shingle_sets(text_bytes(batch.column("text")))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "sketch": pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that the sketch of their union lets pass; ``sure`` where both sketches are the whole sets and so the answer is exact."""
    least = required(k, percent)

    def judge(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(c) for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"))
            na, nb = np.asarray(na), np.asarray(nb)
            values_a, at_a = np.asarray(sa.values).view(np.uint64), np.asarray(sa.offsets)
            values_b, at_b = np.asarray(sb.values).view(np.uint64), np.asarray(sb.offsets)
            keep, sure = np.zeros(batch.num_rows, bool), (na <= k) & (nb <= k)
            for i in range(batch.num_rows):
                both = np.concatenate((values_a[at_a[i] : at_a[i + 1]], values_b[at_b[i] : at_b[i + 1]]))
                both.sort()
                twice = both[1:][both[1:] == both[:-1]]
                if sure[i]:
                    keep[i] = 100 * len(twice) >= percent * (len(both) - len(twice))
                else:
                    union = np.unique(both)[:k]
                    keep[i] = np.count_nonzero(twice <= union[-1]) >= least
            yield pa.record_batch({"a": a, "b": b, "sure": pa.array(sure)}).filter(pa.array(keep))

    of = sketches.select("node", "n", "sketch")
    sides = (pairs.join(of.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
             .join(of.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b"))
    return staged(sides.mapInArrow(judge, "a long, b long, sure boolean"), "estimated")


def _confirmed(estimated: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links among the estimated pairs: those that are sure, and those whose full shingle sets agree."""
    open_pairs = estimated.where("not sure").select("a", "b")
    links = estimated.where("sure").select("a", "b")
    if open_pairs.isEmpty():
        return links
    nodes = open_pairs.select(F.col("a").alias("node")).unionByName(open_pairs.select(F.col("b").alias("node"))).distinct()
    nodes = staged(nodes, "wanted")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(nodes, "node", "left_semi"), "texts")

    def verify(batches):
        for batch in slices(slices(batches, "text_a"), "text_b"):
            sets = zip(shingle_sets(text_bytes(batch.column("text_a"))), shingle_sets(text_bytes(batch.column("text_b"))))
            shared = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in sets]
            keep = [100 * s >= percent * (n - s) for s, n in shared]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = (open_pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
             .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return links.unionByName(sides.mapInArrow(verify, "a long, b long"))


def _may_link(k: int, percent: int):
    """Whether two members of a list can be linked, by their sizes and by what can follow this value in both sketches.

    Of two linked sets with n values together, ``t / (1 + t) * n`` are shared. Sketches that are whole sets share as many; else that
    part of the larger one's sketch, less ``ERRORS`` standard errors. At the first value they share, both must have so many left.
    """
    small, large = F.least("n", "n_other"), F.greatest("n", "n_other")
    size = F.least(large, F.lit(k))
    mean = size * percent * (small + large) / ((100 + percent) * large)
    need = F.when(large <= k, F.ceil(percent * (small + large) / (100 + percent))).otherwise(F.floor(mean - ERRORS * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - mean / size)))))
    left = 1 + F.least(F.least("n", F.lit(k)) - F.col("rank"), F.least("n_other", F.lit(k)) - F.col("rank_other"))
    return (small * 100 >= large * percent) & (left >= need) & (F.col("node") != F.col("other"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    Two texts are linked when ``100 * shared >= percent * union`` of their distinct five-word shingles. Rows with equal sets are one
    node, named by its least doc_id. Each node's sketch is the k least hashes of its set. A retained value's inverted list holds the
    nodes that have it among the rarest values of their sketch: linked sketches share at least ``required`` values, so they meet
    in the list of one of their ``k - required + 1`` rarest, and very common values need no list. Each list first proposes its
    members with one of them only, that whose values are the commonest and so the likeliest middle of a group; after these links are folded into components, members of different components
    are proposed with each other, so nothing is lost and copies are never paired with each other within a component. Proposed pairs
    pass the estimate from the sketch of their union and are then confirmed on full sets.

    Nulls and empty texts have no shingles and are linked with nothing. A null doc_id is never a component's name; such a row has
    the component of its exact copies, else null, and is kept only without one. Rows that repeat a doc_id are one node.
    """
    sketch = staged(sketched(docs, k), "sketches")
    # Written first, so that the join is of two plain exchanges, of which Spark can split a digest that many copies share.
    groups = staged(sketch.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "groups")
    some = sketch.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(groups, "digest").select("doc_id", "n_shingles", "node")
    members = staged(some.unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("node"))), "members")
    names = groups.where("node is not null").select(F.col("node").alias("doc_id"), "digest")
    nodes = staged(sketch.join(names, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
                   .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch"), "nodes")

    discard(sketch)
    values = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    held = values.join(shared, "value")
    own = Window.partitionBy("node")
    size = F.least("n", F.lit(k))
    need = F.least(F.ceil(F.col("n") * percent / 100), F.lit(required(k, percent)))
    rank = size - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "value"))
    oddness = -F.round(F.sum(F.log2("holders")).over(own) / size, 3)
    last = F.lag("value").over(own.orderBy("holders", "value"))
    lists = staged(held.withColumns({"rank": rank, "odd": oddness, "last": last}).where(F.col("rank") <= size - need + 1)
                   .select("value", "node", "n", "odd", "rank", "last"), "lists")

    first = lists.groupBy("value").agg(F.min(F.struct("odd", "node", "n", "rank")).alias("first"), F.count("*").alias("members")).where("members > 1")
    first = first.select("value", F.col("first.node").alias("other"), F.col("first.n").alias("n_other"), F.col("first.rank").alias("rank_other"))
    links = _confirmed(_estimated(_pairs(lists.join(first, "value").where(_may_link(k, percent))), nodes, k, percent), docs, percent)
    part = components(links)

    placed = (lists.join(part, "node", "left").select("value", "node", "n", "odd", "rank", "last", F.coalesce("component", "node").alias("component")))
    placed = staged(placed, "placed")
    mixed = placed.groupBy("value").agg(F.min(F.struct("odd", "node", "component")).alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("low != high").select("value", F.col("first.component").alias("home"))
    away = placed.join(mixed, "value")
    strays = away.where("component != home").select("value", F.col("node").alias("other"), F.col("n").alias("n_other"), F.col("rank").alias("rank_other"),
                                                    F.col("last").alias("last_other"), F.col("component").alias("c_other"))
    # Two members whose values before this one are equal too have met in that value's list.
    met = away.select("value", "node", "n", "rank", "last", "component", "home").join(strays, "value")
    met = met.where((F.col("component") != F.col("c_other")) & ((F.col("component") == F.col("home")) | (F.col("node") < F.col("other"))) & F.coalesce(F.col("last") != F.col("last_other"), F.lit(True)) & _may_link(k, percent))
    more = _confirmed(_estimated(_pairs(met), nodes, k, percent), docs, percent)
    whole = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    out = members.join(whole, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
