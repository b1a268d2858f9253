"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.words import SHINGLE, shingle_runs, slices, text_bytes, word_hashes

RADIUS = 11
BLOCKS = 4
SIMILARITY = 0.75
# Items and bytes of benchmark text a task holds at once (an index of about 5 KB an item); a larger benchmark takes several passes over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 4000, 4 << 20


def fingerprints(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHash of each window of ``length`` words: each bit is the majority of the words' bits."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(sums[starts + length] > sums[starts], axis=1).view(np.uint64).ravel()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class HammingIndex:
    """Finds every item of a window's length whose fingerprint is within ``RADIUS``.

    Fingerprints are cut into four blocks of 16 bits. Of two within the radius, some block differs by ``RADIUS // BLOCKS`` bits at
    most; every value so near to an item's block names the item. A block's table is a sorted list of (length, value) and item, for all
    lengths, so it is as long as there are items. Candidates are then compared in full.
    """

    def __init__(self, prints: np.ndarray, lengths: np.ndarray):
        self.prints, self.lengths = prints, np.unique(lengths)
        near = RADIUS // BLOCKS
        flips = np.array([sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(16), n)], np.uint16)
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        group = np.searchsorted(self.lengths, lengths).astype(np.uint64) << np.uint64(16)
        self.keys, self.items = [], []
        for b in range(BLOCKS):
            keys = (group[:, None] | (blocks[:, b, None] ^ flips[None]).astype(np.uint64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order].astype(np.uint32 if len(self.lengths) < 1 << 16 else np.uint64))
            self.items.append((order // len(flips)).astype(np.int32))

    def within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and item numbers of all pairs within the radius, for windows that stand for items of ``length`` words."""
        group = int(np.searchsorted(self.lengths, length)) << 16
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        pairs = []
        for b, (keys, items) in enumerate(zip(self.keys, self.items)):
            wanted = (blocks[:, b].astype(np.uint64) | np.uint64(group)).astype(keys.dtype)
            low = np.searchsorted(keys, wanted)
            count = np.searchsorted(keys, wanted, "right") - low
            window = np.repeat(np.arange(len(prints)), count)
            item = items[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            near = distance(prints[window], self.prints[item]) <= RADIUS
            pairs.append(window[near] * len(self.prints) + item[near])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.prints), found % len(self.prints)


@dataclass
class Benchmark:
    ids: list
    lengths: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    index: HammingIndex
    known: np.ndarray
    weights: np.ndarray

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """Rarer shingles of the benchmark weigh more; one it does not have weighs as one that a single item has."""
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weights[at], self.weights.max())


def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def prepared(ids: list, texts: list[bytes]) -> Benchmark | None:
    """Items with words, indexed by number of words and fingerprint."""
    words, at = word_hashes(texts)
    runs = [shingle_runs(words[a:b]) for a, b in zip(at[:-1], at[1:])]
    some = [i for i, r in enumerate(runs) if len(r)]
    if not some:
        return None
    lengths = np.diff(at)[some]
    shingles = [counted(runs[i]) for i in some]
    known, holders = np.unique(np.concatenate([s for s, _ in shingles]), return_counts=True)
    prints = np.concatenate([fingerprints(words[at[i] : at[i + 1]], np.array([0]), int(at[i + 1] - at[i])) for i in some])
    return Benchmark([ids[i] for i in some], lengths, shingles, HammingIndex(prints, lengths), known, 1 + np.log(len(some) / holders))


def similarity(bench: Benchmark, item: int, shingles: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item's and a window's shingles, repeats counted."""
    a, na = bench.shingles[item]
    b, nb = counted(shingles)
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.dot(bench.weight(both), np.minimum(na[ia], nb[ib]))
    whole = np.dot(bench.weight(a), na) + np.dot(bench.weight(b), nb) - shared
    return float(shared / whole)


def matches(words: np.ndarray, bench: Benchmark, least: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
    """Of one text: (item, best similarity, first word, words) of each item found."""
    runs = shingle_runs(words)
    n = len(words)
    # A window without any shingle of the benchmark has similarity 0 to all items: only the others are fingerprinted.
    hits = np.concatenate(([0], np.cumsum(np.isin(runs, bench.known))))
    best: dict[int, tuple[float, int, int]] = {}
    for length in bench.index.lengths.tolist():
        size = min(length, n)
        span = max(1, size - SHINGLE + 1)
        starts = np.arange(n - size + 1) if n >= SHINGLE else np.zeros(1, np.int64)
        starts = starts[hits[np.minimum(starts + span, len(runs))] > hits[starts]] if size >= SHINGLE or n < SHINGLE else starts
        if not len(starts):
            continue
        at, item = bench.index.within(fingerprints(words, starts, size), length)
        for s, i in zip(starts[at].tolist(), item.tolist()):
            score = similarity(bench, i, runs[s : s + span] if size >= SHINGLE or n < SHINGLE else shingle_runs(words[s : s + size]))
            if score >= least and score > best.get(i, (0.0,))[0]:
                best[i] = (score, s, size)
    return [(i, *x) for i, x in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark, cut into blocks of bounded size by a hash of the item, one after the other; each is sent to the tasks in turn."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    parts = max(1, -(-total["n"] // BLOCK_ITEMS), -(-total["size"] // BLOCK_BYTES))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        found = prepared([r["item_id"] for r in rows], [r["text"].encode() for r in rows])
        if found:
            yield found


def touched(texts: list[bytes], bench: Benchmark):
    """Word hashes of the texts that share a shingle with the benchmark (or are too short to tell), with their numbers."""
    words, at = word_hashes(texts)
    hit = np.isin(shingle_runs(words, many=True), bench.known)
    sums = np.concatenate(([0], np.cumsum(hit)))
    short = int(bench.lengths.min()) < SHINGLE
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a and (short or b - a < SHINGLE or sums[min(b - SHINGLE + 1, len(hit))] > sums[a]):
            yield i, words[a:b]


def contaminations(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per document and benchmark item found in it: doc_id, item_id, similarity, first_word, n_words.

    Windows have as many words as the item (or the whole text, if that is shorter) and begin at every word. A window's SimHash must be
    within ``RADIUS`` bits of the item's; the index finds all of those. Then the weighted Jaccard similarity of five-word
    shingles must reach ``least``; the best window counts, the first of equals. Windows that share no shingle with any item are not
    fingerprinted, as their similarity is 0. Null and empty texts and items match nothing; repeated rows match each for itself, and items
    with equal texts each match. Without documents, or without items with words, there are no rows. Other columns are ignored. A text
    of any length is searched whole.
    """
    def search(bench):
        def read(batches):
            for batch in slices(batches):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for i, words in touched(text_bytes(batch.column("text")), bench):
                    rows += [(ids[i], bench.ids[k], round(score, 6), s, n) for k, score, s, n in matches(words, bench, least)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                                          ["doc_id", "item_id", "similarity", "first_word", "n_words"])
        return read

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = rows.sparkSession.createDataFrame([], kind)
    for bench in blocks(benchmark):
        found = found.unionByName(rows.mapInArrow(search(bench), kind))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns under whatever names, in which no item is found; all rows if no item has words."""
    def keep(bench):
        def read(batches):
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for i, words in touched(text_bytes(batch.column("text")), bench):
                    clean[i] = not matches(words, bench, least)
                yield batch.filter(pa.array(clean))
        return read

    for bench in blocks(benchmark):
        docs = docs.mapInArrow(keep(bench), docs.schema)
    return docs
