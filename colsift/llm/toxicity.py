"""Toxicity grades by cumulative-link ordinal regression over hashed words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.words import mix, slices, text_bytes, word_hashes

BITS = 20
BEGINNINGS = (4, 5)
TRAIN_ROWS = 8_000
L1 = 1e-3
STEPS = 80
REFIT_L1, REFIT_STEPS = 5e-5, 600


@dataclass
class OrdinalModel:
    """P(grade > j) = sigmoid(w.x - cut_j): one weight a feature for all cuts, cuts in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(score[:, None] - self.cuts[None, :])))


def features(texts: list[bytes], bits: int = BITS, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the distinct hashed features it has, and where they begin: its words and their first four and five bytes.

    Presence counts, not frequency, so that a long text has no weaker signal. With ``table`` only features of some weight are kept.
    """
    words, at = word_hashes(texts, BEGINNINGS)
    slot = (mix(words + np.arange(len(words), dtype=np.uint64)[:, None]) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    both = row << bits | slot
    both = np.unique(both if table is None else both[table[slot] != 0])
    return both & ((1 << bits) - 1), np.searchsorted(both, np.arange(len(texts) + 1) << bits)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def descend(row: np.ndarray, col: np.ndarray, width: int, target: np.ndarray, w: np.ndarray, cuts: np.ndarray, l1: float, steps: int):
    """Accelerated proximal gradient on the mean log loss of all cuts, with an L1 penalty on the shared weights; cuts stay in order.

    A coordinate's step follows how often it is seen, so that common words do not slow rare ones down.
    """
    n = len(target)
    pace = 4.0 / np.maximum(np.bincount(col, minlength=width) / n, 1e-9) / max(1.0, np.sqrt(len(col) / n))
    cut_pace = 2.0 / np.maximum(target.mean(0) * (1 - target.mean(0)), 0.05) / 4
    ahead, ahead_cuts, t = w.copy(), cuts.copy(), 1.0
    for _ in range(steps):
        score = np.bincount(row, weights=ahead[col], minlength=n)
        error = sigmoid(score[:, None] - ahead_cuts[None, :]) - target
        slope = np.bincount(col, weights=error.sum(1)[row], minlength=width) / n
        new = ahead - pace * slope
        new = np.sign(new) * np.maximum(np.abs(new) - pace * l1, 0)
        new_cuts = np.maximum.accumulate(ahead_cuts + cut_pace * error.mean(0))
        if np.dot((ahead - new) / pace, new - w) > 0:  # the momentum points uphill: start it anew
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_cuts = new + (t - 1) / after * (new - w), new_cuts
        w, cuts, t = new, new_cuts, after
    return w, cuts


def fit_ordinal(slots: np.ndarray, at: np.ndarray, grades: np.ndarray, levels: int, bits: int = BITS) -> OrdinalModel:
    """Fit twice: a strong penalty picks the features, then a weak one fits those. Features of one row only get no weight."""
    n = len(grades)
    weights = np.zeros(1 << bits)
    if not n:
        return OrdinalModel(weights, np.arange(levels - 1, dtype=float) + 30)
    target = (grades[:, None] > np.arange(levels - 1)[None, :]).astype(float)
    share = np.clip(target.mean(0), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    cuts = np.log((1 - share) / share)
    used = np.flatnonzero(np.bincount(slots, minlength=1 << bits) > 1)
    w = np.zeros(len(used))
    for l1, steps in ((L1, STEPS), (REFIT_L1, REFIT_STEPS)):
        column = np.full(1 << bits, -1)
        column[used] = np.arange(len(used))
        row, col = np.repeat(np.arange(n), np.diff(at)), column[slots]
        row, col = row[col >= 0], col[col >= 0]
        w, cuts = descend(row, col, len(used), target, w, cuts, l1, steps)
        used, w = used[w != 0], w[w != 0]
    weights[used] = w
    return OrdinalModel(weights, cuts)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, those with the least hash of their id: the sample does not depend on order or partitions.

    The grade of a label is 0 where it is not toxic, 1 where it is, and 2 where the document is toxic and of low quality.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", grade.cast("int").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(known), "doc_id")  # of proven size: rows * 12 bytes


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> OrdinalModel:
    """The model of a bounded sample. Executors turn the sample's texts to feature ids; the driver fits these."""

    def read(batches):
        for batch in slices(batches):
            slots, at = features(text_bytes(batch.column("text")), bits)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "slots": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slots, pa.int32()))})

    sample = training_rows(docs, labels, rows).mapInArrow(read, "doc_id long, grade int, slots array<int>").toArrow()
    order = pa.compute.sort_indices(sample, [("doc_id", "ascending"), ("grade", "ascending")])
    column = sample.column("slots").combine_chunks().take(order)
    grades = np.asarray(sample.column("grade").combine_chunks().take(order), dtype=np.int64)
    slots, at = np.asarray(column.flatten(), dtype=np.int64), np.asarray(column.offsets, dtype=np.int64)
    return fit_ordinal(slots, at, grades, 3, bits)


def severity(docs: DataFrame, model: OrdinalModel, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, severity, grade, toxic, p_toxic.

    ``severity`` is the expected grade, the sum of P(grade > j); ``grade`` the largest j with P(grade >= j) of at least a half; toxic
    where grade is above 0. A text without words, or null, has severity 0. Every row gets a result, repeated rows the same.
    """
    used = np.flatnonzero(model.weights)
    weights, cuts = model.weights[used].astype(np.float32), model.cuts

    def read(batches):
        table = np.zeros(1 << bits, np.float32)
        table[used] = weights
        for batch in slices(batches):
            texts = text_bytes(batch.column("text"))
            slots, at = features(texts, bits, table)
            sums = np.concatenate(([0.0], np.cumsum(table[slots], dtype=np.float64)))
            above = sigmoid((sums[at[1:]] - sums[at[:-1]]).round(6)[:, None] - cuts[None, :])
            above[[not t.strip() for t in texts]] = 0
            grade = (above >= 0.5).sum(1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "severity": pa.array(above.sum(1).round(6)), "grade": pa.array(grade, pa.int32()),
                                   "toxic": pa.array(grade > 0), "p_toxic": pa.array(above[:, 0].round(6))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, severity double, grade int, toxic boolean, p_toxic double")
