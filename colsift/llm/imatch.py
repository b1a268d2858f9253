"""I-Match fingerprints: terms of middling document frequency, hashed for several randomised parts of that lexicon."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.words import mix, slices, text_bytes, word_hashes

# Inverse document frequencies kept, ln(documents / documents with the term). The upper end bounds the lexicon at every size of
# corpus: it has no more terms than distinct terms an average document has, times exp(IDF_MOST).
IDF_LEAST, IDF_MOST = 1.6, 7.6
# A copy draws a number for each term; its lexicon of level n holds the terms below 2**-n. So there are lexicons for texts of any
# length: in some level a text has about one term, and there a text that shares part of it often has the same.
LEVELS, COPIES = tuple(range(3, 14)), 12
# Hexadecimal digits of a lexicon's hash; all 0 where the text has no term of it.
DIGITS = 4


def lexicon(docs: DataFrame, least: float = IDF_LEAST, most: float = IDF_MOST) -> np.ndarray:
    """Sorted hashes of the terms within the band, by their frequency in all documents. Tasks add up before the shuffle."""

    def count(batches):
        for batch in slices(batches):
            words, at = word_hashes(text_bytes(batch.column("text")))
            terms, n = np.unique(np.concatenate([np.unique(words[a:b]) for a, b in zip(at[:-1], at[1:])]), return_counts=True)
            yield pa.record_batch({"term": pa.array(terms.view(np.int64)), "n": pa.array(n, pa.int64())})

    rows = docs.select(F.col("text").cast("string").alias("text"))
    total = rows.count()
    held = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = held.where((F.col("n") >= total * math.exp(-most)) & (F.col("n") <= total * math.exp(-least))).select("term")
    return np.sort(np.asarray(band.toArrow().column("term"), dtype=np.int64).view(np.uint64))


def hashes(texts: list[bytes], terms: np.ndarray) -> np.ndarray:
    """For each text a row of hashes, one a level and copy: of the sorted distinct terms it has of that lexicon, 0 where it has none."""
    words, at = word_hashes(texts)
    place = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
    known = terms[place] == words if len(terms) else np.zeros(len(words), bool)
    doc, term = np.repeat(np.arange(len(texts)), np.diff(at))[known], words[known]
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    doc, term = doc[new], term[new]
    value = mix(term ^ np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros((len(texts), len(LEVELS), COPIES), np.uint32)
    for copy in range(COPIES):
        drawn = mix(term + np.uint64((copy + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        some = np.arange(len(term))
        for i, level in enumerate(LEVELS):
            some = some[drawn[some] < np.uint64(1 << (64 - level))]
            if not len(some):
                break
            owner, first = np.unique(doc[some], return_index=True)
            sums = np.add.reduceat(value[some], first)
            out[owner, i, copy] = np.maximum(mix(sums + np.uint64(level)) >> np.uint64(64 - 4 * DIGITS), np.uint64(1))
    return out


def written(rows: np.ndarray) -> list[str]:
    """Rows of hashes as text."""
    data = rows.reshape(len(rows), -1).astype(">u4")
    return [d.tobytes().hex() for d in data.view(np.uint8).reshape(len(rows), -1, 4)[:, :, 4 - DIGITS // 2 :]]


def read_back(prints: list[str]) -> np.ndarray:
    """Texts of ``written`` as rows of hashes."""
    data = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1, DIGITS // 2)
    wide = np.zeros((*data.shape[:2], 4), np.uint8)
    wide[:, :, 4 - DIGITS // 2 :] = data
    return wide.view(">u4").reshape(len(prints), len(LEVELS), COPIES).astype(np.uint32)


def fingerprints(texts: list[bytes], terms: np.ndarray) -> list[str]:
    return written(hashes(texts, terms))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of hashes: 1 for equal ones, else the share of equal hashes in the level where that is highest.

    Hashes that are empty on both sides don't count; a level needs half of its copies. Where no level has those, all levels count together.
    """
    some, same = (a > 0) | (b > 0), (a == b) & (a > 0)
    held, hit = some.sum(2), same.sum(2)
    level = np.where(held * 2 >= COPIES, hit / np.maximum(held, 1), -1.0).max(1)
    pooled = hit.sum(1) / np.maximum(held.sum(1), 1)
    return np.where((a == b).all((1, 2)), 1.0, np.where(level >= 0, level, pooled)).round(6)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    return float(alike(read_back([a]), read_back([b]))[0])


def fingerprinted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint. Null text is empty; equal texts have equal fingerprints."""

    def read(batches):
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(fingerprints(text_bytes(batch.column("text")), terms))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, text, end) so that each bucket, sorted, is a run of documents in descending doc_id, and one more with
    ``end`` set: the document after them (after the last, the first). Texts move once; no task has the whole order.

    Null ids come last. Rows that share a doc_id follow their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.where("doc_id is not null").count()
    parts = max(1, total // max(64, total // 8192))
    points = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", points, 4 * parts)).first()[0] or [], np.int64)) if points else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        known = ids.notna()
        return pd.Series(np.where(known, len(cuts) - np.searchsorted(cuts, ids.where(known, 0).astype("int64"), "left"), len(cuts) + 1))

    placed = rows.withColumn("bucket", bucket_of("doc_id"))
    heads = sorted((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # a row a bucket
    if not heads:
        return placed.withColumn("end", F.lit(0))
    follow = [(heads[(i + 1) % len(heads)][1], heads[(i + 1) % len(heads)][0], b) for i, (b, _) in enumerate(heads)]
    ends = spark.createDataFrame(follow, "head long, of int, bucket int")
    first = placed.select("doc_id", "text", F.col("bucket").alias("of")).join(F.broadcast(ends), "of").where(F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    return placed.select("bucket", "doc_id", "text", F.lit(0).alias("end")).unionByName(first.select("bucket", "doc_id", "text", F.lit(1).alias("end")))


def compared(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its second half replaced from the next document, in descending doc_id. With one document that is itself.
    A null text is empty and has the fingerprint without terms, which is like itself (1) and unlike any other (0). Null ids come last,
    ties and repeated rows follow their text, each a document of its own. An empty table gives no rows. Other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def read(batches):
        before, before_hashes = None, np.zeros((0, len(LEVELS), COPIES), np.uint32)
        for batch in slices(batches):
            rows = list(zip(batch.column("end").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            found = np.concatenate([before_hashes, hashes([t.encode() for *_, t in rows], terms)])
            chain = [before, *rows] if before else rows
            at = [i for i, row in enumerate(chain[:-1]) if not row[0]]
            changed = [edited(chain[i][2], chain[i + 1][2]).encode() for i in at]
            made, own, after = hashes(changed, terms), found[at], found[[i + 1 for i in at]]
            if at:
                columns = ([chain[i][1] for i in at], [len(chain[i][2]) for i in at], [hashlib.sha256(x).hexdigest() for x in changed],
                           written(own), written(made), alike(own, made), alike(own, after))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            before, before_hashes = chain[-1], found[-1:]

    order = in_order(docs).repartition("bucket").sortWithinPartitions("bucket", "end", F.desc_nulls_last("doc_id"), "text")
    return order.mapInArrow(read, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
