"""Language identification: words first, then ever shorter character n-grams for words not seen in training."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.staging import staged
from colsift.llm.words import FOLDED, mix, powers, running, slices, text_bytes, word_spans

# Rows a model learns from, at most; its vocabulary is all words and n-grams that these hold more than once.
TRAIN_ROWS = 6_000
LONGEST = 5
# Texts scored at once.
TEXTS = 512
SMOOTH = 0.5
LETTER = re.compile(rb"[A-Za-z]")
UNKNOWN = "und"


class Table:
    """64-bit keys to the scores of the languages each was seen in, by open addressing in numpy.

    ``begin`` says where the entries (``langs``, ``scores``) of a key begin; a language without an entry has its score in ``rest``.
    """

    def __init__(self, keys: np.ndarray, begin: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: int):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        seen = np.bincount(langs, weights=counts, minlength=languages) + SMOOTH * (len(keys) + 1)
        self.begin, self.langs, self.rest = begin.astype(np.int64), langs.astype(np.int32), np.log(SMOOTH / seen)
        self.scores = (np.log((counts + SMOOTH) / seen[langs]) - self.rest[langs]).astype(np.float32)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = ((keys[todo] >> self.shift).astype(np.int64) + step) & self.mask
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.rows[at[free][first]], self.keys[at[free][first]] = won, keys[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            step += 1

    def add(self, total: np.ndarray, rows: np.ndarray, owners: np.ndarray) -> None:
        """Add the scores of the keys in ``rows`` to the rows of ``total`` that own them."""
        count = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        cell = np.repeat(owners, count) * total.shape[1] + self.langs[at]
        total += np.bincount(cell, weights=self.scores[at], minlength=total.size).reshape(total.shape)
        total += np.bincount(owners, minlength=len(total))[:, None] * self.rest[None]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it has none."""
        out, todo = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        at = (keys >> self.shift).astype(np.int64)
        while len(todo):
            row = self.rows[at]
            hit = (row >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    words: Table
    grams: Table


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray):
    """For each length from the longest down: the hash of the n-gram at each character of the given words (0 where the word ends before it).

    Also the number of characters of each word.
    """
    down = powers(len(data) + 1)[1]
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first, stop = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    count = np.maximum(stop - first, 0)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    last = np.repeat(stop, count)
    levels = []
    for n in range(LONGEST, 0, -1):
        end = at + n
        fits = end <= last
        a, b = chars[at[fits]], chars[end[fits]]
        h = np.zeros(len(at), np.uint64)
        h[fits] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) + np.uint64(n << 32))
        levels.append(h)
    return levels, count


def parts(texts: list[bytes], size: int = 1 << 18):
    """Runs of texts as one byte array each: index of the first text, data, where each text begins (one more at the end)."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end]) + 1
            end += 1
        yield at, np.frombuffer(b"\n".join(texts[at:end]), np.uint8), np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        at = end


def learnable(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from: a known language and crc32(doc_id) mod 4 other than 2."""
    return docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from at most ``rows`` documents, those with the least hash of their id; of rows of one id and language one is read.

    Executors count words and n-grams by language; the driver gets the counts of those that occur more than once, as Arrow. Its size is
    bounded by the sample: entries are pairs of a key and a language it was seen in, so many languages cost no more than few.
    """
    picked = learnable(docs).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows)
    texts = learnable(docs).select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(picked.distinct()), ["doc_id", "lang"])
    sample = staged(texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text"), "sample")

    def count(batches):
        for batch in slices(batches, size=1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                for _, data, _ in parts([t for t, x in zip(text_bytes(batch.column("text")), langs) if x == lang]):
                    starts, ends = word_spans(data)
                    sums = running(data, FOLDED)
                    words = mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))
                    for level, h in enumerate([words, *(g[g != 0] for g in grams(data, starts, ends, sums)[0])]):
                        k, n = np.unique(h, return_counts=True)
                        yield pa.record_batch({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(np.full(len(k), level > 0)),
                                               "key": pa.array(k.view(np.int64)), "n": pa.array(n, pa.int64())})

    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most a row of the sample each
    index = spark_index(sample, languages)
    counts = sample.mapInArrow(count, "lang string, gram boolean, key long, n long").groupBy("gram", "key", "lang").agg(F.sum("n").alias("n"))
    entry = F.struct("at", "n")
    by_key = (counts.join(F.broadcast(index), "lang").groupBy("gram", "key").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("by"))
              .where("total > 1").select("gram", "key", "by"))
    found = by_key.toArrow().combine_chunks()
    tables = []
    for is_gram in (False, True):
        own = found.filter(pa.compute.equal(found["gram"], is_gram))
        keys, by = own["key"].to_numpy().view(np.uint64), own["by"].combine_chunks()
        order = np.argsort(keys)
        by = by.take(pa.array(order)) if len(order) else by
        entries = by.flatten()
        begin = np.concatenate(([0], np.cumsum(by.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        tables.append(Table(keys[order], begin, entries.field("at").to_numpy(), entries.field("n").to_numpy().astype(np.float64), max(len(languages), 1)))
    return LanguageModel(languages, *tables)


def spark_index(sample: DataFrame, languages: list[str]) -> DataFrame:
    return sample.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, at int")


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def evidence(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its words' scores by language, and how many words and n-grams had one."""
    total, units = np.zeros((len(texts), len(model.words.rest))), np.zeros(len(texts))
    for at, data, begin in parts(texts):
        starts, ends = word_spans(data)
        sums = running(data, FOLDED)
        row = model.words.find(mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64)))
        owner = np.searchsorted(begin, starts, "right") - 1
        unseen = row < 0
        levels, count = grams(data, starts[unseen], ends[unseen], sums)
        found = np.full(count.sum(), -1, np.int32)
        for h in levels:
            todo = np.flatnonzero((found < 0) & (h != 0))
            found[todo] = model.grams.find(h[todo])
        here = slice(at, at + len(begin) - 1)
        for rows, owners, table in ((row[~unseen], owner[~unseen], model.words), (found[found >= 0], np.repeat(owner[unseen], count)[found >= 0], model.grams)):
            units[here] += np.bincount(owners, minlength=len(begin) - 1)
            table.add(total[here], rows, owners)
    return total, units


def predicted(texts: list[bytes], model: LanguageModel) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for at in range(0, len(texts), TEXTS):
        part = texts[at : at + TEXTS]
        total, units = evidence(part, model)
        z = total / np.sqrt(np.maximum(units, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.round(9).argmax(1)
        known = [bool(model.languages) and has_letter(t) for t in part]
        langs += [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
        scores += [round(float(x), 6) if k else 0.0 for x, k in zip(p.max(1), known)]
    return langs, scores


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of at least ``least``."""

    def read(batches):
        for batch in slices(batches):
            langs, scores = predicted(text_bytes(batch.column("text")), model)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(read, docs.schema)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, lang_pred, score.

    A known word scores its log frequency in each language; an unseen one, at each of its characters, that of the longest known n-gram
    that begins there. The score is the best language's share of the exponentials of these sums over the square root of how many there are.
    A null text and one without a letter are ``und`` with score 0; so is every text if no language was learned. A tie goes to the
    language first by name; without any evidence all languages share the score.
    """

    def read(batches):
        for batch in slices(batches):
            langs, scores = predicted(text_bytes(batch.column("text")), model)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                                   "lang_pred": pa.array(langs), "score": pa.array(scores)})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, held_out boolean, lang_pred string, score double")
