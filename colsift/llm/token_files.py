"""Token ids of whole documents in binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsift.llm import elias_fano
from colsift.llm.files import Rolling, content, opened
from colsift.llm.staging import shared_folder, staged
from colsift.llm.words import slices

MAGIC = b"EFTOKEN1"
HEAD = "<8sBQQQ"
FILE_IDS = 1 << 22
# Pieces whose ids a Python worker remembers over its tasks, in each of two generations.
REMEMBERED = 250_000
# Latin letters, then ASCII signs other than the apostrophe: two pieces to the tokenizer, the case of the first does not matter.
PLAIN = "^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"


class Remembered:
    """Values by key, in two generations: when the young one is full it becomes the old one, and what is asked for again is young again."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def all(self, keys: list, make) -> list:
        """The value of each key; ``make`` gives those of a list of new ones."""
        found = list(map(self.young.get, keys))
        again, new = {}, []
        for i in [i for i, value in enumerate(found) if value is None]:
            value = self.old.get(keys[i])
            if value is None:
                new.append(i)
            else:
                found[i] = again[keys[i]] = value
        if new:
            for i, value in zip(new, make([keys[i] for i in new])):
                found[i] = again[keys[i]] = value
        if len(self.young) + len(again) > self.size:
            self.young, self.old = {}, self.young
        self.young.update(again)
        return found


class WordIds:
    """Little-endian ids of texts, by the pieces of their different white-space separated words.

    For tokenizers that drop white space: there a text's ids are those of its words, one after the other. A plain word is a run of letters
    and one of signs; unseen runs of letters are encoded many in one call. Any other word goes to the tokenizer as it is, special tokens in it included.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.kind = Tokenizer.from_file(path), width, f"<u{width}"
        self.pieces, self.others = Remembered(REMEMBERED), Remembered(REMEMBERED)
        # Ids that end a piece, in vocabularies that mark the ends of words.
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, pieces: list[str]) -> list[bytes]:
        """Ids of runs of letters: encoded many as one text and cut where an id ends a word, if the vocabulary shows that."""
        runs = ["\n".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces) or stops[-1] != len(ids):
            return self.encoded(pieces)
        data, at = ids.astype(self.kind).tobytes(), [0, *(stops * self.width).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def texts(self, column: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), ``end`` behind each, and how many each has."""
        lists = pa.compute.ascii_split_whitespace(pa.compute.fill_null(column.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pa.compute.extract_regex(words, PLAIN)
        head = pa.compute.utf8_lower(pa.compute.struct_field(plain, "head")).dictionary_encode()
        tail = pa.compute.struct_field(plain, "tail").dictionary_encode()
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~is_plain)
        # Ids of all pieces: none, the end, letters, signs, other words.
        signs = [x or "" for x in tail.dictionary.to_pylist()]
        ids = [b"", end, *self.pieces.all(head.dictionary.to_pylist(), self.letters), *self.others.all(signs, self.encoded),
               *self.others.all(words.take(pa.array(rest)).to_pylist(), self.encoded)]
        pieces = np.zeros((len(words) + 1, 2), np.int64)
        pieces[:-1, 0][is_plain] = 2 + head.indices.drop_null().to_numpy()
        pieces[:-1, 1][is_plain] = 2 + len(head.dictionary) + tail.indices.drop_null().to_numpy()
        pieces[rest, 0] = 2 + len(head.dictionary) + len(signs) + np.arange(len(rest))
        pieces[-1, 0] = 1
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        order = np.insert(coded.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy()), len(words))
        order = pieces[order].ravel()
        order = order[size[order] > 0]
        last = np.flatnonzero(order == 1)
        first, count = (np.cumsum(size) - size)[order], size[order]
        stop = np.cumsum(count)
        places = np.repeat(first - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)
        return np.frombuffer(b"".join(ids), self.kind)[places], np.diff(stop[last], prepend=0)


_known: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, width: int) -> WordIds:
    """The worker's own, kept from task to task."""
    if (path, width) not in _known:
        _known[path, width] = WordIds(path, width)
    return _known[path, width]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize all texts and write files in ascending order of doc_id; returns the manifest (part, seq, file, n_docs, n_ids).

    ``tokenizer`` is the path of a white-space dropping tokenizer, ``end_id`` follows each document, ``width`` is the bytes of an id.
    Documents are range-partitioned by id; each task rolls its files at ``file_ids``. Null ids come first; equal ids follow their text.
    """
    opened(folder)  # fails here rather than in every task

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, end, part, seq = word_ids(tokenizer, width), np.array([end_id], f"<u{width}").tobytes(), TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def rolled():
            nonlocal held, names, size, seq
            lengths = np.array([len(x) // width for x in held], np.int64)
            known = np.array([x for x in names if x is not None], np.int64)
            out = Rolling(folder, f"part-{part:06d}-{seq:06d}", ".ids")
            out.write(struct.pack(HEAD, MAGIC, width, len(held), int(lengths.sum()), len(held) - len(known)))
            for values in (known, np.concatenate(([0], np.cumsum(lengths)))):
                data = elias_fano.encode(values)
                out.write(struct.pack("<Q", len(data)) + data)
            for x in held:
                out.write(x)
            row = {"part": part, "seq": seq, "file": out.commit(), "n_docs": len(held), "n_ids": int(lengths.sum())}
            held, names, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in slices(batches, size=2 << 20):
            ids, lengths = ids_of.texts(batch.column("text"), end)
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist()):
                held.append(ids[at : at + n].tobytes()), names.append(doc_id)
                at += n
                size += n
                if size >= file_ids:
                    yield rolled()
        if held:
            yield rolled()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return staged(spread.mapInArrow(write, "part int, seq int, file string, n_docs long, n_ids long"), "manifest")


class TokenFile:
    """One file: ``doc_ids``, ``offsets`` (Elias-Fano, one more than documents) and ``ids``."""

    def __init__(self, data: bytes | memoryview):
        magic, width, self.n_docs, self.n_ids, nulls = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, tables = struct.calcsize(HEAD), []
        for _ in range(2):
            size = struct.unpack_from("<Q", data, at)[0]
            tables.append(elias_fano.EliasFano(memoryview(data)[at + 8 : at + 8 + size]))
            at += 8 + size
        self.doc_ids = [None] * nulls + tables[0].all().tolist()
        self.offsets = tables[1]
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files in ``manifest``: doc_id, start, n_tokens, ids_crc32. One row a file is all that is ordered globally."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = staged(manifest.withColumn("base", before.cast("long")), "files")

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with content(folder, name) as stream:
                    file = TokenFile(stream.read())
                at = file.offsets.all()
                wide = file.ids.astype("<u4")
                yield pa.record_batch({"doc_id": pa.array(file.doc_ids, pa.int64()), "start": pa.array(at[:-1] + base), "n_tokens": pa.array(np.diff(at)),
                                       "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())})

    return files.select("file", "base").repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_offsets(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write the files in a new folder of the shared one, then read every document's place back from them.

    A null or empty text is its end id only. Repeated rows are documents of their own. An empty table has no files and no rows.
    """
    folder = shared_folder(docs.sparkSession)
    return read_ids(docs.sparkSession, write_ids(docs, folder, tokenizer, end_id, width), folder)
