"""Facts of files of any length, from a stream of their bytes.

Spark's text source reads the lines of a whole file in one task, in order, from any store Spark can read. One task keeps for its file what
the rules need from one piece to the next: hashes, a decoder for each encoding and the first lines. Its memory is that of a batch of
lines, however long the file. Small files that are already values of a table go through the same rules as one piece.
"""

from __future__ import annotations

import codecs
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IntakeConfig
from ..functions.stage import stage, work_folder

HEAD_LINES = 20
BOM = codecs.BOM_UTF8
WINDOW = 1 << 20
FACTS = ("encoding string, nul boolean, fingerprint_sha256 string, file_key string, lines array<string>")
# A scan with these settings gives every file to one task.
WHOLE = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 46)}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


@lru_cache(maxsize=None)
def text_codec(name: str) -> codecs.CodecInfo | None:
    """The codec of that name, if it is known and makes text."""
    try:
        info = codecs.lookup(name)
    except LookupError:
        return None
    return info if info._is_text_encoding and info.incrementaldecoder else None


@lru_cache(maxsize=None)
def splits_at_bytes(name: str) -> bool:
    """Whether line ends and quotes of that encoding are their ASCII bytes wherever these occur, so that a block is read by itself."""
    plain = b'\n\r"'
    if codecs.lookup(name).name.startswith(("iso2022", "hz", "utf-7")) or any(bytes([b]).decode(name, "replace") != chr(b) for b in plain):
        return False
    for lead in range(128, 256):
        for b in plain:
            text = bytes([lead, b]).decode(name, "ignore")
            if chr(b) not in text:
                return False
    return True


class StreamDecoder:
    """Decodes a text piece by piece, without a mark at its start. UTF-16 and UTF-32 without a mark are little-endian."""

    def __init__(self, name: str):
        self.info, self.held, self.first = text_codec(name), b"", True
        self.decoder = None if self.info.name in ("utf-16", "utf-32") else self.info.incrementaldecoder("strict")

    def decode(self, chunk: bytes, last: bool = False) -> str:
        if self.decoder is None:
            chunk = self.held + chunk
            if len(chunk) < 4 and not last:
                self.held = chunk
                return ""
            name, marks = self.info.name, {"utf-16": (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE), "utf-32": (codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)}
            self.decoder = codecs.getincrementaldecoder(name if chunk.startswith(marks[name]) else name + "-le")("strict")
        text = self.decoder.decode(chunk, last)
        if self.first and text:
            text, self.first = text.removeprefix("\ufeff"), False
        return text


class Decoded:
    """What one encoding makes of the bytes: whether it reads them, and the first lines that are not blank."""

    def __init__(self, name: str):
        codec = text_codec(name)
        self.reads, self.nul, self.lines, self.rest = codec is not None, False, [], ""
        self.always = codec is not None and codec.name == "iso8859-1"
        self.decoder = StreamDecoder(name) if codec else None

    def feed(self, chunk: bytes, last: bool = False) -> None:
        if not self.reads:
            return
        if self.always and len(self.lines) == HEAD_LINES:
            self.nul = self.nul or b"\0" in chunk
            return
        try:
            text = self.decoder.decode(chunk, last)
        except UnicodeError:
            self.reads = False
            return
        self.nul = self.nul or "\0" in text
        at = 0
        while len(self.lines) < HEAD_LINES and (at < len(text) or last):
            part, at = self.rest + text[at : at + WINDOW], at + WINDOW
            done = last and at >= len(text)
            lines = part.splitlines(keepends=True)
            # The last line may go on, and a carriage return may be half a line end.
            self.rest = lines.pop() if lines and not done and (lines[-1].splitlines()[0] == lines[-1] or lines[-1].endswith("\r")) else ""
            self.lines = (self.lines + [x for line in lines if (x := line.splitlines()[0]).strip()])[:HEAD_LINES]
            if done:
                break


class ByteRules:
    """The facts of one file, fed in pieces. ``starts`` are what may stand before the first piece; ``facts`` is told which does."""

    def __init__(self, name: str, encodings: tuple[str, ...], starts: tuple[bytes, ...] = (b"",)):
        self.names, self.first, self.bytes_nul = encodings, True, False
        self.plain = [hashlib.sha256(s) for s in starts]
        self.keyed = [hashlib.sha256(name.encode() + b"\0" + s) for s in starts]
        self.readers = [Decoded(e) for e in encodings]

    def feed(self, chunk: bytes) -> None:
        for h in (*self.plain, *self.keyed):
            h.update(chunk)
        if self.first and chunk:
            chunk, self.first = chunk.removeprefix(BOM), False
        self.bytes_nul = self.bytes_nul or b"\0" in chunk
        for r in self.readers:
            r.feed(chunk)

    def facts(self, start: int = 0) -> tuple:
        """encoding (the first that reads all bytes), NUL characters, both digests, first lines."""
        for r in self.readers:
            r.feed(b"", True)
        name, reader = next(((n, r) for n, r in zip(self.names, self.readers) if r.reads), (None, None))
        return (name, reader.nul if reader else self.bytes_nul, self.plain[start].hexdigest(), self.keyed[start].hexdigest(), reader.lines if reader else [])


def content_facts(files: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Facts of files that are rows of a table (path, length, content); all null where the content is."""
    encodings = tuple(config.encodings)

    def read(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                if not content.is_valid or path is None:
                    rows.append((None,) * 5)
                    continue
                rules = ByteRules(path.replace("\\", "/").rsplit("/", 1)[-1], encodings)
                rules.feed(content.as_py())
                rows.append(rules.facts())
            yield _fact_batch(batch.select(["path", "length"]), rows)

    return files.select("path", "length", "content").mapInArrow(read, "path string, length long, " + FACTS)


def _fact_batch(own: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()))
    columns = list(zip(*rows)) or [()] * 5
    return pa.record_batch([*own.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*own.schema.names, *(x.split()[0] for x in FACTS.split(", "))])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and ``file`` (64 bits of its URI) of the files below ``path``; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.xxhash64("_metadata.file_path").alias("file"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines between line feeds, as bytes: file, name, block (where its block of the file begins), size of the file, value."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
                        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def whole_file_session(spark: SparkSession) -> SparkSession:
    """A session whose scans don't cut files. Write its results and read them in the session asked for."""
    other = spark.newSession()
    for key, value in WHOLE.items():
        other.conf.set(key, value)
    return other


def runs(batches) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The rows of each (file, block), as they follow one another."""
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(file)] if len(file) else []
        for a, b in zip(cuts, cuts[1:]):
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def chunks(batches) -> Iterator[tuple[int, str, bytes, int]]:
    """The bytes of whole files in order: file, its name, a piece, and with its last piece (else -1) whether a mark was left out at the start.

    The text source drops a UTF-8 mark and does not tell whether the last line has an end; the length of the file tells both.
    """
    current, name, seen, size, joint = None, "", 0, 0, b""

    def end() -> tuple[int, str, bytes, int]:
        rest = size - seen
        if rest not in (0, 1, 3, 4):
            raise ValueError(f"{name}: {seen} of {size} bytes were read; the file changed meanwhile")
        return current, name, b"\n" * (rest % 3), int(rest >= 3)

    for (file, _), rows in runs(batches):
        if file != current:
            if current is not None:
                yield end()
            current, name, size = file, unquote(rows.column("name")[0].as_py()), rows.column("size")[0].as_py()
            seen, joint = 0, b""
        piece = joint + b"\n".join(rows.column("value").to_pylist())
        seen, joint = seen + len(piece), b"\n"
        yield file, name, piece, -1
    if current is not None:
        yield end()


# Names of files that Spark unpacks while it reads them.
COMPRESSED = r"(?i)\.(gz|bz2|snappy|zst|lz4|deflate)$"


def path_facts(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Facts of the files below ``path``, of any length: path, length, encoding, nul, fingerprint_sha256, file_key, lines.

    Each file is streamed by one task. A file with a compressed name has null facts, for Spark would unpack it. A line is one value to
    Spark and can't be longer than 2 GB.
    """
    encodings = tuple(config.encodings)

    def read(batches):
        rules, current = None, None
        for file, name, piece, mark in chunks(batches):
            if file != current:
                rules, current = ByteRules(name, encodings, (b"", BOM)), file
            rules.feed(piece)
            if mark >= 0:
                yield _fact_batch(pa.record_batch({"file": pa.array([file], pa.int64())}), [rules.facts(mark)])

    lines = raw_lines(whole_file_session(spark), path).where(~F.col("name").rlike(COMPRESSED))
    found = written(lines.mapInArrow(read, "file long, " + FACTS), spark)
    files = stage(listing(spark, path))
    # The text source has no rows for a file without bytes, or with nothing but a mark.
    bare = files.where(F.col("length").isin(0, len(BOM)) & ~F.col("path").rlike(COMPRESSED)).join(found, "file", "left_anti")
    content = F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.lit(BOM))
    known = files.join(found, "file", "left").drop("file")
    empty = content_facts(bare.withColumn("content", content), config)
    return known.join(empty.select("path"), "path", "left_anti").unionByName(empty)


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` of another session, as a table of ``spark``."""
    path = f"{work_folder(spark).rstrip('/')}/colsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
