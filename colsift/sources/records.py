"""CSV records whose quoted fields hold line ends, read in blocks side by side.

Whether a line begins inside a quoted field depends on all lines before it. A first pass finds for every block of a file what it makes of
either case; these are composed over the blocks in order, a row a block. A second pass then cuts each block at true record ends. What a
block has of a record that began before it, and of one that goes on behind it, meets in a small join of such parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stage import stage, stage_columns
from .streams import COMPRESSED, StreamDecoder, chunks, listing, raw_lines, runs, splits_at_bytes, whole_file_session, written

# Fixed value: the characters up to the blank, of which a line without any record consists.
BLANK = bytes(range(33))
WHOLE, OPEN, GOES_ON = 0, 1, 2
ROWS = 4096
PARTS = "file long, rank long, n long, kind int, record string, part binary"


class Quoting:
    """Where records end, for one delimiter. A quote opens a field only where the field begins."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter.encode())
        field = rb'(?:"(?:[^"]++|"")*+"[^' + d + rb']*+|[^"' + d + rb'][^' + d + rb']*+|)'
        more = rb"(?:" + d + field + rb")*+\Z"
        self.whole = re.compile(field + more)
        self.closing = re.compile(rb'(?:[^"]++|"")*+"[^' + d + rb"]*+" + more)

    def ends_inside(self, piece: bytes, inside: bool) -> bool:
        """Whether a quoted field is open behind ``piece``, a line without its end."""
        if b'"' not in piece:
            return inside
        return not (self.closing if inside else self.whole).match(piece)

    def effect(self, lines: Iterable[bytes]) -> tuple[bool, bool, bool]:
        """What a block makes of its beginning outside and inside a quoted field, and whether it holds more than blanks."""
        outside, inside, text = False, True, False
        for line in lines:
            text = text or bool(line.strip(BLANK))
            if b'"' in line:
                for piece in line.split(b"\r"):
                    same = outside == inside
                    outside = self.ends_inside(piece, outside)
                    inside = outside if same else self.ends_inside(piece, inside)
        return outside, inside, text

    def records(self, lines: Iterable[bytes], inside: bool) -> Iterator[tuple[int, bytes]]:
        """Records of a block in order: WHOLE ones; first GOES_ON, the rest of one begun before, and last OPEN, one not ended, if there are any."""
        held, kind = [], GOES_ON if inside else WHOLE
        for line in lines:
            if not inside and b'"' not in line and b"\r" not in line:
                if line.strip(BLANK):
                    yield WHOLE, line
                continue
            pieces = line.split(b"\r")
            for i, piece in enumerate(pieces):
                was = inside
                inside = self.ends_inside(piece, inside)
                if not was and not inside:
                    if piece.strip(BLANK):
                        yield WHOLE, piece
                    continue
                held.append(piece)
                if inside:
                    held.append(b"\r" if i + 1 < len(pieces) else b"\n")
                else:
                    yield kind, b"".join(held)
                    held, kind = [], WHOLE
        if held:  # a block ends where a line does: its line feed goes between the parts
            yield (GOES_ON if kind == GOES_ON else OPEN), b"".join(held[:-1])


def _effects(spark: SparkSession, path: str, formats: Formats) -> DataFrame:
    """One row a block: file, block, outside, inside (what it ends in for either beginning), text."""

    def read(batches):
        quoting = formats.quoting()
        state: dict[tuple[int, int], list[bool]] = {}
        for key, rows in runs(batches):
            kind = formats.kind(key[0])
            if kind < 0:
                continue
            if key not in state:
                yield from rows_of(state)
                state = {key: [False, True, False]}
            out, ins, text = quoting[kind].effect(rows.column("value").to_pylist())
            a, b, t = state[key]
            state[key] = [ins if a else out, ins if b else out, t or text]
        yield from rows_of(state)

    def rows_of(state):
        for (file, block), (a, b, t) in state.items():
            yield pa.record_batch({"file": pa.array([file]), "block": pa.array([block]), "outside": pa.array([a]), "inside": pa.array([b]), "text": pa.array([t])})

    return raw_lines(spark, path).select("file", "block", "value").mapInArrow(read, "file long, block long, outside boolean, inside boolean, text boolean")


def block_starts(effects: DataFrame, files: DataFrame) -> DataFrame:
    """file, block, rank (in the order of paths and blocks), starts (inside a quoted field), header (the block with the first record).

    A block either ends in the same way whatever its beginning, or keeps it, or turns it round. So a block begins as the last one of the
    first kind ended, turned round as often as blocks of the last kind follow that.
    """
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    same = F.col("outside") == F.col("inside")
    known = effects.withColumn("turns", F.sum((~same & F.col("outside")).cast("long")).over(order))
    ended = F.last(F.when(same, F.struct("outside", "turns")), ignorenulls=True).over(before)
    known = known.withColumn("ended", ended).withColumn("turned", F.coalesce(F.max("turns").over(before), F.lit(0)))
    since = F.col("turned") - F.coalesce(F.col("ended.turns"), F.lit(0))
    starts = F.coalesce(F.col("ended.outside"), F.lit(False)) != (since % 2 == 1)
    first = F.min(F.when(F.col("text"), F.col("block"))).over(W.partitionBy("file"))
    placed = known.select("file", "block", starts.alias("starts"), (F.col("block") == F.coalesce(first, F.lit(-1))).alias("header"))
    return placed.join(files.select("file", "path"), "file").withColumn("rank", F.row_number().over(W.orderBy("path", "block")).cast("long")).drop("path")


class Formats:
    """Delimiter and encoding of files, as arrays of some 10 bytes a file; or one format for all."""

    def __init__(self, files: np.ndarray | None, kinds: np.ndarray | None, known: list[tuple[str, str]]):
        order = None if files is None else np.argsort(files)
        self.files, self.kinds = (None, None) if order is None else (files[order], kinds[order])
        self.known = known

    @staticmethod
    def one(delimiter: str, encoding: str) -> Formats:
        return Formats(None, None, [(delimiter, encoding)])

    def kind(self, file: int) -> int:
        """Number of the file's format, -1 for a file that is not to be read."""
        if self.files is None:
            return 0
        i = int(np.searchsorted(self.files, file))
        return int(self.kinds[i]) if i < len(self.files) and self.files[i] == file else -1

    def select(self, split: bool) -> Formats:
        """The files that can be read in blocks, or the others."""
        wanted = np.array([splits_at_bytes(e) == split for _, e in self.known], bool)
        if self.files is None:
            return self if wanted.all() else Formats(np.zeros(0, np.int64), np.zeros(0, np.int16), self.known)
        keep = wanted[self.kinds] if len(self.files) else np.zeros(0, bool)
        return Formats(self.files[keep], self.kinds[keep], self.known)

    def any(self) -> bool:
        return self.files is None or len(self.files) > 0

    def quoting(self) -> list[Quoting]:
        return [Quoting(d) for d, _ in self.known]


class Blocks:
    """The facts of all blocks as arrays of 18 bytes a block, found by their place."""

    def __init__(self, rows: pa.Table):
        place = rows["place"].to_numpy()
        order = np.argsort(place)
        self.place, self.rank = place[order], rows["rank"].to_numpy()[order]
        self.starts, self.header = (rows[c].to_numpy(zero_copy_only=False).astype(bool)[order] for c in ("starts", "header"))

    def __getitem__(self, place: int) -> tuple[int, bool, bool]:
        i = int(np.searchsorted(self.place, place))
        return int(self.rank[i]), bool(self.starts[i]), bool(self.header[i])


def _part_rows(file: int, rank: int, header: bool, records: Iterator[tuple[int, bytes]], encoding: str) -> Iterator[pa.RecordBatch]:
    """Records of one block as rows; ``n`` counts from 0 behind the header, which has -1."""
    n, held = -1 if header else 0, []

    def batch():
        return pa.record_batch({
            "file": pa.array([file] * len(held)), "rank": pa.array([rank] * len(held)), "n": pa.array([x[0] for x in held], pa.int64()),
            "kind": pa.array([x[1] for x in held], pa.int32()), "record": pa.array([x[2].decode(encoding) if x[1] == WHOLE else None for x in held], pa.string()),
            "part": pa.array([None if x[1] == WHOLE else x[2] for x in held], pa.binary())})

    for kind, data in records:
        if kind == GOES_ON:
            held.append((0, kind, data))
        else:
            if not (n < 0 and kind == WHOLE):
                held.append((n, kind, data))
            n += 1
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def block_lines(batches, current: dict) -> Iterator[tuple[tuple[int, int, int], Iterator[bytes]]]:
    """The lines of each block as one iterator, which runs on over batches."""
    source = runs(batches)
    ahead: list = []

    def lines(key):
        while True:
            rows = ahead.pop()
            yield from rows.column("value").to_pylist()
            following = next(source, None)
            if following is None:
                return
            ahead.append(following[1])
            if following[0] != key:
                current["key"] = following[0]
                return

    first = next(source, None)
    if first is not None:
        current["key"] = first[0]
        ahead.append(first[1])
    while ahead:
        key, place = current["key"], ahead[0].column("place")[0].as_py()
        yield (*key, place), lines(key)


def split_records(spark: SparkSession, path: str, formats: Formats) -> DataFrame:
    """Records of the files below ``path``, blocks side by side: PARTS."""
    files = stage(listing(spark, path))
    place = F.xxhash64("file", "block").alias("place")
    starts = stage(block_starts(stage(_effects(spark, path, formats)), files))
    blocks = Blocks(starts.select(place, "rank", "starts", "header").toArrow())

    def read(batches):
        quoting = formats.quoting()
        for (file, _, at), lines in block_lines(batches, {}):
            kind = formats.kind(file)
            if kind < 0:
                for _ in lines:
                    pass
                continue
            rank, inside, header = blocks[at]
            yield from _part_rows(file, rank, header, quoting[kind].records(lines, inside), formats.known[kind][1])

    return stage_columns(raw_lines(spark, path).select("file", "block", place, "value").mapInArrow(read, PARTS))


def stream_records(spark: SparkSession, path: str, formats: Formats) -> DataFrame:
    """The same for encodings in which a block can't be read by itself: each file is decoded by one task, as a stream. Parts are UTF-8."""
    files = stage(listing(spark, path).withColumn("rank", F.row_number().over(W.orderBy("path")).cast("long")))

    def decoded(pieces, encoding) -> Iterator[bytes]:
        decoder, rest = StreamDecoder(encoding), b""
        for piece, last in pieces:
            *lines, rest = (rest + decoder.decode(piece, last).encode()).split(b"\n")
            yield from lines
        if rest:
            yield rest

    def read(batches):
        quoting, source, ahead = formats.quoting(), chunks(batches), []

        def pieces():
            while True:
                _, _, piece, mark = ahead.pop()
                yield piece, mark >= 0
                if mark >= 0:
                    return
                ahead.append(next(source))

        for one in source:
            ahead.append(one)
            kind = formats.kind(one[0])
            if kind < 0:
                for _ in pieces():
                    pass
                continue
            yield from _part_rows(one[0], 0, True, quoting[kind].records(decoded(pieces(), formats.known[kind][1]), False), "utf-8")

    lines = raw_lines(whole_file_session(spark), path).where(~F.col("name").rlike(COMPRESSED))
    parts = written(lines.mapInArrow(read, PARTS), spark)
    return parts.drop("rank").join(files.select("file", "rank"), "file").select(*[x.split()[0] for x in PARTS.split(", ")])


def joined_records(parts: DataFrame, formats: Formats) -> DataFrame:
    """file, rank, n, record: whole records, and those put together of the parts that blocks have of them."""
    cut = parts.where(F.col("kind") != WHOLE)
    # In a block the rest of an earlier record comes before the one that goes on behind it.
    order = W.partitionBy("file").orderBy("rank", F.desc("kind"))
    numbered = cut.withColumn("own", F.sum((F.col("kind") == OPEN).cast("long")).over(order))
    each = numbered.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("kind") == GOES_ON, "n", "part"))).alias("all"))
    each = each.select("file", F.col("all")[0]["rank"].alias("rank"), F.col("all")[0]["n"].alias("n"), F.transform("all", lambda x: x["part"]).alias("parts"))

    def join(batches):
        for batch in batches:
            encodings = [formats.known[formats.kind(f)][1] for f in batch.column("file").to_pylist()]
            joined = [b"\n".join(p).decode(e if splits_at_bytes(e) else "utf-8") for p, e in zip(batch.column("parts").to_pylist(), encodings)]
            yield pa.record_batch([*(batch.column(c) for c in ("file", "rank", "n")), pa.array(joined, pa.string())], ["file", "rank", "n", "record"])

    whole = parts.where(F.col("kind") == WHOLE).select("file", "rank", "n", "record")
    return whole.unionByName(each.mapInArrow(join, "file long, rank long, n long, record string")).where("n >= 0")


def read_records(spark: SparkSession, path: str, formats: Formats) -> DataFrame:
    """file, rank, n, record of the files below ``path`` without their headers; ``n`` counts the records of a block, whose order is ``rank``.

    Whatever the number of files and formats, the jobs are the same: at most one series for files that are read in blocks, one for others.
    """
    out = None
    for split, reader in ((True, split_records), (False, stream_records)):
        own = formats.select(split)
        if own.any():
            part = joined_records(reader(spark, path, own), own)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "file long, rank long, n long, record string") if out is None else out
