"""Fill-in-the-middle rearrangement of whole texts that are held as seekable compressed frames.

A text is stored as independent zstandard frames of ``UNITS`` code points, with the number of code points up to the end of each. A cut is
found by a search in these counts and only the frames it falls into are decompressed; all others go into the rearranged text as they are.
Texts and digests are read by streaming the frames in order, one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.staging import staged
from colsift.llm.words import slices

UNITS = 1 << 14
LEVEL = 1
# The marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# In which order a form has its parts.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
STORE = "doc_id long, frames array<binary>, ends array<long>, marked boolean"
MOVED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, ends array<long>"
ROWS = 512


def unit_starts(data: bytes) -> np.ndarray:
    """Byte offset of each code point."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


class FrameWriter:
    """Frames and their cumulative counts: bytes are gathered into frames of ``units`` code points, whole frames are taken as they are."""

    def __init__(self, units: int = UNITS, level: int = LEVEL):
        self.units, self.press = units, zstandard.ZstdCompressor(level=level)
        self.begin()

    def begin(self) -> None:
        self.frames, self.ends, self.total, self.held, self.size = [], [], 0, [], 0

    def frame(self, frame: bytes, count: int) -> None:
        """Append a whole frame of ``count`` code points."""
        self.flush()
        self.add(frame, count)

    def add(self, frame: bytes, count: int) -> None:
        self.total += count
        self.frames.append(frame), self.ends.append(self.total)

    def text(self, data: bytes, starts: np.ndarray | None = None) -> None:
        """Append bytes that begin and end between code points."""
        starts = unit_starts(data) if starts is None else starts
        at = 0
        while at < len(starts):
            take = min(self.units - self.size, len(starts) - at)
            end = starts[at + take] if at + take < len(starts) else len(data)
            self.held.append(data[starts[at] if at else 0 : end])
            self.size, at = self.size + take, at + take
            if self.size == self.units:
                self.flush()

    def flush(self) -> None:
        if self.size:
            data, count = b"".join(self.held), self.size
            self.held, self.size = [], 0
            self.add(self.press.compress(data), count)

    def take(self) -> tuple[list[bytes], list[int]]:
        """The frames and counts gathered since the last call."""
        self.flush()
        out = self.frames, self.ends
        self.begin()
        return out


class FrameReader:
    """Reads frames one at a time."""

    def __init__(self):
        self.unpress = zstandard.ZstdDecompressor()

    def stream(self, frames: list[bytes]) -> Iterator[bytes]:
        """The text, frame after frame."""
        return map(self.unpress.decompress, frames)

    def move(self, frames: list[bytes], ends: list[int], first: int, stop: int, out: FrameWriter) -> None:
        """Append the code points ``first`` to ``stop`` to ``out``; only frames that a cut falls into are decompressed."""
        k = bisect_right(ends, first)
        while k < len(frames) and first < stop:
            begin = ends[k - 1] if k else 0
            if begin == first and ends[k] <= stop and (ends[k] - begin == out.units or first > 0):
                out.frame(frames[k], ends[k] - begin)
            else:
                data = self.unpress.decompress(frames[k])
                starts = unit_starts(data)
                a, b = first - begin, min(stop, ends[k]) - begin
                low, high = starts[a] if a else 0, starts[b] if b < len(starts) else len(data)
                out.text(data[low:high], starts[a:b] - low if a else starts[:b])
            first, k = min(stop, ends[k]), k + 1

    def ranges(self, frames: list[bytes], sizes: list[int], spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of each span in turn, where ``sizes`` are the bytes of the frames."""
        ends = np.cumsum([0, *sizes]).tolist()
        for first, stop in spans:
            k = max(bisect_right(ends, first) - 1, 0)
            while k < len(frames) and ends[k] < stop:
                yield self.unpress.decompress(frames[k])[max(first - ends[k], 0) : stop - ends[k]]
                k += 1


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of a document, the same in every run."""
    h = hashlib.sha256(b"1:" + (b"null" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def plan(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form of a text of ``n`` code points and where its prefix and middle end."""
    h1, h2, h3, h4 = draws(doc_id)
    if n == 0 or marked or h3 % 100 >= 90:
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < 20 else "psm", a, b


def framed(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """The frame store of ``docs``: doc_id, frames, ends (code points up to the end of each), marked (a mark occurs in the text).

    Each row of ``docs`` is one of the store, repeated ones too; a null or empty text has no frames. A text may be of any length that
    one value can have. Columns other than doc_id and text are ignored. Bytes that are no UTF-8 belong to the code point before them.
    """

    def write(batches):
        out = FrameWriter(units)
        for batch in slices(batches):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = data or b""
                out.text(data)
                rows.append((doc_id, *out.take(), any(m in data for m in MARKS)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_()))],
                                  ["doc_id", "frames", "ends", "marked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(write, STORE)


def rearranged(store: DataFrame, units: int = UNITS) -> DataFrame:
    """Each row of a frame store with its form and cuts, its text rearranged; again as frames and ends.

    Form ``plain`` is the text itself (cuts null): an empty text, one that holds a mark, and a tenth of the others. Otherwise the text is
    cut at two points drawn from the hash of its doc_id, ties giving empty parts, and its parts follow their marks: prefix, suffix, middle
    (``psm``) or suffix, prefix, middle (``spm``). Equal rows give equal results; an empty store gives no rows.
    """

    def read(batches):
        reader, out = FrameReader(), FrameWriter(units)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(at, ROWS), []
                for doc_id, frames, ends, marked in zip(*(part.column(c).to_pylist() for c in ("doc_id", "frames", "ends", "marked"))):
                    n = ends[-1] if ends else 0
                    form, a, b = plan(doc_id, n, marked)
                    if form == "plain":
                        rows.append((doc_id, n, form, None, None, frames, ends))
                        continue
                    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
                    for mark in ORDERS[form]:
                        out.text(mark)
                        reader.move(frames, ends, *parts[mark], out)
                    rows.append((doc_id, n, form, a, b - a, *out.take()))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in MOVED.split(", ")])

    return store.mapInArrow(read, MOVED)


def texts(moved: DataFrame) -> DataFrame:
    """``moved`` (or a frame store) with ``output``, the whole text of its frames, in place of them."""

    def read(batches):
        reader = FrameReader()
        for batch in batches:
            held, size, first = [], 0, 0
            for at, frames in enumerate(batch.column("frames")):
                held.append(b"".join(reader.stream(frames.as_py())))
                size += len(held[-1])
                if size >= 8 << 20 or at + 1 == batch.num_rows:
                    rows = batch.slice(first, at + 1 - first)
                    yield pa.record_batch([*(rows.column(c) for c in names), pa.array(held, pa.binary())], [*names, "output"])
                    held, size, first = [], 0, at + 1

    names = [c for c in moved.columns if c not in ("frames", "ends")]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in moved.schema.fields if f.name in names]
    return moved.mapInArrow(read, ", ".join([*fields, "output binary"])).withColumn("output", F.col("output").cast("string"))


def mark_places(pieces: Iterator[bytes], order: tuple[bytes, ...], digest) -> tuple[list[int], list[int]]:
    """Where the marks first stand in a text, one after the other, and the bytes of each piece; ``digest`` takes in all pieces."""
    places, sizes, before, tail = [], [], 0, b""
    for piece in pieces:
        digest.update(piece)
        seen, at = tail + piece, 0
        while len(places) < len(order) and (at := seen.find(order[len(places)], at)) >= 0:
            places.append(before - len(tail) + at)
            at += len(order[0])
        sizes.append(len(piece))
        before += len(piece)
        # A mark may go on in the next piece; one that was found stays behind.
        low = places[-1] + len(order[0]) if places else 0
        tail = seen[max(len(seen) - len(order[0]) + 1, low - (before - len(seen)), 0) :]
    return places, sizes


def digests(moved: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of rearranged texts.

    ``restored`` is the text rebuilt from output and form alone: its parts are found by their marks and streamed in their first order.
    """

    def read(batches):
        reader = FrameReader()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out, back = batch.slice(at, ROWS), [], []
                for form, frames in zip(part.column("form").to_pylist(), part.column("frames").to_pylist()):
                    whole = hashlib.sha256()
                    if form == "plain":
                        for piece in reader.stream(frames):
                            whole.update(piece)
                        out.append(whole.hexdigest()), back.append(out[-1])
                        continue
                    order = ORDERS[form]
                    places, sizes = mark_places(reader.stream(frames), order, whole)
                    stops = [*places[1:], sum(sizes)]
                    parts = {mark: (first + len(mark), stop) for mark, first, stop in zip(order, places, stops)}
                    text = hashlib.sha256()
                    for piece in reader.ranges(frames, sizes, [parts[PREFIX], parts[MIDDLE], parts[SUFFIX]]):
                        text.update(piece)
                    out.append(whole.hexdigest()), back.append(text.hexdigest())
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(out, pa.string()), pa.array(back, pa.string())],
                                      [*names, "output_sha256", "restored_sha256"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return moved.mapInArrow(read, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """The digests of all texts of ``docs``, rearranged out of a frame store in the shared folder."""
    return digests(rearranged(staged(framed(docs), "frames")))
