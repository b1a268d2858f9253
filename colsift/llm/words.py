"""Words, their 64-bit hashes and shingles, for whole Arrow batches at once.

A word is a run of bytes other than the white space ``\\x20\\x09-\\x0D``; A-Z count as a-z. Hashes are the same in every process.
A text of any length is hashed in pieces of a quarter of a megabyte, cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE = 1 << 18
SHINGLE = 5
SPACE = re.compile(rb"[\x20\x09-\x0D]")
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.arange(256)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
FOLDED = BYTE[FOLD]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def running(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the hashed bytes, each times the power of its place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """Hash of each span of bytes, equal for equal spans."""
    down = powers(len(data) + 1)[1]
    sums = running(data, table)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at white space into pieces of about PIECE bytes (a longer word stays whole)."""
    at = 0
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(texts: list[bytes], beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, where its words begin (one more at the end).

    With ``beginnings`` the hashes are rows: of the whole words, then of their first bytes, as many as asked for.
    """
    found, counts, run, size = [], np.zeros(len(texts) + 1, np.int64), [], 0

    def flush() -> None:
        nonlocal run, size
        if run:
            data = np.frombuffer(b"\n".join(t for _, t in run), np.uint8)
            starts, ends = word_spans(data)
            found.append(span_hashes(data, starts, ends) if not beginnings else np.stack(
                [span_hashes(data, starts, np.minimum(ends, starts + n)) for n in (len(data), *beginnings)]))
            begin = np.cumsum([0] + [len(t) + 1 for _, t in run])
            np.add.at(counts, np.array([i + 1 for i, _ in run]), np.diff(np.searchsorted(starts, begin)))
        run, size = [], 0

    for i, text in enumerate(texts):
        for piece in pieces(text):
            run.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    return np.concatenate(found, axis=-1) if found else np.zeros((len(beginnings) + 1, 0) if beginnings else 0, np.uint64), np.cumsum(counts)


def shingle_runs(words: np.ndarray, many: bool = False) -> np.ndarray:
    """Hash of each run of five words; fewer words are one run. With ``many`` the words are of several texts: only full runs."""
    if len(words) < SHINGLE and not many:
        short = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            short = mix((short + words[k : k + 1]) * BASE)
        return short[: len(words)]
    n = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs = (runs + words[k : n + k]) * BASE
    return mix(runs)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of five words; a shorter text is one run, one without words is empty."""
    words, at = word_hashes(texts)
    runs = shingle_runs(words, many=True)
    return [np.unique(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else shingle_runs(words[a:b]) for a, b in zip(at[:-1], at[1:])]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about ``size`` bytes (or are one text)."""
    for batch in batches:
        length = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(length) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
            pa.default_memory_pool().release_unused()  # a worker lives on between tasks
