"""Arrow batches of bounded bytes, walked in slices of bounded text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that a vectorised step holds at a time, unless one text alone is longer.
SLICE_CHARS = 250_000
#: Bytes of an Arrow batch, unless one row alone is larger, where the session has Spark's default, which lets one worker hold ten thousand texts.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


#: What operators keep in this worker for their later tasks, by operator.
_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What this worker keeps for later tasks of an operator; it goes as soon as the worker has a task of another one."""
    return _held.setdefault(operator, {})


def release(operator: str = "") -> None:
    """Give memory that is free, and what other operators keep, back to the system, as Spark keeps Python workers that have nothing to do."""
    for name, kept in _held.items():
        if name != operator:
            kept.clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run, schema, operator: str = "") -> DataFrame:
    """mapInArrow over batches of bounded bytes; the bound stays set in the session, another one that is set already is left.

    operator: whose held() outlives a task.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, _DEFAULT) == _DEFAULT:
        conf.set(_LIMIT, str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        try:
            yield from run(batches)
        finally:
            release(operator)

    return df.mapInArrow(trimmed, schema)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together stay within limit; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def strings(column: pa.Array) -> list[str | None]:
    """The values of a string column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as strings; null is empty."""
    return [x or "" for x in strings(batch.column(batch.schema.get_field_index(column)))]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(64).integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0


def mixed(h: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    """64-bit finaliser; salts may be an array of 64-bit numbers."""
    h = h + (salt * np.uint64(0x9E3779B97F4A7C15) if isinstance(salt, np.ndarray) else np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space), and where each text's begin."""
    x = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[x]
    before = np.append(True, space[:-1])
    first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.arange(len(x)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(x)]])))
    h = np.add.reduceat(_BYTE[x] * powers(0x9E3779B97F4A7C15, int((np.diff(np.append(first, len(x)))).max()) + int(first[0]) + 1)[inside], first)
    ends = starts_of(np.array([len(t) + 1 for t in texts], np.int64))
    return mixed(h + (last - first).astype(np.uint64)), np.searchsorted(first, ends)
