"""Byte-level text kernels in numpy over Arrow buffers, shared by the operators.

UTF-8 keeps every ASCII byte out of multi-byte characters, so word patterns whose set is "some ASCII
characters, and everything beyond ASCII" can be cut on bytes. Texts are handled in blocks of a few MB, so
that the arrays beside them stay small whatever the batch is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20
PIECE_BYTES = 4 << 20
BATCH_BYTES = "16m"

#: Bytes of `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for texts in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bounded_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of this session end at a number of bytes too, so that a run of long texts doesn't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Column names like these that none of `columns` has, so that what a user's table brings along is never overwritten."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def marked(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a column, under a name that it lacks, that tells rows apart: a hash of all columns."""
    (mark,) = fresh(df.columns, "__mark")
    return df.withColumn(mark, F.xxhash64(*[F.col(f.name).cast("string") for f in df.schema])), mark


def schema(**fields: str) -> T.StructType:
    """Nullable columns, in order."""
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])


def map_arrow(df: DataFrame, fn, out: T.StructType) -> DataFrame:
    """mapInArrow for a function from a record batch to an iterable of lists of columns."""
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(df).mapInArrow(run, out)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b), their bytes and the offsets of each text in them; null texts are empty. A longer text is a block of its own."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (with the number of all at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of a running polynomial sum. Spans ascend and don't overlap.

    Long data are taken in pieces, so that what stands beside them keeps its size; a span over a border is the sum of its parts."""
    if len(data) <= PIECE_BYTES:
        return mix(_raw_hashes(data, starts, ends))
    out = np.zeros(len(starts), np.uint64)
    for x in range(0, len(data), PIECE_BYTES):
        y = min(x + PIECE_BYTES, len(data))
        a, b = int(np.searchsorted(ends, x, "right")), int(np.searchsorted(starts, y))
        part = _raw_hashes(data[x:y], np.maximum(starts[a:b], x) - x, np.minimum(ends[a:b], y) - x)
        if a < b and starts[a] < x:
            part[:1] *= np.uint64(pow(int(_P), int(x - starts[a]), 1 << 64))
        out[a:b] += part
    return mix(out)


def _raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_P, _P_INVERSE)):
            grown = np.full(n + 1, base, np.uint64)
            grown[0] = 1
            np.multiply.accumulate(grown, out=grown)
            _powers[i] = grown
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=total[1:])
    return (total[ends] - total[starts]) * _powers[1][starts]


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of n words of each text, from the hashes of its words (of all words if it has fewer), and where each text's begin and end."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], made)
    width = np.repeat(np.minimum(counts, n), made)
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        inside = np.flatnonzero(width > j)
        out[inside] = mix(out[inside] * _M2 + hashes[at[inside] + j])
    return out, bounds


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each run values[offsets[i]:offsets[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element of the runs, the number of its run."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def concat_rows(parts: Iterable[np.ndarray], dtype=np.int64) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
