"""Many needles in many texts: by an Aho-Corasick automaton, or by rolling hashes of windows where the needles are too many for one.

Up to about `PART_BYTES` of needles come to the driver, are broadcast, and a task builds its automaton once. More of them stay a table: of each length that
needles have, all windows of the texts are hashed and held against a bitmap of the needles' hashes (broadcast, of bounded size), and what it lets through
is joined with the needles as text. That is one pass however many needles there are; its work is the size of the texts times the number of lengths.
Only where lengths are many beside the size of the table (`LENGTHS_EACH` for each part) needles are dealt over parts of bounded size by a hash, with an automaton and a pass for each.
Texts never travel: what leaves a pass are hits. A plan has no needle in it."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import text as X
from palimpsest.runtime import cut

PART_BYTES = 8 << 20
#: Bytes that a needle takes at least, beside its text.
OVERHEAD = 64
#: So many lengths are as much work as a pass with an automaton.
LENGTHS_EACH = 4
#: Bits of the bitmap for each needle, and at most (16 MB), and how many of them each sets. With more needles more windows leave a pass in vain, but nothing is lost.
BITS_EACH = 32
MOST_BITS = 1 << 27
PROBES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Characters that are hashed at once.
PIECE = 1 << 16
#: Needles that a task remembers to have given.
REMEMBERED = 1 << 17
_BASE = 0xF1357AEA2E62A9C5


def parts_of(needles: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[str]]:
    """The distinct needles (one column of strings) in lists of bounded size. Null and empty ones are left out."""
    (name,) = needles.columns
    rows = needles.select(F.col(name).alias("needle")).where("needle <> ''").distinct()
    size = F.length(F.col("needle").cast("binary")) + OVERHEAD
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == k)
        found = [r[0] for r in part.collect()]
        # Parts are drawn by a hash, so a larger one is cut and not only hoped to be small.
        held, bytes_ = [], 0
        for x in sorted(found):
            more = len(x.encode()) + OVERHEAD
            if held and bytes_ + more > part_bytes:
                yield held
                held, bytes_ = [], 0
            held.append(x)
            bytes_ += more
        if held:
            yield held


def _automaton(needles: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for x in needles:
        made.add_word(x, x)
    made.make_automaton()
    return made


def _found(text: str | None, automaton: ahocorasick.Automaton) -> set[str]:
    return {x for _, x in automaton.iter(text)} if text else set()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


class Windows:
    """Hashes of all windows of some text: sums of its characters' values, each times a power that counts from the window's begin."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def sums(self, text: str) -> np.ndarray:
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(chars) > len(self.up):
            self.up, self.down = (_powers(b, len(chars)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return np.concatenate([[np.uint64(0)], np.cumsum(_mixed(chars + np.uint64(1)) * self.up[: len(chars)])])

    def hashes(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return _mixed((sums[length:] - sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def _pieces(texts: Iterator[str | None], longest: int, most: int) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Texts behind each other in pieces of about `most` characters: (row, where it begins) of what is in a piece, and the piece. Pieces of one text overlap, so that each window is whole in one."""
    rows: list[tuple[int, int]] = []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text or "") - longest + 1), most):
            part = (text or "")[at : at + most + longest - 1]
            if held and size + len(part) > most:
                yield rows, "".join(held)
                rows, held, size = [], [], 0
            if part:
                rows.append((k, size))
                held.append(part)
                size += len(part)
    if held:
        yield rows, "".join(held)


def _let_through(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    here = np.arange(len(hashes))
    shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    for probe in PROBES:
        at = (hashes[here] * probe) >> shift
        here = here[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return here


def _bits_of(needles: DataFrame, n: int) -> np.ndarray:
    """The bitmap of all needles' hashes."""
    size = 1 << 16
    while size < min(BITS_EACH * n, MOST_BITS):
        size <<= 1
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            own = [windows.hashes(windows.sums(x), len(x))[0] for x in batch.column(0).to_pylist()]
            places = np.concatenate([(np.array(own, np.uint64) * probe) >> shift for probe in PROBES])
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], ["at"])

    places = needles.mapInArrow(run, "at bigint")
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _table(needles: DataFrame, part_bytes: int) -> tuple[DataFrame, int, list[int]] | None:
    """The distinct needles as a table, how many, and their lengths; none if an automaton, or one for each part, is less work."""
    (name,) = needles.columns
    rows = cut(needles.select(F.col(name).alias("needle")).where("needle <> ''").distinct())
    of = rows.groupBy(F.length("needle").alias("length")).agg(F.count("*").alias("n"), F.sum(F.length(F.col("needle").cast("binary")) + OVERHEAD).alias("bytes"))
    total = of.agg(F.sum("n"), F.sum("bytes"), F.count("*")).first()
    parts = -(-2 * (total[1] or 0) // part_bytes)
    if (total[1] or 0) <= part_bytes or total[2] > LENGTHS_EACH * parts:
        return None
    return rows, total[0], sorted(r["length"] for r in of.select("length").collect())


def _by_windows(rows: DataFrame, table: tuple[DataFrame, int, list[int]], kept: T.StructType, once: bool = False) -> DataFrame:
    """needle and the kept columns (all but the first of `rows`, which is the text): needles in each text, once; with `once` about once from each task. What the bitmap takes for a needle comes along."""
    needles, n, lengths = table
    known = rows.sparkSession.sparkContext.broadcast(_bits_of(needles, n))
    out = T.StructType([T.StructField("needle", T.StringType()), *kept])
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bits = Windows(), known.value
        given: set[str] = set()
        for batch in batches:
            met: set[tuple[int, str]] = set()
            for begins, piece in _pieces((x.as_py() for x in batch.column(0)), lengths[-1], most):
                sums = windows.sums(piece)
                row, first = (np.array(x) for x in zip(*begins, strict=True))
                ends = np.append(first[1:], len(piece))
                for length in lengths:
                    at = _let_through(windows.hashes(sums, length), bits)
                    owner = np.searchsorted(first, at, side="right") - 1
                    whole = at + length <= ends[owner]
                    met.update((k, piece[a : a + length]) for k, a in zip(row[owner[whole]].tolist(), at[whole].tolist(), strict=True))
            if once:
                met = {(0, x) for x in {x for _, x in met} - given}
                if len(given) > REMEMBERED:
                    given.clear()
                given.update(x for _, x in met)
            said = sorted(met)
            places = pa.array([k for k, _ in said], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in said], pa.string()), *[c.take(places) for c in batch.columns[1:]]], out.fieldNames())

    return rows.mapInArrow(run, out)


def hits(texts: DataFrame, needles: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """id, needle and kept columns: each needle that each text contains, once. Case counts: fold both sides as needed."""
    schema = T.StructType([T.StructField("id", texts.schema[id_col].dataType), T.StructField("needle", T.StringType()), *[texts.schema[c] for c in keep]])
    rows = texts.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), *[F.col(c) for c in keep])
    if table := _table(needles, part_bytes):
        # A needle that is in most texts makes a large partition of this join, which Spark splits.
        found = _by_windows(rows, table, rows.drop("__text").schema).join(table[0], "needle", "left_semi")
        return found.select(F.col("__id").alias("id"), "needle", *keep)
    out = texts.sparkSession.createDataFrame([], schema)
    for part in parts_of(needles, part_bytes):
        known = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(known.value)
            for batch in batches:
                at, said = [], []
                for k, text in enumerate(batch.column(0)):
                    own = sorted(_found(text.as_py(), automaton))
                    at += [k] * len(own)
                    said += own
                places = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(places), pa.array(said, pa.string()), *[batch.column(c).take(places) for c in keep]], schema.fieldNames())

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def tally(texts: DataFrame, needles: DataFrame, *of: Column, id_col: str = "id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """needle and aggregates over the ids of the texts that contain it. Hits are added up before they are held against the table, so few rows travel."""
    if table := _table(needles, part_bytes):
        rows = texts.select(text_col, F.col(id_col).alias("id"))
        return _by_windows(rows, table, rows.select("id").schema).groupBy("needle").agg(*of).join(table[0], "needle", "left_semi")
    return hits(texts, needles, id_col, text_col, part_bytes=part_bytes).groupBy("needle").agg(*of)


def said(texts: DataFrame, needles: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """needle: those that any text contains, once. A task gives each at most once."""
    if table := _table(needles, part_bytes):
        return _by_windows(texts.select(text_col), table, T.StructType(), once=True).distinct().join(table[0], "needle", "left_semi")
    out = texts.sparkSession.createDataFrame([], "needle string")
    for part in parts_of(needles, part_bytes):
        known = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(known.value)
            met: set[str] = set()
            for batch in batches:
                if len(met) < len(known.value):
                    for text in batch.column(0):
                        met |= _found(text.as_py(), automaton)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["needle"])

        out = out.unionByName(texts.select(text_col).mapInArrow(run, "needle string"))
    return out.distinct()


def word_line(text: Column) -> Column:
    """The words of a text between single spaces, with one before and one behind: a run of words is contained in it as ` run `."""
    return F.concat(F.lit(" "), F.array_join(X.tokens(text), " "), F.lit(" "))
