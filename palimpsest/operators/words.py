"""Words counted within rows: one narrow pass, nothing is exchanged to count what stands in one text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CUT = re.compile("[^a-z]+")
#: Rows of Python values that a task holds before it gives them away: one text's at least.
HELD_ROWS = 1 << 16


def word_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text", least: int = 1, stop: Sequence[str] = (), top: int | None = None, sizes: bool = False) -> DataFrame:
    """id, word, n, rank (by n, then by first occurrence) and n_words (all words of the text): one row per distinct word, the `top` first ones if given.

    With sizes there is also a row without a word for each text, also for those that are null. Words are runs of a-z of at least `least` letters that aren't stop words."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("n_words", T.LongType())])
    left_out = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, counts, ranks, totals = [], [], [], [], []

            def made(batch=batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int64()), pa.array(totals, pa.int64())], schema.fieldNames())

            for row, text in enumerate(batch.column(1)):
                every = [w for w in _CUT.split((text.as_py() or "").lower()) if w and len(w) >= least and w not in left_out]
                # most_common keeps the order of first occurrence among equals.
                found = Counter(every).most_common(top)
                if sizes:
                    found = [(None, 0), *found]
                rows += [row] * len(found)
                words += [w for w, _ in found]
                counts += [n for _, n in found]
                ranks += range(0 if sizes else 1, len(found) + (0 if sizes else 1))
                totals += [len(every)] * len(found)
                if len(rows) >= HELD_ROWS:
                    yield made()
                    rows, words, counts, ranks, totals = [], [], [], [], []
            yield made()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def top_word_lists(docs: DataFrame, id_col: str = "id", text_col: str = "text", n: int = 5, least: int = 3, stop: Sequence[str] = ()) -> DataFrame:
    """id, words: the n most frequent words of each text, ties by first occurrence; one row per row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    left_out = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[w for w, _ in Counter(w for w in _CUT.split((t.as_py() or "").lower()) if len(w) >= least and w not in left_out).most_common(n)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["id", "words"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of three characters of a text, each letter in lower case, as numbers, and how often each occurs."""
    text = text or ""
    low = text.lower() if text.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in text)
    u = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique((u[:-2] << np.uint64(42)) | (u[1:-1] << np.uint64(21)) | u[2:], return_counts=True)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([a[1], b[1]]))
    return keys, counts


def gram_products(rows: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """key, dot, a, b for each row: products of the counts of three-character runs of `left` and `right`, and of each with itself. Rows of one key count together.

    All rows of a key lie in one partition. They are sorted by it and counted one after the other, so a task holds one key's counts."""
    fields = [rows.schema[c] for c in key]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("dot", "a", "b")]])
    kinds = [pa.int64()] * 3

    def products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int]:
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        return int(a[1][i] @ b[1][j]), int(a[1] @ a[1]), int(b[1] @ b[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, a, b = None, 0, None, None
        for batch in batches:
            names = [batch.schema.field(k).type for k in range(len(key))]
            out: list[tuple] = []

            def made(names=names) -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [[]] * len(schema)
                return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, names + kinds, strict=True)], schema.fieldNames())

            for k in range(batch.num_rows):
                own = tuple(batch.column(c)[k].as_py() for c in range(len(key)))
                x, y = (_grams(batch.column(len(key) + c)[k].as_py()) for c in range(2))
                if own == last:
                    n, a, b = n + 1, _merged(a, x), _merged(b, y)
                    continue
                if n:
                    row = (*last, *products(a, b))
                    for _ in range(n):
                        out.append(row)
                        if len(out) >= HELD_ROWS:
                            yield made()
                            out.clear()
                last, n, a, b = own, 1, x, y
            yield made()
        if n:
            row = (*last, *products(a, b))
            for at in range(0, n, HELD_ROWS):
                columns = zip(*[row] * min(HELD_ROWS, n - at), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, names + kinds, strict=True)], schema.fieldNames())

    return rows.select(*key, left, right).sortWithinPartitions(*key).mapInArrow(run, schema)
