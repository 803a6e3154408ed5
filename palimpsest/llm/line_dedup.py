"""Line dedup by pairwise alignment with patience diff.

Documents are in the order of their ids (equal ids: of their texts' hashes). Each line that several documents share
pairs each later holder with the first one, so a line in k documents makes k - 1 pairs, however frequent it is, and no document
travels: a pair is the list of places of its shared lines in both. Lines shorter than `min_words` may have been seen first in many
documents, so the shortest runs of consecutive lines that reach `min_words` words are shared in the same way, each with its own first holder, and bring
their lines into that pair: what any earlier document has in a run of so many words is found, whoever had its lines first. For each later document its pairs are aligned, those of
the rarest shared lines first, with patience diff: lines that occur once in both documents and in the same order are anchors, and runs
of common lines grow from them. Aligned blocks of at least `min_words` words are deleted from the later document; then all runs of so many words that
stand in both, but that the alignment did not choose (moved, crossed by another line, repeated), so that none is left. If at least `copied_share` of a document's words go, it is a copy, and shorter blocks go too.

Lines are told apart by 128-bit hashes, without white space at their ends. A line is what stands between line feeds.

Defined results: null and empty texts have no lines and stay as they are; lines without words are neither matched nor deleted, unless
their document has no words left, when its text becomes empty; rows with equal id and equal text are one document in several rows, and treated alike; null ids
come last in the order; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import kernel as K
from palimpsest.runtime import cut

MIN_WORDS = 5
COPIED_SHARE = 0.5
_SPACE = b" \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and distinct line, or run of n_lines lines that is a shortest one of `min_words` words: __id, __hash (the document), line, n_lines, at (its places), n_words; and n_words_of_text."""
    out = K.schema(__id=docs.schema[id_col].dataType.simpleString(), __hash="bigint", line="binary", n_lines="int", at="array<int>", n_words="int", all_words="bigint")
    rows = docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col))

    def run(batch: pa.RecordBatch):
        source, lines, n_lines, places, bounds, words, all_words = [], [], [], [], [0], [], []
        for row, text in enumerate(batch.column(2).cast(pa.binary())):
            if not (text := text.as_py()):
                continue
            found: dict[bytes, list[int]] = {}
            size: dict[bytes, tuple[int, int]] = {}
            line_of: dict[int, bytes] = {}
            total = 0
            for k, line in enumerate(text.split(b"\n")):
                n = len(line.split())
                if n:
                    key = xxhash.xxh3_128_digest(line.strip(_SPACE))
                    found.setdefault(key, []).append(k)
                    size[key] = 1, n
                    line_of[k] = key
                    total += n
            short = {k: size[key][1] for k, key in line_of.items() if size[key][1] < min_words}
            for a, b in sorted(runs({k: size[line_of[k]][1] for x in short for k in (x - 1, x, x + 1) if k in line_of}, min_words)) if short else ():
                if b - a > 1:
                    key = xxhash.xxh3_128_digest(b"".join(line_of[k] for k in range(a, b)))
                    found.setdefault(key, []).append(a)
                    size[key] = b - a, sum(size[line_of[k]][1] for k in range(a, b))
            for key, at in found.items():
                source.append(row)
                lines.append(key)
                places += at
                bounds.append(len(places))
                n_lines.append(size[key][0])
                words.append(size[key][1])
                all_words.append(total)
            if len(lines) > 50_000:
                yield _columns(batch, source, lines, n_lines, places, bounds, words, all_words)
                source, lines, n_lines, places, bounds, words, all_words = [], [], [], [], [0], [], []
        if lines:
            yield _columns(batch, source, lines, n_lines, places, bounds, words, all_words)

    return K.map_arrow(rows, run, out)


def _columns(batch, source, lines, n_lines, places, bounds, words, all_words) -> list[pa.Array]:
    take = pa.array(source, pa.int64())
    return [batch.column(0).take(take), batch.column(1).take(take), pa.array(lines, pa.binary()), pa.array(n_lines, pa.int32()), K.lists(places, bounds, pa.int32()), pa.array(words, pa.int32()), pa.array(all_words, pa.int64())]


# One later document ------------------------------------------------------------------------------------------------


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
        before.append(ends[at - 1] if at else -1)
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(common: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Aligned places (later, earlier) by patience diff, for common lines given by their places in both documents."""
    unique = sorted((a[0], b[0]) for a, b in common if len(a) == len(b) == 1)
    if not unique:
        # No line is unique in both: the k-th occurrence meets the k-th.
        unique = sorted((x, y) for a, b in common for x, y in zip(a, b, strict=False))
    anchors = [unique[k] for k in longest_increasing([y for _, y in unique])]
    later = {x: n for n, (a, _) in enumerate(common) for x in a}
    earlier = {y: n for n, (_, b) in enumerate(common) for y in b}
    used_a, used_b = {x for x, _ in anchors}, {y for _, y in anchors}
    out = list(anchors)
    for x0, y0 in anchors:
        for step in (1, -1):
            x, y = x0 + step, y0 + step
            while x not in used_a and y not in used_b and x in later and later[x] == earlier.get(y):
                used_a.add(x)
                used_b.add(y)
                out.append((x, y))
                x, y = x + step, y + step
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of places in the later document that are consecutive in both."""
    out: list[list[int]] = []
    last = (-2, -2)
    for x, y in pairs:
        if (x - 1, y - 1) == last:
            out[-1].append(x)
        else:
            out.append([x])
        last = (x, y)
    return out


def runs(words: dict[int, int], least: int) -> set[tuple[int, int]]:
    """The shortest runs [a, b) of consecutive places with at least so many words, from each place on and up to each place: they cover every longer run.

    Which of them a text has depends on the run alone, so equal texts have equal ones."""
    out = set()
    for step in (1, -1):
        run: deque[int] = deque()
        total = 0
        for x in sorted(words)[::step]:
            if run and run[-1] + step != x:
                run.clear()
                total = 0
            run.append(x)
            total += words[x]
            while total - words[run[0]] >= least:
                total -= words[run.popleft()]
            if total >= least:
                out.add((min(run[0], x), max(run[0], x) + 1))
    return out


def common_runs(common: list[tuple[list[int], list[int]]], words: list[int], least: int) -> set[int]:
    """Places of the later document in runs of at least so many words that the earlier one has too, wherever they stand."""
    later, earlier = ({x: n for n, c in enumerate(common) for x in c[side]} for side in (0, 1))
    found = {tuple(earlier[y] for y in range(a, b)) for a, b in runs({y: words[n] for y, n in earlier.items()}, least)}
    return {x for a, b in runs({x: words[n] for x, n in later.items()}, least) if tuple(later[x] for x in range(a, b)) in found for x in range(a, b)}


def deletions(shared: list[dict], all_words: int, min_words: int = MIN_WORDS, copied_share: float = COPIED_SHARE) -> list[int]:
    """Places of the lines to delete. `shared`: at, first_at, n_words, n_docs, and first (which earlier document) of each shared line, and of each shared run of n_lines lines."""
    single = [s for s in shared if s.get("n_lines", 1) == 1]
    words = {x: s["n_words"] for s in single for x in s["at"]}
    line_at = {x: n for n, s in enumerate(single) for x in s["at"]}
    # By earlier document and line: the places in it.
    by_first: dict = defaultdict(lambda: defaultdict(set))
    rarest: dict = {}
    for s in shared:
        rarest[s["first"]] = min(s["n_docs"], rarest.get(s["first"], s["n_docs"]))
        for k in range(s.get("n_lines", 1)):
            by_first[s["first"]][line_at[s["at"][0] + k]].update(y + k for y in s["first_at"])
    gone: set[int] = set()

    def sweep(least: int) -> None:
        for first in sorted(by_first, key=lambda f: (rarest[f], f)):
            common = [(single[n]["at"], sorted(places)) for n, places in by_first[first].items()]
            gone.update(x for block in blocks(align(common)) if sum(words[x] for x in block) >= least for x in block)
            gone.update(common_runs(common, [single[n]["n_words"] for n in by_first[first]], least))

    sweep(min_words)
    if all_words and sum(words[x] for x in gone) >= copied_share * all_words:
        sweep(1)
    return sorted(gone)


def plan_deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, copied_share: float = COPIED_SHARE) -> DataFrame:
    """__id, __hash, gone (places of lines), goes (by place, whether the line is one of them, up to the last), n_gone_words, all_words: one row per document that loses lines."""
    rows = line_rows(docs, id_col, text_col, min_words)
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"))
    # Rows of one document in several rows are one holder.
    rows = rows.withColumn("holder", order)
    firsts = rows.groupBy("line").agg(F.min(F.struct("holder", "at")).alias("first"), F.max("holder").alias("last"), F.count("*").alias("n_docs"))
    # Cut, so that both sides of the join that follows are exchanged for it and Spark can split the partition of a very common line.
    firsts = cut(firsts.where("first.holder <> last").select(F.col("line").alias("shared_line"), F.col("first.holder").alias("first"), F.col("first.at").alias("first_at"), "n_docs"))
    pairs = rows.join(firsts, F.col("line") == F.col("shared_line")).where("holder <> first")
    # The earlier document is told by a hash: two that collide would only be aligned as one.
    item = F.struct("at", "first_at", "n_lines", "n_words", "n_docs", F.xxhash64("first.id", "first.hash").alias("first"), "line")
    lists = pairs.groupBy("__id", "__hash", "all_words").agg(F.collect_set(item).alias("shared"))
    out = K.schema(__id=docs.schema[id_col].dataType.simpleString(), __hash="bigint", gone="array<int>", goes="array<boolean>", n_gone_words="bigint", all_words="bigint")

    def run(batch: pa.RecordBatch):
        gone, goes, n_words = [], [], []
        for shared, total in zip(batch.column(3), batch.column(2).to_pylist(), strict=True):
            shared = shared.as_py()
            at = deletions(sorted(shared, key=lambda s: (s["first"], s["at"])), total, min_words, copied_share)
            size = {x: s["n_words"] for s in shared if s["n_lines"] == 1 for x in s["at"]}
            gone.append(at)
            flags = np.zeros(at[-1] + 1 if at else 0, bool)
            flags[at] = True
            goes.append(flags)
            n_words.append(sum(size[x] for x in at))
        yield [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(goes, pa.list_(pa.bool_())), pa.array(n_words, pa.int64()), batch.column(2)]

    return K.map_arrow(lists.select("__id", "__hash", "all_words", "shared"), run, out).where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, copied_share: float = COPIED_SHARE, into: tuple[str, str, str] = ("n_lines", "n_deleted_lines", "n_deleted_words")) -> DataFrame:
    """`docs` with `text` rid of deleted lines, and the columns of `into` (which replace such columns of `docs`)."""
    kept = [c for c in docs.columns if c not in into]
    id_, hash_, goes, n_gone, gone_words, all_words, key = K.fresh(kept, "__id", "__hash", "__goes", "__n_gone", "__gone_words", "__all_words", "__key")
    plan = plan_deletions(docs, id_col, text_col, min_words, copied_share)
    plan = plan.select(F.col("__id").alias(id_), F.col("__hash").alias(hash_), F.col("goes").alias(goes), F.size("gone").alias(n_gone), F.col("n_gone_words").alias(gone_words), F.col("all_words").alias(all_words))
    rows = docs.select(*kept).withColumn(key, F.xxhash64(text_col))
    rows = rows.join(plan, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, k: ~F.coalesce(F.get(F.col(goes), k), F.lit(False))), "\n")
    text = F.when(F.col(goes).isNull(), F.col(text_col)).when(F.col(gone_words) >= F.col(all_words), F.lit("")).otherwise(left)
    n_lines = F.when(F.coalesce(F.length(text_col), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(lines)).cast("long")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(*[text.cast(T.StringType()).alias(c) if c == text_col else F.col(c) for c in kept], n_lines.alias(into[0]), number(n_gone).alias(into[1]), number(gone_words).alias(into[2]))
