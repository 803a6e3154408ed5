"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by document into segments of a few MB of text, as search engines do: a segment is one row that holds the
postings of all its terms, so no term's list is ever in one place and a frequent term costs no shuffle. A phrase is looked up in
each segment by intersecting the lists of its terms, each moved back by the term's place in the phrase, from the rarest list to
the commonest; with a slop, each term may stand somewhat later than right behind the one before.

`build_index` makes the segments of a corpus, whatever is asked later; they are written as a table once. `document_hits`, `phrase_matches` and
`proximity_matches` read the table; `clean` filters documents by it. `contamination` does both in flight (same tasks, nothing written) and adds what it finds to the documents.

Test items are broadcast in parts of at most `max_part_bytes` of text (on a driver or worker about ten times that in windows and term numbers); a larger test set takes
several passes, one part after the other, each written before the next part is made.

In the index terms are found by 64-bit hashes and compared by their letters; in flight by their hashes only. Defined results: null or empty texts have no words and no hits; null item ids count as
''; repeated documents get repeated results, repeated items count once by their id; an empty test set hits nothing; columns other
than id and text aren't read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K
from palimpsest.runtime import cut, remove, shared_path

WINDOW = 10
MAX_PART_BYTES = 8 << 20
SEGMENT_BYTES = 1 << 20
#: Segments are large rows, and Parquet looks at the size of a row group only every hundred rows: groups of a few keep writers and readers small.
ROW_GROUP_ROWS = 8
#: Between two documents of a shard, so that no phrase or proximity runs from one to the next.
GAP = 1 << 12


class Items:
    """The windows of a bounded part of the test set, as numbers of a vocabulary of term hashes."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        texts = pa.array([t or "" for _, t in rows], pa.large_string())
        words: list[list[bytes]] = []
        for _, _, data, offsets in K.text_blocks(texts):
            data = K.LOWER[data]
            starts, ends, first = K.spans(data, offsets, K.ALNUM)
            raw = data.tobytes()
            words += [[raw[starts[k] : ends[k]] for k in range(first[i], first[i + 1])] for i in range(len(offsets) - 1)]
        vocabulary = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.terms = vocabulary
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64) if vocabulary else np.zeros(0, np.int64)
        hashes = K.span_hashes(joined, ends - [len(w) for w in vocabulary], ends) if vocabulary else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # A first look at the low bits spares most other words the binary search.
        self.bits = max(12, int(np.ceil(np.log2(len(vocabulary) + 1))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
        self.ids = sorted({i for i, _ in rows})
        place = {x: k for k, x in enumerate(self.ids)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for (item, _), ws in zip(rows, words, strict=True):
            if ws:
                n = min(window, len(ws))
                by_length.setdefault(n, []).append((place[item], np.lib.stride_tricks.sliding_window_view(np.array([number[w] for w in ws], np.int64), n)))
        #: (length, terms of each distinct window, where its items end, items of all windows)
        self.windows = []
        for n, found in sorted(by_length.items()):
            every, of = np.unique(np.concatenate([w for _, w in found]), axis=0, return_inverse=True)
            owner = np.unique(np.stack([of.ravel(), np.concatenate([np.full(len(w), i) for i, w in found])], axis=1), axis=0)
            self.windows.append((n, every, np.searchsorted(owner[:, 0], np.arange(len(every) + 1)), owner[:, 1]))

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[k] == hashes[at]
        out[at[good]] = self.order[k[good]]
        return out


def passes(items: DataFrame, window: int, id_col: str, text_col: str, max_part_bytes: int, one_pass: Callable[[Broadcast, DataFrame | None], DataFrame]) -> list[DataFrame]:
    """What one_pass makes of each part of the test set, broadcast in parts of a checked size, and of the pass before. Of several passes each is written, and its part dropped, before the next."""
    spark = items.sparkSession
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("words"))
    total = items.agg(F.sum(F.octet_length("words")), F.count("*")).first()
    size = (total[0] or 0) + 64 * total[1]
    n = max(1, -(-size // max_part_bytes))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        held = spark.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], window))
        made = one_pass(held, out[-1] if out else None)
        out.append(made if n == 1 else cut(made))
        if n > 1:
            held.destroy()
    return out


# One shard in memory --------------------------------------------------------------------------------------


class Shard:
    """Sorted keys term * span + position: all postings of a block of documents. Positions run through the shard, with GAP between documents."""

    def __init__(self, terms: np.ndarray, positions: np.ndarray, span: int):
        self.span = span
        self.keys = terms * span + positions

    def count(self, terms: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (terms + 1) * self.span) - np.searchsorted(self.keys, terms * self.span)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of each exact occurrence."""
        if not len(windows) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rarity = np.argsort(self.count(windows), axis=1, kind="stable")
        alive = np.flatnonzero(np.take_along_axis(self.count(windows), rarity[:, :1], 1)[:, 0])
        rarest = windows[alive, rarity[alive, 0]]
        lo, n = np.searchsorted(self.keys, rarest * self.span), self.count(rarest)
        owner = np.repeat(alive, n)
        at = self.keys[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())] % self.span - rarity[owner, 0]
        for step in range(1, windows.shape[1]):
            place = rarity[owner, step]
            wanted = windows[owner, place] * self.span + at + place
            k = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            good = (self.keys[k] == wanted) & (at >= 0)
            owner, at = owner[good], at[good]
        return owner, at

    def near(self, windows: np.ndarray, slop: int, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first, last position) where all its terms stand in order in one document, each at most slop words later than right after the one before. documents: where each begins, and the end."""
        if not len(windows) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        n = self.count(windows[:, 0])
        owner = np.repeat(np.arange(len(windows)), n)
        first = self.keys[_runs(np.searchsorted(self.keys, windows[:, 0] * self.span), n)] % self.span
        last = first
        for step in range(1, windows.shape[1]):
            base = windows[owner, step] * self.span
            # All places within the slop, not the next one only: a later one may be what the terms behind it need.
            lo, hi = np.searchsorted(self.keys, base + last + 1), np.searchsorted(self.keys, base + np.minimum(last + 2 + slop, documents[np.searchsorted(documents, first, "right")]))
            found = self.keys[_runs(lo, hi - lo)] % self.span
            owner, first = np.repeat(owner, hi - lo), np.repeat(first, hi - lo)
            owner, first, last = np.unique(np.stack([owner, first, found]), axis=1)
        # Of the ways from one place the shortest.
        head = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(first) != 0)])) if len(owner) else owner
        return owner[head], first[head], last[head]


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo[i], lo[i] + 1, ... of runs of lengths n, one after the other."""
    return (np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())).astype(np.int64)


def shards(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, np.ndarray, Shard]]:
    """Rows [a, b), their first word positions (and the end), and the postings of the terms that the items ask for."""
    for a, b, data, offsets in K.text_blocks(texts):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.ALNUM)
        term = items.term_numbers(K.span_hashes(data, starts, ends))
        base = first + GAP * np.arange(len(first))
        position = np.arange(len(term)) + GAP * K.owners(first)
        known = np.flatnonzero(term >= 0)
        order = known[np.argsort(term[known], kind="stable")]
        yield a, b, base, Shard(term[order], position[order], int(base[-1]) + GAP)


# The index as a table ---------------------------------------------------------------------------------------

SEGMENT = {"n_words": "array<bigint>", "hash": "array<bigint>", "term": "array<string>", "ends": "array<bigint>", "doc": "array<int>", "at": "array<int>"}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments: ids and n_words of the documents; hash and term of each term, ascending by hash (unsigned); ends, where each term's postings end;
    doc and at of each posting: the document by its place in the segment, and the word's place in it, both ascending within a term."""
    out = K.schema(ids=f"array<{docs.schema[id_col].dataType.simpleString()}>", **SEGMENT)

    def run(batch: pa.RecordBatch):
        for a, b, data, offsets in K.text_blocks(batch.column(1), SEGMENT_BYTES):
            data = K.LOWER[data]
            starts, ends, first = K.spans(data, offsets, K.ALNUM)
            hashes = K.span_hashes(data, starts, ends)
            order = np.argsort(hashes, kind="stable")
            sorted_ = hashes[order]
            head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else order
            raw = data.tobytes()
            terms = [raw[x:y].decode() for x, y in zip(starts[order[head]].tolist(), ends[order[head]].tolist(), strict=True)]
            doc = K.owners(first)
            at = np.arange(len(doc)) - first[doc]
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            ids = batch.column(0).slice(a, b - a)
            yield [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids), one(np.diff(first), pa.int64()), one(sorted_[head].view(np.int64), pa.int64()), one(terms, pa.string()), one(np.append(head[1:], len(order)), pa.int64()), one(doc[order], pa.int32()), one(at[order], pa.int32())]

    return K.map_arrow(docs.select(id_col, text_col), run, out)


def segment(row: dict[str, pa.Array], own: Items) -> tuple[np.ndarray, Shard]:
    """First word positions of a segment's documents (and the end), and its postings of the terms that the items ask for."""
    values = lambda name: row[name].to_numpy(zero_copy_only=False)
    base = np.concatenate([[0], np.cumsum(values("n_words") + GAP)]).astype(np.int64)
    hashes, ends = values("hash").view(np.uint64), values("ends")
    k = np.minimum(np.searchsorted(hashes, own.hashes), max(0, len(hashes) - 1))
    asked = np.flatnonzero(hashes[k] == own.hashes) if len(hashes) else np.zeros(0, np.int64)
    found = row["term"].take(pa.array(k[asked], pa.int64())).to_pylist()
    same = [n for n, t in zip(asked.tolist(), found, strict=True) if t.encode() == own.terms[own.order[n]]]
    # In the order of the vocabulary, so that the keys ascend.
    same.sort(key=lambda n: own.order[n])
    lo = [int(ends[k[n] - 1]) if k[n] else 0 for n in same]
    hi = [int(ends[k[n]]) for n in same]
    take = K.concat_rows(np.arange(x, y) for x, y in zip(lo, hi, strict=True))
    terms = K.concat_rows(np.full(y - x, own.order[n]) for n, x, y in zip(same, lo, hi, strict=True))
    return base, Shard(terms, base[values("doc")[take]] + values("at")[take], int(base[-1]) + GAP)


def rows_of(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].values for i, name in enumerate(batch.schema.names)}


def document_hits(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """Per indexed document: id, n_words, items (ids of those with an occurring window, sorted), spans (merged runs of hit words)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    out = K.schema(segment="bigint", place="int", id=kind, n_words="bigint", items="array<string>", spans="array<struct<start:bigint,end:bigint>>")

    def one_pass(part: Broadcast, _: DataFrame | None) -> DataFrame:
        def run(batch: pa.RecordBatch):
            own: Items = part.value
            for row in rows_of(batch):
                base, shard = segment(row, own)
                items_of, spans_of = [set() for _ in base[1:]], [[] for _ in base[1:]]
                for d, its, s, n in hits(shard, base, own):
                    items_of[d].update(own.ids[i] for i in its)
                    spans_of[d].append((s, s + n))
                name = int.from_bytes(hashlib.sha256(repr(row["ids"].to_pylist()).encode() + row["hash"].to_numpy().tobytes()).digest()[:8], "big", signed=True)
                spans = [[{"start": x, "end": y} for x, y in merged(s)] for s in spans_of]
                n = len(items_of)
                yield [pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()), row["ids"], row["n_words"], pa.array([sorted(x, key=str.encode) for x in items_of], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

        return K.map_arrow(index, run, out)

    parts = passes(items, window, item_id, item_text, max_part_bytes, one_pass)
    found = functools.reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        runs = F.array_sort(F.flatten(F.collect_list("spans")))
        join = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(s["end"], F.element_at(acc, -1)["end"]).alias("end"))))).otherwise(F.array_append(acc, s))
        # Rows that are alike in all of this are repeats of one document: each part tells of them as often.
        again = found.groupBy("segment", "place", "id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), runs.alias("runs"), (F.count("*") / len(parts)).cast("int").alias("times"))
        merged_runs = F.aggregate("runs", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(join(acc, s)))
        found = again.withColumn("spans", merged_runs).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("t", "times", "runs")
    return found.drop("segment", "place")


def matches(index: DataFrame, items: DataFrame, slop: int | None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_part_bytes: int = MAX_PART_BYTES) -> DataFrame:
    """Matches (doc, item, start, n_words); slop None: exact phrases."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    out = K.schema(doc=kind, item="string", start="bigint", n_words="bigint")

    def one_pass(part: Broadcast, _: DataFrame | None) -> DataFrame:
        def run(batch: pa.RecordBatch):
            own: Items = part.value
            for row in rows_of(batch):
                base, shard = segment(row, own)
                rows = [(d, own.ids[i], s, n) for d, items_of, s, n in hits(shard, base, own, slop) for i in items_of]
                if rows:
                    d, i, s, n = zip(*rows, strict=True)
                    yield [row["ids"].take(pa.array(d)), pa.array(i, pa.string()), pa.array(s, pa.int64()), pa.array(n, pa.int64())]

        return K.map_arrow(index, run, out)

    return functools.reduce(DataFrame.unionByName, passes(items, window, item_id, item_text, max_part_bytes, one_pass))


def phrase_matches(index: DataFrame, items: DataFrame, **options) -> DataFrame:
    return matches(index, items, None, **options)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 2, **options) -> DataFrame:
    return matches(index, items, slop, **options)


def hits(shard: Shard, base: np.ndarray, own: Items, slop: int | None = None):
    """(document, items, start word, words) of each occurrence of a window in a shard."""
    for n, windows, bounds, items_of in own.windows:
        if slop is None:
            owner, at = shard.phrases(windows)
            ends = at + n
        else:
            owner, at, last = shard.near(windows, slop, base)
            ends = last + 1
        doc = np.searchsorted(base, at, "right") - 1
        for w, d, s, e in zip(owner.tolist(), doc.tolist(), at.tolist(), ends.tolist(), strict=True):
            yield d, items_of[bounds[w] : bounds[w + 1]].tolist(), s - int(base[d]), e - s


# In flight ----------------------------------------------------------------------------------------------------


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_part_bytes: int = MAX_PART_BYTES, into: str = "contamination") -> DataFrame:
    """`docs` with a struct column `into`: n_words, n_hit, items (array of ids, sorted), spans (hit runs as start and end). All other columns pass through."""
    state = "struct<n_words:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
    docs = docs.withColumn(into, F.lit(None).cast(state))

    def one_pass(part: Broadcast, before: DataFrame | None) -> DataFrame:
        def run(batch: pa.RecordBatch):
            own: Items = part.value
            text, old = batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.num_columns - 1)
            for a, b, base, shard in shards(text, own):
                earlier = old.slice(a, b - a).to_pylist()
                items_of: list[set] = [set((x or {}).get("items") or ()) for x in earlier]
                spans_of: list[list] = [[(s["start"], s["end"]) for s in (x or {}).get("spans") or ()] for x in earlier]
                for d, its, s, n in hits(shard, base, own):
                    items_of[d].update(own.ids[i] for i in its)
                    spans_of[d].append((s, s + n))
                n_words = np.diff(base) - GAP
                now = [{"n_words": int(n), "items": sorted(i, key=lambda x: x.encode()), "spans": [{"start": x, "end": y} for x, y in merged(s)]} for n, i, s in zip(n_words, items_of, spans_of, strict=True)]
                yield [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(now, old.type)]

        rows = docs if before is None else before
        return K.map_arrow(rows, run, rows.schema)

    return passes(items, window, item_id, item_text, max_part_bytes, one_pass)[-1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, spans, contaminated. The index is written to `path` (a new one in the shared folder) and read from there."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "positional-index")
    build_index(docs, id_col, text_col).write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    rows = document_hits(spark.read.parquet(path), items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that a window of an item occurs in, told by the stored index. Its columns and only these."""
    spark = docs.sparkSession
    rows, mark = K.marked(docs)
    (hit,) = K.fresh(rows.columns, "__hit")
    found = decontaminate(rows, items, path := shared_path(spark, "positional-index"), id_col=mark, text_col=text_col, **options).where("contaminated")
    # What was hit is written, so the index may go.
    found = cut(found.select(F.col(mark).alias(hit)).distinct())
    remove(spark, path)
    return rows.join(found, F.col(mark) == F.col(hit), "left_anti").drop(mark)
