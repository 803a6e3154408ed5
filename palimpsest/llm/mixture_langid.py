"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of folded text, learnt from labelled rows. A document is
a mixture of languages: expectation-maximisation estimates their proportions from the likelihoods of its
trigrams. The set of languages is selected by penalised likelihood: from the best single language, that whose
first bit of weight would raise the likelihood most is added for as long as the gain exceeds the penalty.

Learning counts trigrams per task, and only sums of counts per language and bucket reach the driver (languages x
`BUCKETS` numbers). At most about `TRAIN_DOCS` rows per language are learnt from, chosen by a hash of the text; predicting reads all rows once, without an exchange.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if nothing could be learnt; rows of null
language or null id aren't learnt from; repeated rows get repeated results; equal likelihoods go to the language first by code point;
an empty table gives no rows. Only text, and for learning the language, are inputs; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K

BITS = 14
BUCKETS = 1 << BITS
#: Bound of the learning sample, rows per language.
TRAIN_DOCS = 20_000
SMOOTHING = 0.5
#: Trigrams overlap, so about three of them are one observation; half a log of the sample size for each language more, times this.
PENALTY = 3.0
STEPS = 25

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; all other ASCII is space."""
    out = _FOLD[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def trigrams(text: np.ndarray) -> np.ndarray:
    """Counts by bucket of the trigrams of a folded text, with a space at each end and runs of spaces as one."""
    padded = np.full(len(text) + 2, 0x20, np.uint8)
    padded[1:-1] = text
    space = padded == 0x20
    padded = padded[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    if len(padded) < 3:
        return np.zeros(BUCKETS, np.int64)
    gram = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    return np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    #: log p(bucket | language), languages x buckets.
    logs: np.ndarray


def fold_of(id_col: str) -> Column:
    """The remainder that decides what is held out: 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    rows = docs.where(F.col(lang_col).isNotNull() & (fold_of(id_col) != 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    # The share of each language, in millionths of the hash's range.
    large = {k: int(1e6 * train_docs / n) for k, n in sizes.items() if n > train_docs}
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    for lang, share in large.items():
        rows = rows.where((F.col("lang") != lang) | (draw < share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in K.text_blocks(batch.column(1)):
                data = folded(data)
                for i in range(b - a):
                    found = trigrams(data[offsets[i] : offsets[i + 1]])
                    totals[langs[a + i]] = totals[langs[a + i]] + found if langs[a + i] in totals else found
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "bucket", "n"])

    counts = K.bounded_batches(rows).mapInArrow(count, K.schema(lang="string", bucket="int", n="bigint")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    place = {x: k for k, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    for r in counts.toLocalIterator():
        table[place[r["lang"]], r["bucket"]] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def proportions(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Maximum-likelihood proportions of the rows of p over trigrams with counts n, and the log likelihood."""
    share = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(steps):
        mixed = share @ p
        new = share * (p @ (n / mixed)) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(share @ p))


def infer(model: Model, counts: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """Languages of a document, by place, and their proportions."""
    at = np.flatnonzero(counts)
    n = counts[at].astype(float)
    logs = model.logs[:, at]
    alone = logs @ n
    chosen, share = [int(alone.argmax())], np.ones(1)
    p = np.exp(logs - logs.max(axis=0))  # a common factor per trigram changes no proportion
    best = float(n @ np.log(p[chosen[0]]))
    price = penalty * 0.5 * np.log(max(2.0, n.sum()))
    while len(chosen) < len(p):
        pull = p @ (n / (share @ p[chosen]))
        pull[chosen] = 0
        more = int(pull.argmax())
        if pull[more] <= n.sum():
            break
        tried, value = proportions(p[[*chosen, more]], n)
        if value - best <= price:
            break
        chosen, share, best = [*chosen, more], tried, value
    return chosen, share


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def _predict(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[str, float, list[str], list[float]]]]]:
    strings = texts.to_pylist()
    for a, b, data, offsets in K.text_blocks(texts):
        data = folded(data)
        rows = []
        for i in range(b - a):
            if not model.languages or not has_letter(strings[a + i]):
                rows.append(("und", 0.0, [], []))
                continue
            chosen, share = infer(model, trigrams(data[offsets[i] : offsets[i + 1]]))
            order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
            rows.append((model.languages[chosen[order[0]]], float(min(1.0, share[order[0]])), [model.languages[chosen[k]] for k in order], [float(share[k]) for k in order]))
        yield a, b, rows


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred (that of the largest proportion), score (its proportion), languages, proportions."""
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString(), "lang_pred": "string", "score": "double", "languages": "array<string>", "proportions": "array<double>"})
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for a, b, rows in _predict(known.value, batch.column(1)):
            lang, score, langs, shares = zip(*rows, strict=True)
            yield [batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]

    return K.map_arrow(docs.select(id_col, text_col), run, out)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without those that are in no language, or in none by `least` of their trigrams. Its columns and only these."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        for a, b, rows in _predict(known.value, batch.column(at)):
            keep = pa.array([lang != "und" and score >= least for lang, score, _, _ in rows], pa.bool_())
            yield batch.slice(a, b - a).filter(keep).columns

    return K.map_arrow(docs, run, docs.schema)
