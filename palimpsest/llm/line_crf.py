"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad. A line's own shape and that of the lines before and after it give its
score, a transition score ties neighbouring labels. The labels that we learn from are of documents, so every line of a labelled
document is taken to have its label. Forward-backward gives each line's marginal of being good; a document's score is
their mean, weighted by the lines' lengths.

The model is fitted on at most about `TRAIN_DOCS` labelled documents and at most `TRAIN_LINES` lines in all (documented bounds of the sample), chosen by a hash of the id;
of documents with over a twentieth of these lines none are learnt from. Their line features are what the driver gathers (600 bytes a line). Scoring is one narrow pass over all documents.

Defined results: a null or empty text is one line without words and is scored as such; blank lines between others don't
count; repeated rows get repeated results; a document labelled twice counts as bad if either says so; null labels aren't learnt from; without
both labels every score is the share of good ones (1 if there are none); an empty table gives no rows. Only the text is
an input; other columns aren't read. Features of texts of very many lines are made in runs of lines, and only three numbers a line are kept; a line itself is a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K

#: Bound of the fitting sample, documents.
TRAIN_DOCS = 6_000
#: Bound of the fitting sample, lines; a document with more than a twentieth of them isn't learnt from.
TRAIN_LINES = 100_000
#: Lines whose features are held at once.
RUN_LINES = 20_000
EPOCHS = 150
RATE = 0.1
DECAY = 1e-3

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SETS = {
    "symbols": b"#*$%&<>|@^~\\{}[]=_+",
    "bars": b"|",
    "bangs": b"!?",
    "digits": b"0123456789",
    "commas": b",;:",
    "stops": b".",
}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _SETS.items()}
#: Ratios are also looked at by whether they exceed these.
_STEPS = (0.05, 0.2, 0.5)
RATIOS = (*_SETS, "upper", "beyond_ascii", "repeated_words", "next_word_same", "long_words")
OWN = len(RATIOS) * (1 + len(_STEPS)) + 5
#: Where the own features say that the text had this line before.
SEEN = OWN - 3
#: The line's own features, those of the lines before and after (0 where there are none), whether there are any, and a constant.
WIDTH = 3 * OWN + 3


def own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: their own features, sizes (bytes), texts and hashes."""
    starts, ends, _ = K.spans(data, offsets, _LINE)
    word_starts, word_ends, _ = K.spans(data, offsets, K.PLAIN)
    line_of = np.searchsorted(starts, word_starts, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    full = np.flatnonzero(n_words)
    renumber = np.full(len(starts), -1)
    renumber[full] = np.arange(len(full))
    starts, ends, n_words, line_of = starts[full], ends[full], n_words[full], renumber[line_of]
    n = len(full)
    if not n:
        return np.zeros((0, OWN), np.float32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(float)

    size = (ends - starts).astype(float)
    hashes = K.span_hashes(data, word_starts, word_ends)
    order = np.lexsort((hashes, line_of))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    repeated = np.bincount(line_of[order][again], minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    upper = (data >= 0x41) & (data <= 0x5A)
    if len(data) > 1:
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    ratios = [
        *(per_line(t[data]) / size for t in _TABLES.values()),
        per_line(upper) / size,
        per_line(data >= 0x80) / size,
        repeated / np.maximum(1, n_words),
        np.bincount(line_of[same], minlength=n) / np.maximum(1, n_words),
        np.bincount(line_of[word_ends - word_starts > 12], minlength=n) / np.maximum(1, n_words),
    ]
    line_hash = K.span_hashes(data, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((np.arange(n), line_hash, doc))
    seen = np.zeros(n, bool)
    seen[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    columns = [r > s for r in ratios for s in _STEPS] + ratios
    columns += [np.log1p(n_words) / 5, n_words < 5, seen, np.minimum(size / np.maximum(1, n_words), 30) / 10, np.ones(n)]
    return np.stack(columns, axis=1).astype(np.float32), size, doc, line_hash


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with words, the weight (bytes) of each, and the first line of each text. A text without such a line has one of zeros."""
    own, size, doc, _ = own_features(data, offsets)
    n = len(own)
    # A text without words keeps its place as one line of zeros.
    counts = np.bincount(doc, minlength=len(offsets) - 1) if n else np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, counts))])
    at = np.arange(n) + (np.cumsum(counts == 0) - (counts == 0))[doc] if n else np.zeros(0, np.int64)
    rows = np.zeros((first[-1], OWN), np.float32)
    weight = np.ones(first[-1])
    rows[at], weight[at] = own, size
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    heads, tails = np.ones((first[-1], 1), np.float32), np.ones((first[-1], 1), np.float32)
    before[first[:-1]], heads[first[:-1]] = 0, 0
    after[first[1:] - 1], tails[first[1:] - 1] = 0, 0
    return np.hstack([rows, before, after, heads, tails, np.ones_like(heads)]), weight, first


@dataclass
class Crf:
    """weights: of a line's features for "good" against "bad". stay: log score of two neighbouring lines with one label. share: of good documents."""

    weights: np.ndarray
    stay: float
    share: float
    fitted: bool = True


def chains(score: np.ndarray, first: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good", the probability that each line has its predecessor's label (0 at heads), and each text's log normaliser, all by forward-backward.

    Texts are taken side by side, the longest first: step t advances all that have a line t. Only the log odds of good against bad are
    carried: forward f(t) = s(t) + m(f(t-1)), where m(x) = log((e^(x+stay) + 1) / (e^x + e^stay)) is what a neighbour's odds say about a line."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    base = first[:-1][order]
    alive = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), "left") if len(n) else []
    pass_on = lambda x: np.logaddexp(x + stay, 0) - np.logaddexp(x, stay)
    forward, backward, together = np.zeros(len(score)), np.zeros(len(score)), np.zeros(len(score))
    log_z = np.zeros(len(n))
    for t, k in enumerate(alive):
        at = base[:k] + t
        if t:
            came = forward[at - 1]
            # The sum over both labels of the line before, for a bad line: what the odds leave out.
            log_z[order[:k]] += np.logaddexp(came, stay)
            forward[at] = score[at] + pass_on(came)
        else:
            forward[at] = score[at]
    log_z += np.logaddexp(forward[first[1:] - 1], 0) if len(n) else 0
    for t in range(len(alive) - 2, -1, -1):
        at = base[: alive[t + 1]] + t
        backward[at] = pass_on(score[at + 1] + backward[at + 1])
        same = np.logaddexp(forward[at] + stay + score[at + 1] + backward[at + 1], stay)
        differ = np.logaddexp(forward[at], score[at + 1] + backward[at + 1])
        together[at + 1] = 1 / (1 + np.exp(np.clip(differ - same, -60, 60)))
    odds = np.clip(forward + backward, -60, 60)
    return 1 / (1 + np.exp(-odds)), together, log_z


def forward_odds(score: np.ndarray, stay: float) -> np.ndarray:
    """f(t) = s(t) + m(f(t-1)) of one long chain, in about two times the square root of its length steps.

    In odds, a step is a fraction of two linear terms, so steps compose as 2 x 2 matrices. The chain is cut into runs that are walked side by side: once for the matrix of each run, then, with
    what comes into each run, for the odds."""
    n = len(score)
    width = max(1, int(np.ceil(n**0.5)))
    runs = -(-n // width)
    padded = np.zeros(runs * width)  # runs are columns of s, the last one is filled up
    padded[:n] = score
    s = padded.reshape(runs, width).T
    a = np.exp(stay)
    matrix = np.tile(np.eye(2), (runs, 1, 1))
    for t in range(width):
        up = np.clip(s[t], -300, 300)
        top = np.exp(up)[:, None] * (a * matrix[:, 0] + matrix[:, 1])
        low = matrix[:, 0] + a * matrix[:, 1]
        matrix = np.stack([top, low], axis=1)
        matrix /= matrix.max(axis=(1, 2), keepdims=True)
    came = np.zeros(runs)
    odds = np.array([1.0, 1.0])  # the first line has no line before: even odds pass on nothing
    for r in range(runs):
        came[r] = np.log(max(odds[0], 1e-300)) - np.log(max(odds[1], 1e-300))
        odds = matrix[r] @ odds
        odds /= odds.max()
    out = np.zeros((width, runs))
    for t in range(width):
        came = s[t] + np.logaddexp(came + stay, 0) - np.logaddexp(came, stay)
        out[t] = came
    return out.T.ravel()[:n]


class Seen:
    """Hashes met so far, in sorted arrays of rising size."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def meet(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each was met before; they are met now."""
        known = np.zeros(len(hashes), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, hashes), len(level) - 1)
            known |= level[at] == hashes
        new = np.unique(hashes[~known])
        while self.levels and len(new) and len(self.levels[-1]) <= len(new):
            new = np.union1d(self.levels.pop(), new)
        if len(new):
            self.levels.append(new)
        return known


def long_text(data: np.ndarray, model: Crf, run_lines: int) -> tuple[float, int, int]:
    """Score, lines and bad lines of one text of many lines. Features are made of `run_lines` lines at a time, and only what they weigh for the line itself and its neighbours stays."""
    ends = np.append(np.flatnonzero(data == 0x0A)[run_lines - 1 :: run_lines] + 1, len(data))
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    seen, x = Seen(), 0
    weights = model.weights[: 3 * OWN].reshape(3, OWN).T
    for y in ends.tolist():
        own, size, _, hashes = own_features(data[x:y], np.array([0, y - x]))
        own[:, SEEN] = np.maximum(own[:, SEEN], seen.meet(hashes))
        # Half the width will do for what many millions of lines keep.
        parts.append((own @ weights).astype(np.float32))
        sizes.append(size.astype(np.float32))
        x = y
    own, before, after = np.concatenate(parts).T
    weight = np.concatenate(sizes)
    del parts, sizes
    n = len(weight)
    if not n:
        own, before, after, weight, n = np.zeros(1), np.zeros(1), np.zeros(1), np.ones(1), 1
    head, tail, constant = model.weights[3 * OWN :]
    score = own.astype(np.float64) + constant
    score[1:] += before[:-1] + head
    score[:-1] += after[1:] + tail
    del own, before, after
    if not model.fitted:
        return model.share, n, n if model.share < 0.5 else 0
    odds = forward_odds(score, model.stay) + forward_odds(score[::-1], model.stay)[::-1] - score
    marginal = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return float(marginal @ weight / weight.sum(dtype=np.float64)), n, int((marginal < 0.5).sum())


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray, epochs: int = EPOCHS) -> Crf:
    """Maximum conditional likelihood by Adam; gradients are observed less expected counts from forward-backward."""
    share = float(good.mean()) if len(good) else 1.0
    if not len(good) or good.min() == good.max():
        return Crf(np.zeros(WIDTH), 0.0, share, False)
    label = np.repeat(good, np.diff(first)).astype(float)
    inner = np.ones(len(label), bool)
    inner[first[:-1]] = False
    theta = np.zeros(WIDTH + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Each document counts once, whatever its number of lines.
    weight = np.repeat(1 / np.diff(first), np.diff(first)) / len(good)
    for step in range(1, epochs + 1):
        marginal, together, _ = chains(features @ theta[:-1], first, theta[-1])
        gradient = np.append(features.T @ (weight * (label - marginal)), (weight * (inner - together)).sum()) - DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[:-1], float(theta[-1]), share)


def fold_of(id_col: str) -> Column:
    """The remainder that decides what is held out: 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Crf:
    """Fit on the labelled documents outside the held-out fold. The ids of the bounded sample are broadcast, so that documents aren't shuffled."""
    rows = labels.where(F.col(label_col).isNotNull() & (fold_of(id_col) != 0))
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < int(1e6 * train_docs / n))
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__good"))
    draw = F.xxhash64(F.col(id_col).cast("string"))
    n_lines = F.coalesce(F.regexp_count(F.col(text_col), F.lit("\n")), F.lit(0)) + 1
    # Only the id and the text, under names of our own: a table may have columns of these names.
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), draw.alias("__draw"), n_lines.alias("__lines"))
    sample = texts.join(F.broadcast(rows), "__id").where(F.col("__lines") <= train_lines // 20)
    # One number of lines for each document of the sample: those first by the hash that fit.
    total, last = 0, None
    for d, n in sorted(tuple(r) for r in sample.select("__draw", "__lines").collect()):
        if total + n > train_lines:
            break
        total, last = total + n, d
    sample = sample.where(F.lit(False) if last is None else F.col("__draw") <= last).select("__good", "__text")

    def run(batch: pa.RecordBatch):
        for a, b, data, offsets in K.text_blocks(batch.column(1)):
            x, _, first = line_features(data, offsets)
            yield [batch.column(0).slice(a, b - a), K.lists(x.ravel(), first * WIDTH, pa.float32())]

    parts = K.map_arrow(sample, run, K.schema(good="int", x="array<float>")).toArrow()
    # The same documents in the same order, whatever the partitions were.
    lengths = np.array([len(v) // WIDTH for v in parts["x"]], np.int64)
    flat = parts["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if len(lengths) else np.zeros((0, WIDTH))
    good = parts["good"].to_numpy()
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    order = sorted(range(len(good)), key=lambda k: (int(good[k]), int(lengths[k]), flat[first[k] : first[k + 1]].tobytes()))
    rows_of = K.concat_rows(np.arange(first[k], first[k + 1]) for k in order)
    return fit(flat[rows_of].astype(np.float64), np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64), good[order])


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES) -> DataFrame:
    """id, score (length-weighted mean of the lines' marginals), n_lines, n_bad_lines (marginals under one half)."""
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString(), "score": "double", "n_lines": "bigint", "n_bad_lines": "bigint"})
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        own: Crf = known.value
        for a, _, data, offsets in K.text_blocks(batch.column(1)):
            n_lines = np.diff(np.searchsorted(np.flatnonzero(data == 0x0A), offsets)) + 1
            total = np.concatenate([[0], np.cumsum(n_lines)])
            x = 0
            while x < len(n_lines):
                y = max(x + 1, int(np.searchsorted(total, total[x] + run_lines, "right")) - 1)
                ids = batch.column(0).slice(a + x, y - x)
                if total[y] - total[x] > run_lines:
                    mean, n, bad = ([v] for v in long_text(data[offsets[x] : offsets[y]], own, run_lines))
                else:
                    rows, weight, first = line_features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    marginal = chains(rows @ own.weights, first, own.stay)[0] if own.fitted else np.full(len(rows), own.share)
                    mean = np.add.reduceat(marginal * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                    n, bad = np.diff(first), np.add.reduceat((marginal < 0.5).astype(np.int64), first[:-1])
                yield [ids, pa.array(np.clip(mean, 0, 1), pa.float64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())]
                x = y

    return K.map_arrow(docs.select(id_col, text_col), run, out)
