"""Licence scans by the Dice coefficient of word bigrams.

A text is normalised (lower case, letters and digits only) and looked at in units: each line, each paragraph (lines up to a blank one), the whole
text, and, wherever they stand, windows of as many words as a template has. A unit is compared with the licence templates by Dice over bags of word bigrams: twice the
common ones over the sum of both sizes. A template can only reach the threshold t if its size lies between
t / (2 - t) and (2 - t) / t times the unit's, so units meet only the templates within those bounds, and only if they share a bigram; windows are only
slid over the places of a template's bigrams, and only if the text has enough of these together. So a notice is found in comments, inside a longer paragraph, or broken over lines.

Of matches that overlap the best stays: by Dice, then by length, then by name, so that a licence's notice isn't also counted as that of a sister licence.

One narrow pass; the templates are part of the program, so what each task holds has a fixed size.

Defined results: null and empty texts have no unit and no licence; of equal scores the longer match and then the template first by name is named; repeated rows get repeated
results; very long texts are one sequence of words; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import kernel as K
from palimpsest.llm.license_templates import TEMPLATES

THRESHOLD = 0.8

_WORD = re.compile(r"[^\W_]+")

#: dice, number of words, name, first word, word after the last
Match = tuple[float, int, str, int, int]


def bag_of(words: list[str]) -> Counter:
    """Bag of bigrams of normalised words; a single word is its own."""
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([(w, "") for w in words])


def _rank(m: Match) -> tuple:
    return -m[0], -m[1], m[2], m[3]


def apart(matches: list[Match]) -> list[Match]:
    """The best of matches that overlap, by their places."""
    out: list[Match] = []  # by place
    starts: list[int] = []
    for m in sorted(matches, key=_rank):
        k = bisect_left(starts, m[3])
        if (k == 0 or out[k - 1][4] <= m[3]) and (k == len(out) or m[4] <= starts[k]):
            out.insert(k, m)
            starts.insert(k, m[3])
    return out


class Templates:
    """Bags by size, and which templates have a bigram."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        bags = [(name, bag_of(_WORD.findall(t.lower()))) for name, texts in sorted(templates.items()) for t in texts]
        self.bags = sorted(((b.total(), name, b) for name, b in bags), key=lambda x: x[:2])
        self.threshold = threshold
        self.least = min(n for n, _, _ in self.bags) * threshold / (2 - threshold)
        self.most = max(n for n, _, _ in self.bags) * (2 - threshold) / threshold
        self.words = {w for _, _, b in self.bags for g in b for w in g}
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, _, b) in enumerate(self.bags):
            for g in b:
                self.having[g].append(k)

    def best(self, words: list[str], start: int) -> Match | None:
        """The best template that the unit as a whole reaches the threshold with."""
        n = max(1, len(words) - 1)
        # A unit within the bounds shares at least threshold / 2 of its bigrams, so it can't lack most of the words.
        if not words or not self.least <= n <= self.most or sum(w in self.words for w in words) * 2 < self.threshold * n:
            return None
        bag = bag_of(words)
        low, high = n * self.threshold / (2 - self.threshold), n * (2 - self.threshold) / self.threshold
        found = None
        for size, name, other in self.bags:
            if low <= size <= high:
                dice = 2 * sum(min(c, other[g]) for g, c in bag.items() if g in other) / (n + size)
                if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[2])):
                    found = (dice, len(words), name, start, start + len(words))
        return found

    def windows(self, words: list[str]) -> list[Match]:
        """Windows of a template's number of words that reach the threshold with it, the best of those that overlap."""
        places: dict[int, list[int]] = defaultdict(list)
        for x, g in enumerate(zip(words, words[1:], strict=False)):
            if g in self.having:
                for k in self.having[g]:
                    places[k].append(x)
        out = []
        for k, at in places.items():
            size, name, bag = self.bags[k]
            if len(at) < self.threshold * size:
                continue
            inside: Counter = Counter()
            common, lo, found = 0, 0, []
            for hi, x in enumerate(at):
                g = words[x], words[x + 1]
                common += inside[g] < bag[g]
                inside[g] += 1
                while at[lo] <= x - size:
                    gone = words[at[lo]], words[at[lo] + 1]
                    inside[gone] -= 1
                    common -= inside[gone] < bag[gone]
                    lo += 1
                if common >= self.threshold * size:
                    found.append((common / size, size + 1, name, at[lo], min(len(words), at[lo] + size + 1)))
            out += found
        return out

    def matches(self, text: str) -> list[Match]:
        """The matches of a text that don't overlap, by their places. Words don't run over line ends, so they are cut once; longer units than any template allows aren't put together."""
        lines = [_WORD.findall(x) for x in text.lower().split("\n")]
        words = [w for x in lines for w in x]
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x))
        units = [(a, b) for a, b in zip(starts, starts[1:], strict=False) if b > a]
        first = None
        for k, x in enumerate([*text.split("\n"), ""]):
            if x.strip():
                first = k if first is None else first
            elif first is not None:
                units.append((starts[first], starts[k]))
                first = None
        units.append((0, len(words)))
        found = [m for a, b in dict.fromkeys(units) if b - a <= self.most + 1 and (m := self.best(words[a:b], a))]
        return apart(found + self.windows(words))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the best match, null if none reaches the threshold), dice, n_matches (that don't overlap), licenses (all, sorted)."""
    known = Templates(templates or TEMPLATES, threshold)
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString(), "license": "string", "dice": "double", "n_matches": "bigint", "licenses": "array<string>"})

    def run(batch: pa.RecordBatch):
        columns: tuple[list, ...] = ([], [], [], [])
        for text in batch.column(1):
            found = known.matches(text.as_py() or "")
            dice, _, name, _, _ = min(found, key=_rank) if found else (None,) * 5
            for column, value in zip(columns, (name, dice, len(found), sorted({m[2] for m in found})), strict=True):
                column.append(value)
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()))
        yield [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]

    return K.map_arrow(docs.select(id_col, text_col), run, out)
