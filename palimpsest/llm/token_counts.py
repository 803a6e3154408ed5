"""Token counts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have together.
Tier one is a compact table, broadcast: the token counts of the most frequent pre-tokens of the corpus. Tier
two is a cache in each Python worker of two generations: what is looked up moves to the young one, and when that is full it
becomes the old one, so words in use stay. The misses of a few MB of text together go to the library in one call.
Pre-tokens are never shuffled: to find the frequent ones each task sums its own and emits only its heaviest,
so what is exchanged is bounded by tasks, and the table by its size and the length of its words.

The table only speeds counting up: counts are exact whatever it holds. Characters that the library's Unicode tables
class otherwise than the pattern's here are found once on the driver; texts that hold one are cut by the library itself.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside a text count as the
library's default has them, as one token each; a very long text is taken in pieces that end before a single space between
letters or digits, where a pre-token always ends; repeated rows give repeated results; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernel as K

#: The pre-tokeniser's pattern of byte-level BPE vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_SIZE = 1 << 16
PER_TASK = 1 << 14
TASK_ENTRIES = 1 << 18
CACHE_ENTRIES = 1 << 18
#: Pre-tokens with more characters are neither in the table nor remembered, so that both have a size.
LONGEST = 64
#: Characters of text whose misses go to the library together, and of a piece of a long text.
GROUP_CHARS = 1 << 21
PIECE_CHARS = 1 << 20

#: Per worker process: the loaded encoders, and the second tier.
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The library's tokenizer, by pre-token."""

    def __init__(self, file: str, odd: str = ""):
        import regex
        from tokenizers import Tokenizer

        # A task has one core: threads of the library would only take them from others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said["model"]["type"] != "BPE" or said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{file}: not a byte-level BPE without normaliser, whose counts add up over pre-tokens")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said.get("added_tokens", [])):
            raise ValueError(f"{file}: added tokens that take what stands beside them are not supported")
        self.tokenizer = Tokenizer.from_file(file)
        self.find = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in said.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.odd = frozenset(odd)
        self.odd_in_latin = any(c < "\u0100" for c in odd)
        self.whole = any(" " in t for t in special)
        self.between = regex.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def is_odd(self, text: str) -> bool:
        """Whether a character of the text is classed otherwise by the library. Texts of Latin-1 are told by their encoding alone."""
        if not self.odd or (text.isascii() and not self.odd_in_latin):
            return False
        if not self.odd_in_latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return False
        return not self.odd.isdisjoint(text)

    def cut(self, text: str) -> list[str]:
        if self.is_odd(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of added tokens between them."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return self.cut(text), 0
        return [t for part in self.special.split(text) for t in self.cut(part)], n

    def pieces(self, text: str) -> Iterator[str]:
        """The text, cut where a pre-token ends in any case."""
        at = 0
        while not self.whole and len(text) - at > PIECE_CHARS and (m := self.between.search(text, at + PIECE_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def remembered(self, words: set[str], entries: int) -> dict[str, int]:
        """The lengths of these words, from the caches as far as they have them."""
        out, unknown = {}, []
        for w in words:
            n = self.young.get(w)
            if n is None and (n := self.old.get(w)) is not None:
                self.young[w] = n
            if n is None:
                unknown.append(w)
            else:
                out[w] = n
        if unknown:
            made = dict(zip(unknown, self.lengths(unknown), strict=True))
            out |= made
            self.young.update((w, n) for w, n in made.items() if len(w) <= LONGEST)
        if len(self.young) > entries:
            self.old, self.young = self.young, {}
        return out


def encoder(file: str, odd: str = "") -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file, odd)
    return _encoders[file]


@functools.cache
def odd_characters(file: str, chunk: int = 512) -> str:
    """Characters that the pattern and the library cut differently, by trying each after a letter, a number, a sign and a space.

    Planes 4 to 13 hold no characters and 15 and 16 private ones, which all tables class alike."""
    plain = Encoder(file)
    differ = lambda text: plain.find(text) != [text[a:b] for _, (a, b) in plain.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    probe = lambda codes: "".join(f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}a" for c in codes if not 0xD800 <= c < 0xE000)
    chunks = [range(first, first + chunk) for plane in (0, 1, 2, 3, 14) for first in range(plane << 16, (plane + 1) << 16, chunk)]
    return "".join(chr(c) for codes in chunks if differ(probe(codes)) for c in codes if differ(probe([c])))


def frequent(docs: DataFrame, file: str, text_col: str = "text", size: int = TABLE_SIZE) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of all texts and their numbers of tokens.

    A task keeps counts of up to TASK_ENTRIES pre-tokens (beyond that the rarer half goes) and emits its PER_TASK heaviest."""

    odd = odd_characters(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, odd)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in own.pieces(text) if text else ():
                    seen.update(own.pre_tokens(piece)[0])
                    if len(seen) > TASK_ENTRIES:
                        seen = Counter(dict(seen.most_common(TASK_ENTRIES // 2)))
        for w in [w for w in seen if len(w) > LONGEST]:
            del seen[w]
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = K.bounded_batches(docs.select(text_col)).mapInArrow(run, K.schema(word="string", n="bigint"))
    words = [r[0] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()]
    return list(zip(words, encoder(file).lengths(words), strict=True)) if words else []


def token_counts(docs: DataFrame, file: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, and n_misses: pre-tokens of the document that the broadcast table lacked."""
    table = docs.sparkSession.sparkContext.broadcast(dict(frequent(docs, file, text_col, table_size)))
    out = K.schema(**{id_col: docs.schema[id_col].dataType.simpleString(), "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean", "n_misses": "bigint"})

    odd = odd_characters(file)

    def run(batch: pa.RecordBatch):
        own, first = encoder(file, odd), table.value
        n = batch.num_rows
        n_bytes, n_tokens, n_misses = [0] * n, [0] * n, [0] * n
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            known = own.remembered({w for _, words in waiting for w in words}, cache_entries)
            for row, words in waiting:
                n_tokens[row] += sum(map(known.__getitem__, words))
            waiting.clear()

        for row, text in enumerate(batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            n_bytes[row] = len(text.encode())
            for piece in own.pieces(text):
                words, n_special = own.pre_tokens(piece)
                found = list(map(first.get, words))
                if None in found:
                    misses = [w for w, k in zip(words, found, strict=True) if k is None]
                    n_misses[row] += len(misses)
                    waiting.append((row, misses))
                    n_tokens[row] += n_special + sum(filter(None, found))
                else:
                    n_tokens[row] += n_special + sum(found)
                held += len(piece)
                if held > GROUP_CHARS:
                    settle()
                    held = 0
        settle()
        yield [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([k > limit for k in n_tokens], pa.bool_()), pa.array(n_misses, pa.int64())]

    return K.map_arrow(docs.select(id_col, text_col), run, out)
