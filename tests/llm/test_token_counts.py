from collections import Counter

import pytest
from tokenizers import Tokenizer

from palimpsest.llm import token_counts as C
from palimpsest.llm.queries import tokenizer_file

from .fixtures import documents, frame


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def test_counts_are_the_librarys(spark, sf, library):
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1])) for r in documents())
    for options in ({}, {"table_size": 3, "cache_entries": 10}):
        got = C.token_counts(frame(spark, clash=True), tokenizer_file(), **options).collect()
        assert Counter(tuple(r)[:3] for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(docs, tokenizer_file()).collect()}
    assert got == {r["doc_id"]: count(r["text"]) for r in docs.collect()}


def test_every_character_is_cut_as_the_library_does(library):
    own = C.Encoder(tokenizer_file(), C.odd_characters(tokenizer_file()))
    for first in range(0, 0x110000, 256):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}'s " for c in range(first, first + 256) if not 0xD800 <= c < 0xE000)
        if text:
            assert own.cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(first)


def test_empty_table(spark):
    assert C.token_counts(frame(spark, []), tokenizer_file()).count() == 0


def test_long_texts_in_pieces_and_small_caches(spark, library, monkeypatch):
    monkeypatch.setattr(C, "PIECE_CHARS", 50)
    own = C.Encoder(tokenizer_file())
    texts = [r[1] for r in documents() if r[1]] + ["x" * 500 + " y" * 300, "日本語 " * 100, "a<|endoftext|>b c " * 40, "don't  stop\n\n now 12 34  " * 30, "tab\ta b c d " * 40]
    for text in texts:
        parts = list(own.pieces(text))
        assert "".join(parts) == text
        words = [w for part in parts for w in own.pre_tokens(part)[0]]
        assert words == own.pre_tokens(text)[0]
        for entries in (1, 7, 1000):
            known = own.remembered(set(words), entries)
            total = sum(known[w] for w in words) + own.pre_tokens(text)[1]
            assert total == len(library.encode(text, add_special_tokens=False).ids)
    assert all(len(w) <= C.LONGEST for w in own.young) and own.old
