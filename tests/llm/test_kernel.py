import numpy as np

from palimpsest.llm import kernel as K


def test_hashes_in_pieces_are_the_same(monkeypatch):
    text = b"a bb ccc " * 40 + b"x" * 300 + b" y zz"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.PLAIN)
    whole = K.span_hashes(data, starts, ends)
    for size in (7, 64, 255):
        monkeypatch.setattr(K, "PIECE_BYTES", size)
        assert (K.span_hashes(data, starts, ends) == whole).all()
    words = text.split()
    assert len(set(whole.tolist())) == len(set(words))
    assert all((whole[a] == whole[b]) == (words[a] == words[b]) for a in range(len(words)) for b in range(a))


def test_shingles_by_brute_force():
    texts = [list("abcdefg"), [], list("abc"), list("abcde"), list("zabcde")]
    hashes = np.array([ord(w) for t in texts for w in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    made, bounds = K.shingles(hashes, first, 5)
    want = [[tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))] if t else [] for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    flat = [s for w in want for s in w]
    assert all((made[a] == made[b]) == (flat[a] == flat[b]) for a in range(len(flat)) for b in range(a))


def test_fresh_names():
    assert K.fresh(["__A", "b"], "__a", "b", "c", "c") == ["__a_", "b_", "c", "c_"]
