import random

import numpy as np
import pyarrow as pa
from corpus import odd_rows, words as plain

from lanewise.llm import _text


def test_words_are_those_of_the_pattern():
    texts = [r[1] for r in odd_rows()] + ["A-b_c1é", "ÀÉ x", "a\x00b", "\x7fz{", "9:;@[`~"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    w = _text.words(column)
    every = {}
    for i, text in enumerate(texts):
        found = w.hash[w.bounds[i] : w.bounds[i + 1]].tolist()
        assert len(found) == len(plain(text))
        assert (w.text[w.bounds[i] : w.bounds[i + 1]] == i).all()
        for word, code in zip(plain(text), found, strict=True):
            assert every.setdefault(word, code) == code
    assert len(set(every.values())) == len(every)


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(_text, "SLICE_BYTES", 50)
    rng = random.Random(2)
    texts = [rng.choice([None, "", "x" * rng.randrange(120)]) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    parts = list(_text.slices(batch, 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 50 for p in parts)
    assert not list(_text.slices(batch.slice(0, 0), 0))


def test_empty_column():
    w = _text.words(pa.array([], pa.string()))
    assert len(w.hash) == 0 and w.bounds.tolist() == [0]
    assert len(_text.grams(np.zeros(3, np.uint64), 5)) == 0


def test_words_in_slices(monkeypatch):
    """Words, also long ones, are the same wherever slices are cut."""
    rng = random.Random(4)
    texts = [" ".join("abé"[rng.randrange(3)] * rng.choice([1, 3, 9, 17, 700]) for _ in range(rng.randrange(6))) for _ in range(30)] + [None, "", "A" * 9000 + " b"]
    whole = _text.words(pa.array(texts), places=True)
    monkeypatch.setattr(_text, "SLICE_BYTES", 7)
    cut = _text.words(pa.array(texts), places=True)
    for name in ("hash", "bounds", "text", "start", "size"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    flat = [x for t in texts for x in plain(t)]
    assert len({*flat}) == len({*whole.hash.tolist()}) and [len(x.encode()) for x in flat] == whole.size.tolist()


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_thue_morse_words_differ():
    """A sum of letters times powers, modulo 2 ** 64, is the same for these words, whatever the base."""
    for n in (64, 256, 1024, 4096):
        a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
        assert len({*_text.words(pa.array([f"{a} {b}", "ab" * (n // 2)])).hash.tolist()}) == 3
