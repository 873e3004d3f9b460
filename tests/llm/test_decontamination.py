"""Matches against brute force, hot passages and long texts."""

import random
import time

import numpy as np
import pyarrow as pa

import plain
from annalist.llm import decontaminate
from annalist.llm.arrays import ALNUM, AS_IS, LOWER, NOT_SPACE, SLICE_BYTES, words

ALL = ("n_words", "n_hit", "n_items", "items", "matches")


def plain_matches(own, theirs, window):
    """(word, item word, length) of the maximal matches on each diagonal, from the item's windows."""
    width, out = min(window, len(theirs)), []
    if not width:
        return out
    for d in range(-len(theirs), len(own) + 1):
        run = [i for i in range(len(own) - width + 1) if 0 <= i - d <= len(theirs) - width and own[i : i + width] == theirs[i - d : i - d + width]]
        while run:
            k = 1
            while k < len(run) and run[k] == run[k - 1] + 1:
                k += 1
            out.append((run[0], run[0] - d, run[k - 1] + width - run[0]))
            run = run[k:]
    return out


def scan(texts, items, window, outputs=ALL):
    scanned = decontaminate.Scanned(pa.array(texts, pa.string()), outputs)
    scanned.mark(decontaminate.TestSuffixes([i for i, _ in items], [t for _, t in items], window))
    return dict(zip(outputs, (c.to_pylist() for c in scanned.columns()), strict=True))


def test_matches_brute_force(monkeypatch):
    draw = random.Random(9)
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(decontaminate, "_PAIRS", pairs)
        for _ in range(60):
            text = lambda n: " ".join(draw.choice("ab c") for _ in range(n))
            items = [(f"i{k}", text(draw.choice([0, 1, 3, 6, 12]))) for k in range(6)]
            items.append(("same", items[4][1]))
            texts = [text(draw.choice([0, 2, 9, 30])) for _ in range(5)] + [None]
            got = scan(texts, items, 4)
            for r, t in enumerate(texts):
                own = (t or "").split()
                wanted = sorted((w, i, p, n) for i, x in items for w, p, n in plain_matches(own, x.split(), 4))
                assert [(m["word"], m["item_id"], m["item_word"], m["length"]) for m in got["matches"][r]] == wanted
                n, hit, names, _ = plain.scan(t, items, 4)
                assert (got["n_words"][r], got["n_hit"][r], got["items"][r], got["n_items"][r]) == (n, hit, names, len(names))


def test_many_occurrences_of_many_items():
    passage = " ".join(f"p{i}" for i in range(12))
    equal = [(str(i), passage) for i in range(4000)]
    differing = [(f"d{i}", f"{passage} own{i}") for i in range(2000)]
    text = f"{passage} . " * 4000
    began = time.perf_counter()
    got = scan([text], [*equal, *differing], 10, ALL[:4])
    assert (got["n_hit"], got["n_items"]) == ([48000], [6000])
    assert time.perf_counter() - began < 10
    assert len(scan([f"{passage} . " * 50], equal, 10)["matches"][0]) == 50 * 4000


def test_a_long_text():
    draw = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    item = " ".join(draw.choices(vocabulary, k=400))
    text = " ".join(draw.choices(vocabulary, k=1_500_000)) + " " + item + " end"
    began = time.perf_counter()
    got = scan([text, "short"], [("x", item)], 10)
    assert got["n_hit"] == [400, 0] and got["matches"][0] == [{"item_id": "x", "word": 1_500_000, "item_word": 0, "length": 400}]
    assert time.perf_counter() - began < 60


def test_words_of_long_texts_have_the_hashes_of_short_ones():
    piece = "Ab é日 x\tLong" * 3
    long = piece + " " + "w" * (SLICE_BYTES + 77) + " " + " ".join(["Mid", "dle"] * (SLICE_BYTES // 6)) + " " + piece
    for inside, fold in ((NOT_SPACE, AS_IS), (ALNUM, LOWER)):
        whole = words(pa.array(["lead", long, None, piece]), inside, fold)
        small = words(pa.array([piece]), inside, fold)
        n = len(small.hashes)
        assert np.array_equal(whole.hashes[1 : n + 1], small.hashes) and np.array_equal(whole.hashes[-n:], small.hashes)
        assert np.array_equal(whole.hashes[whole.first[2] - n : whole.first[2]], small.hashes)
        assert len(np.unique(whole.hashes)) == len(np.unique(small.hashes)) + 4
        huge = words(pa.array(["w" * (SLICE_BYTES + 77), "w" * (SLICE_BYTES + 76)]), inside, fold)
        assert huge.hashes[0] == whole.hashes[n + 1] != huge.hashes[1]
        for size, hashes in words(pa.array(["abcdefgh", "abc", "xabcd"]), inside, fold).prefixes((3, 4)):
            assert hashes[0] == words(pa.array(["abcdefgh"[:size]]), inside, fold).hashes[0] and (hashes[1] == hashes[0]) == (size == 3)
