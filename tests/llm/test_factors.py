"""Longest previous and next factors against all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm.substrings import longest_next, longest_previous, repeated_windows


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abracadabra", *["".join(random.Random(s).choices("ab" if s % 2 else "abc", k=3 + 5 * s)) for s in range(12)]])
def test_factors_of_every_place(text):
    tails = [text[i:] for i in range(len(text))]
    order = np.array(sorted(range(len(text)), key=tails.__getitem__), np.int64)
    shared = np.array([0, *[common(tails[a], tails[b]) for a, b in zip(order, order[1:])]][: len(text)], np.int64)
    before = [max((common(tails[i], tails[j]) for j in range(i)), default=0) for i in range(len(text))]
    after = [max((common(tails[i], tails[j]) for j in range(i + 1, len(text))), default=0) for i in range(len(text))]
    assert longest_previous(order, shared).tolist() == before
    assert longest_next(order, shared).tolist() == after


def _crowd(n, width, seed=1):
    """Pieces of two widths around one core, which differ in three bytes."""
    rng = random.Random(seed)
    base = rng.choices(b"abcdefgh ", k=2 * width)
    pieces = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(len(text)), 3):
            text[at] = rng.choice(b"xyz")
        pieces.append((b"\0" * 8, bytes(text), i))
    return pieces


def test_windows_of_a_crowd_against_all_pairs():
    width = 12
    pieces = _crowd(9, width)
    piece, start, elsewhere, earlier = repeated_windows(pieces, width)
    windows = [pieces[p][1][s : s + width] for p, s in zip(piece, start)]
    assert len(windows) == 9 * (width + 1)
    assert elsewhere.tolist() == [windows.count(w) > 1 for w in windows]
    assert earlier.tolist() == [w in windows[:i] for i, w in enumerate(windows)]


def test_windows_of_a_crowd_are_held_once():
    pieces = _crowd(200, 400)
    tracemalloc.start()
    try:
        piece, *_ = repeated_windows(pieces, 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * len(piece) * 408
