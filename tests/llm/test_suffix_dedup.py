from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadstats.llm import suffix_dedup as module
from roadstats.llm.suffix_dedup import suffix_dedup, window_order

from .conftest import ODD


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 80), st.integers(1, 4), st.randoms())
def test_order_of_windows(raw, size, letters, rng):
    text = np.frombuffer(bytes(b % letters for b in raw), np.uint8)
    starts = [i for i in range(len(text) - size + 1) if rng.random() < 0.6]
    if not starts:
        return
    order, same = window_order(text, np.array(starts), size)
    found = [text[i : i + size].tobytes() for i in order]
    assert sorted(order.tolist()) == starts
    assert found == sorted(found)
    assert same.tolist() == [False] + [a == b for a, b in zip(found, found[1:], strict=False)]


def by_hand(rows, size=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        key = (i is None, i or 0)
        for at in range(len(raw) - size + 1):
            s = raw[at : at + size]
            first[s] = min(first.get(s, key), key)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - size + 1):
            if first[raw[at : at + size]] < (i is None, i or 0):
                gone[at : at + size] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame, **kw):
    return sorted(map(tuple, suffix_dedup(frame, **kw).collect()), key=str)


def some_rows():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "ä", "ße"]
    passage = " ".join(rng.choice(words, 30))
    rows = []
    for i in range(60):
        body = " ".join(rng.choice(words, int(rng.integers(0, 60))))
        if i % 3 == 0:
            body += passage + str(i)
        if i % 7 == 0:
            body = passage[:80]
        rows.append((int(rng.integers(0, 50)), body))
    return rows


def test_against_brute_force(documents):
    rows = some_rows()
    assert found(documents(*rows)) == by_hand(rows)


def test_hot_anchors_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(module, "HOT", 3)
    rows = some_rows()
    assert found(documents(*rows)) == by_hand(rows)


def test_only_windows_that_may_repeat_are_sorted(documents, monkeypatch):
    """Texts share an anchor but no window, so that nothing needs an order."""
    rng = np.random.default_rng(7)
    own = ["".join(map(chr, rng.integers(97, 123, 120))) for _ in range(40)]
    rows = [(i, t[:60] + "a passage that all of them share" + t[60:]) for i, t in enumerate(own)]

    def refuse(text, starts, min_bytes):
        raise AssertionError(f"{len(starts)} windows to be sorted")

    monkeypatch.setattr(module, "window_order", refuse)
    assert found(documents(*rows)) == by_hand(rows)
    with pytest.raises(Exception, match="windows to be sorted"):
        found(documents(*rows, (99, own[0])))


def test_repeats():
    values = np.array([5, 1, 5, 2, 7, 1, 9], np.uint64)
    assert module._repeats(values).tolist() == [True, True, True, False, False, True, False]
    assert module._repeats(values[:0]).tolist() == [] and module._repeats(values[:1]).tolist() == [False]


def test_many_blocks_give_the_same(documents):
    rows = some_rows()
    assert found(documents(*rows), block_bytes=100) == by_hand(rows)


@pytest.mark.parametrize("size", [24, 64])
def test_other_lengths(documents, size):
    rows = some_rows()
    assert found(documents(*rows), min_bytes=size, gram=16) == by_hand(rows, size)


def test_odd_rows(documents):
    rows = [*ODD, (20, "x" * 300), (0, "x" * 60), (None, "y" * 80), (None, "y" * 80), (30, "word " * 20)]
    assert found(documents(*rows)) == by_hand(rows)


def test_text_that_is_left(documents):
    shared = "é" * 40
    rows = [(1, "start " + shared), (2, shared + " end"), (3, "short")]
    left = {r["doc_id"]: r["kept_text"] for r in suffix_dedup(documents(*rows), with_text=True).collect()}
    assert left == {1: "start " + shared, 2: " end", 3: "short"}


def test_other_columns_are_passed_on(documents):
    rows = [(2, "b" * 60, "en", "s2"), (1, "b" * 60, "de", "s1"), (None, None, None, "s3")]
    kept = suffix_dedup(documents(*rows), keep=("lang", "source")).collect()
    assert {(r["doc_id"], r["n_removed"], r["lang"], r["source"]) for r in kept} == {
        (2, 60, "en", "s2"), (1, 0, "de", "s1"), (None, 0, None, "s3")
    }


def test_empty_table(documents):
    assert suffix_dedup(documents((1, "x")).limit(0)).count() == 0
