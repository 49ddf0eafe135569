from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadstats.llm import collocations as C
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute_force(rows, least, top=2000, longest=4):
    """Rows as (lang, text)."""
    out = []
    for lang in {"und" if r[0] is None else r[0] for r in rows}:
        f, n = Counter(), 0
        for text in (t for x, t in rows if (x if x is not None else "und") == lang):
            for words in pieces(text):
                n += len(words)
                for k in range(1, longest + 1):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in known.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            spans = lambda q: {q[i : i + len(p)] for i in range(len(q) - len(p) + 1)}
            if not any(len(q) > len(p) and 100 * b >= 80 * a and p in spans(q) for q, b in known.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def found(docs, **options):
    return sorted(map(tuple, C.collocations(docs, **options).collect()))


TEXT = "New York City, new york city! New\tYork  is big.\r\nbig is new york\x0bnew york. A b a b a b a b "


def test_against_brute_force_with_odd_rows(spark, documents):
    docs = documents(*ODD, *[(i, TEXT, ("en", "de", None)[i % 3], "s") for i in range(20, 32)])
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    expected = brute_force(rows, 4)
    assert len(expected) > 10 and {r[0] for r in expected} == {"en", "de", "und"}
    assert found(docs, least=4) == expected
    # Several tries for each level, no trie of which holds all.
    assert found(docs, least=4, trie_bytes=60) == expected
    assert found(docs, least=4, top=2) == brute_force(rows, 4, top=2)


def test_tasks_that_hold_little(spark, documents, monkeypatch):
    monkeypatch.setattr(C, "_HELD", 8)
    monkeypatch.setattr(C, "_SLICE", 40)
    docs = documents(*[(i, TEXT + str(i), "en", "s") for i in range(9)]).repartition(3)
    assert found(docs, least=3) == brute_force([tuple(r) for r in docs.select("lang", "text").collect()], 3)


def test_several_tries_read_the_texts_once_a_level(documents, monkeypatch):
    """What is written grows with the phrases, not with tries times texts; tries are stretches of the phrases."""
    docs, written, held = documents(*[(i, TEXT + str(i), "en", "s") for i in range(9)]), [], []

    def write(df, name, real=C.materialize):
        written.append(name)
        return real(df, name)

    def build(langs, phrases, real=C.build_trie):
        held.append(phrases)
        return real(langs, phrases)

    monkeypatch.setattr(C, "materialize", write)
    monkeypatch.setattr(C, "build_trie", build)
    monkeypatch.setattr(C, "_TAKEN", 50, raising=False)
    assert found(docs, least=3, trie_bytes=40) == brute_force([tuple(r) for r in docs.select("lang", "text").collect()], 3)
    assert not {"text", "found"} & set(written) and len(held) > 5
    for k in range(1, 5):
        level = [p for trie in held for p in trie if p.count(" ") == k - 1]
        assert level == sorted(set(level))
    assert all(sum(len(p) + 2 for p in trie[:-1]) <= 40 for trie in held)


def test_nothing_frequent(documents):
    docs = documents((1, "a b c", "en", "s"))
    assert found(docs, least=2) == [] and found(docs.limit(0), least=2) == []


def test_scores_are_exact(spark):
    big = 9_000_000_000_000
    row = spark.sql(
        f"SELECT cast({big} AS decimal(25,0)) * cast(2000000 AS decimal(7,0)) div "
        f"(cast({big + 7} AS decimal(20,0)) + cast({big + 1} AS decimal(20,0))) AS x"
    ).first()
    assert row["x"] == 2_000_000 * big // (2 * big + 8)


phrase = st.lists(st.text("abß𝄞", min_size=1, max_size=4), min_size=2, max_size=2).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.sampled_from(["", "en", "en\nx"]), phrase), max_size=40), st.lists(phrase, max_size=12))
def test_trie_accepts_its_phrases_alone(keys, texts):
    keys = sorted(keys)
    trie = C.build_trie([k[0] for k in keys], [k[1] for k in keys])
    texts = texts + [k[1] for k in keys]
    for lang in ("", "en", "en\nx", "other"):
        if not texts:
            continue
        stream, starts, text = C.word_starts(pa.array(texts))
        at = C.accepted(stream, starts, np.full(len(starts), trie.roots.get(lang, -1)), trie)
        for i, whole in enumerate(texts):
            wanted = keys.index((lang, whole)) if (lang, whole) in keys else -1
            assert at[np.flatnonzero(text == i)[0]] == wanted


def test_trie_with_many_children():
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}" for i in range(20_000)]
    trie = C.build_trie(["en"] * len(words), words)
    stream, starts, _ = C.word_starts(pa.array([" ".join(words), "zz zz0"]))
    at = C.accepted(stream, starts, np.full(len(starts), trie.roots["en"]), trie)
    assert at.tolist() == [*range(20_000), -1, -1]


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\t\tc ", "A.b,,c\n\n d \n", "\x00\x1f x", ". . ."])
def test_word_starts(text):
    stream, starts, of = C.word_starts(pa.array([None, text, text]))
    words = [w for p in pieces(text) for w in p]
    assert len(starts) == 2 * len(words) and of.tolist() == [1] * len(words) + [2] * len(words)
    read = [re.split(rb"[ \n]", stream[s:].tobytes(), maxsplit=1)[0].decode() for s in starts]
    assert read == words * 2
