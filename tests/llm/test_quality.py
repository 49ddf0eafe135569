from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roadstats.llm.quality import FENCES, features, quality_rules

from .conftest import ODD

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )


def counted(frame):
    return [tuple(r[c] for c in COUNTS) for r in features(frame).select(*COUNTS).collect()]


def test_counts_of_odd_rows(documents):
    assert counted(documents(*ODD)) == [by_hand(text) for _, text in ODD]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#|", max_size=120), min_size=1, max_size=20))
def test_counts_against_brute_force(documents, texts):
    assert counted(documents(*enumerate(texts))) == [by_hand(t) for t in texts]


def test_counts_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = features(docs).select("text", *COUNTS).collect()
    assert all(tuple(r)[1:] == by_hand(r["text"]) for r in rows)


def test_base_rules_and_fences(documents):
    good = [(i, f"w{i} " + " ".join(f"word{i}x{k}" for k in range(40)), "en", "a") for i in range(30)]
    junk = (100, " ".join(f"ab###{k} cd%%%" for k in range(40)), "en", "a")
    short = (101, "too short", "en", "a")
    loop = (102, "a b c d e f g h " * 20, "en", "a")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(documents(*good, junk, short, loop)).collect()}
    assert all(kept[i] for i in range(30))
    assert not kept[100] and not kept[101] and not kept[102]


def test_small_group_borrows_its_language(documents):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "big") for i in range(250)]
    alone = (900, " ".join(f"ab### cd%%%{k}" for k in range(40)), "en", "tiny")
    rows = {r["doc_id"]: r for r in quality_rules(documents(*good, alone)).collect()}
    assert not rows[900]["kept"] and rows[3]["kept"]


def test_odd_rows_all_come_back(documents):
    rows = quality_rules(documents(*ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(r["kept"] in (True, False) for r in rows)


def test_empty_table(documents):
    assert quality_rules(documents((1, "x")).limit(0)).count() == 0


@pytest.mark.parametrize("keep_text", [True, False])
def test_text_is_kept_on_request(documents, keep_text):
    assert ("text" in quality_rules(documents((1, "x")), keep_text=keep_text).columns) == keep_text


def test_a_source_full_of_junk_does_not_lift_its_fence(documents):
    good = [(i, f"w{i} " + " ".join(f"word{i % 7}x{k}" for k in range(40)), "en", "big") for i in range(600)]
    fine = [(1000 + i, f"w{i} " + " ".join(f"word{i % 7}x{k}" for k in range(40)), "en", "bad") for i in range(150)]
    junk = [(2000 + i, f"w{i} " + " ".join(f"wo{i}x{k}#%" for k in range(40)), "en", "bad") for i in range(100)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(documents(*good, *fine, *junk)).collect()}
    assert all(kept[i] for i, *_ in good + fine) and not any(kept[i] for i, *_ in junk)


def test_the_width_of_a_fence_follows_its_group(documents):
    def text(i, chars):
        return " ".join(f"{i % 10}{k:03d}".ljust(chars, "x") for k in range(40))

    narrow = [(i, text(i, 5), "en", "narrow") for i in range(300)]
    wide = [(1000 + i, text(i, 5 + i % 5), "fr", "wide") for i in range(300)]
    odd = [(5000, text(3, 6), "en", "narrow"), (5001, text(3, 13), "fr", "wide")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(documents(*narrow, *wide, *odd)).collect()}
    assert all(kept[i] for i, *_ in narrow + wide)
    assert not kept[5000] and kept[5001]


def judged_by_hand(docs, least):
    """``kept`` of each (doc_id, text, lang, source): exact quantiles in place of sketches."""
    shares, failed = [], []
    for _, text, _, _ in docs:
        n_words, word_chars, n_symbols, n_dup, n_repeat = by_hand(text)
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        pairs = {
            "mean_word_chars": (word_chars, n_words),
            "symbol_share": (n_symbols, word_chars),
            "dup_line_share": (n_dup, len(lines)),
            "echo_share": (echoes, n_words),
            "capital_share": (capitals, word_chars),
        }
        shares.append({m: a / b if b else 0.0 for m, (a, b) in pairs.items()})
        failed.append(n_words < 20 or 100 * n_repeat > 30 * n_words)
    groups = defaultdict(list)
    for (_, _, lang, source), share, bad in zip(docs, shares, failed, strict=True):
        if not bad:
            for key in ((lang, source), (lang, "*"), "*"):
                groups[key].append(share)

    def limits(held, f):
        values = sorted(x[f.metric] for x in held)
        few, mid = (values[math.ceil(q * len(values)) - 1] for q in (0.05, 0.5))
        reach = max(f.times * (mid - few), f.spread)
        return mid + reach, mid - reach

    out = []
    for (_, _, lang, source), share, bad in zip(docs, shares, failed, strict=True):
        kept = not bad
        for f in FENCES if kept else ():
            above = groups[lang, "*"] if len(groups[lang, "*"]) >= least else groups["*"]
            own = groups[lang, source] if len(groups[lang, source]) >= least else above
            highs, lows = zip(limits(own, f), limits(above, f), strict=True)
            kept &= share[f.metric] <= min(highs) and not (f.low and share[f.metric] < max(lows))
        out.append(kept)
    return out


@pytest.mark.parametrize("least", [5, 40, 200])
def test_verdicts_against_brute_force(spark, documents, least):
    """Every document of the table and the odd rows; sketches of so few values are exact."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = documents(*ODD, (20, "ab###c " * 30, "en", None), (21, "a b c", None, "s")).select(docs.columns)
    docs = docs.unionByName(odd)
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(repr((*r, k)) for r, k in zip(rows, judged_by_hand(rows, least), strict=True))
    got = quality_rules(docs, least=least).select("doc_id", "text", "lang", "source", "kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert 0 < sum(r["kept"] for r in got) < len(got)
