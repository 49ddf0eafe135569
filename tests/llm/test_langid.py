from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from roadstats.llm.langid import (
    UNKNOWN,
    Model,
    _scores,
    expected_counts,
    held_out,
    learn,
    model_mark,
    piece_hashes,
    predict,
    units,
    vocabulary,
    word_scores,
)
from roadstats.llm.queries import op9_language_id

from .conftest import ODD

PIECES = ["a", "b", "ab", "ba", "aab", "abab"]


def model():
    hashes, longest = piece_hashes(PIECES)
    chance = np.random.default_rng(2).random((len(hashes), 2))
    return Model(["x", "y"], hashes, longest, chance / chance.sum(0))


def by_hand(word, chance):
    """(probability, expected uses) over all segmentations; unknown characters count as pieces."""
    whole, uses = 0.0, dict.fromkeys(chance, 0.0)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        p = math.prod(chance.get(x, UNKNOWN if len(x) == 1 else 0.0) for x in parts)
        whole += p
        for x in parts:
            if x in uses:
                uses[x] += p
    return whole, {x: u / whole for x, u in uses.items()}


def chances(m, k):
    order = {int(h): i for i, h in enumerate(m.hashes)}
    return {p: float(m.chance[order[int(piece_hashes([p])[0][0])], k]) for p in PIECES}


def test_forward_sums_all_segmentations():
    m = model()
    words = ["a", "ab", "abab", "aabab", "bbaab", "abcab", "c", "aabababab"]
    scores = word_scores(words, m)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(scores[i, k], math.log(by_hand(w, chances(m, k))[0]), rel_tol=1e-9)


def test_expected_uses():
    m = model()
    words, weight = ["abab", "aabab", "abcab"], np.array([1.0, 2.0, 5.0])
    found = expected_counts(words, weight, m, 1)
    order = {int(h): i for i, h in enumerate(m.hashes)}
    want = [by_hand(w, chances(m, 1))[1] for w in words]
    for p in PIECES:
        at = order[int(piece_hashes([p])[0][0])]
        assert math.isclose(found[at], sum(n * u[p] for n, u in zip(weight, want, strict=True)), abs_tol=1e-9)


def by_sums(word, chance):
    """Log probability over all segmentations, with exact integers for the chances."""
    from fractions import Fraction

    held = [Fraction(1)]
    for end in range(1, len(word) + 1):
        total = Fraction(0)
        for size in range(1, min(end, max(map(len, chance))) + 1):
            part = word[end - size : end]
            p = max(chance.get(part, 0.0), UNKNOWN) if size == 1 else chance.get(part, 0.0)
            total += held[end - size] * Fraction(p)
        held.append(total)
    x = held[-1]
    # Too small for a float.
    shift = x.denominator.bit_length() - x.numerator.bit_length()
    return math.log(x * 2**shift) - shift * math.log(2)


@pytest.mark.parametrize("length", [31, 32, 33, 64, 500])
def test_long_words_sum_all_segmentations(length):
    m, draw = model(), np.random.default_rng(length)
    words = ["".join(draw.choice(list("abc"), length, p=[0.5, 0.4, 0.1])) for _ in range(3)] + ["x" * length]
    scores = word_scores(words, m)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(scores[i, k], by_sums(w, chances(m, k)), rel_tol=1e-9)


def test_by_sums_is_the_enumeration():
    m = model()
    for w in ("aabab", "abcab"):
        assert math.isclose(by_sums(w, chances(m, 0)), math.log(by_hand(w, chances(m, 0))[0]), rel_tol=1e-9)


def test_expected_uses_of_a_long_word():
    m = model()
    word = "ab" * 200 + "c" + "aab" * 30
    found = expected_counts([word], np.array([1.0]), m, 0)
    assert np.isfinite(found).all()
    order = {int(h): i for i, h in enumerate(m.hashes)}
    # Expected characters covered by known pieces are those of the word without the unknown one.
    covered = sum(found[order[int(piece_hashes([p])[0][0])]] * len(p) for p in PIECES)
    assert math.isclose(covered, len(word) - 1, rel_tol=1e-9)


def test_words_are_never_cut():
    text = "x" * 1000 + " y"
    assert units(text) == ["▁" + "x" * 1000, "▁y"]


def test_two_models_in_one_worker():
    # The same languages and total chance, and a process that has scored with the other before.
    m = model()
    other = Model(m.languages, m.hashes, m.longest, m.chance[:, ::-1].copy())
    assert model_mark(m) != model_mark(other) and model_mark(m) == model_mark(model())
    texts = ["abab aab"] * 2
    first, second = _scores(texts, m, model_mark(m)), _scores(texts, other, model_mark(other))
    assert first[0][0] != second[0][0] and first == _scores(texts, m, model_mark(m))


def test_too_many_languages(documents):
    docs = documents(*[(i, "a", f"l{i}", "s") for i in range(4)]).select("doc_id", "text", "lang")
    with pytest.raises(ValueError):
        learn(docs, PIECES, most_languages=3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op9_language_id(spark, sf).collect()
    lang = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_no_labels(spark, documents):
    labelled = documents((1, "the and of", "en", "s"), (2, "der die und", "de", "s"), (3, "the in", "en", "s"))
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    m = learn(labelled.select("doc_id", "text", "lang"), pieces)
    odd = documents(*ODD, (50, "123 456"), (51, "the of the"), (52, "und die der"))
    rows = predict(odd.select("doc_id", "text", "score", F.lit(1).alias("extra")) if "score" in odd.columns else odd, m).collect()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(ODD) + 3
    assert found[1] == found[2] == found[3] == found[50] == ("und", 0.0)
    assert found[51][0] == "en" and found[52][0] == "de"
    none = learn(labelled.limit(0).select("doc_id", "text", "lang"), pieces)
    assert {r["lang_pred"] for r in predict(odd, none).collect()} == {"und"}
    assert predict(odd.limit(0), m).count() == 0


def test_null_id_is_not_held_out(documents):
    assert documents((None, "x")).select(held_out(F.col("doc_id"))).first()[0] is False
