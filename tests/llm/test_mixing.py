from __future__ import annotations

import math
import re
import struct
from collections import defaultdict

import numpy as np
import xxhash

from roadstats.llm.mixing import DIMENSIONS, mix, rake

from .conftest import ODD


def raked_by_hand(cells, targets, keep, sweeps):
    """Cells {(a, b): tokens}, targets one dict a dimension; weights as in the operator."""
    weight = {c: t * keep for c, t in cells.items()}
    aim = keep * sum(cells.values())
    for _ in range(sweeps):
        for d, wanted in enumerate(targets):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {
                c: min(w * wanted.get(c[d], 0.0) * aim / sums[c[d]] if sums[c[d]] else 0.0, cells[c])
                for c, w in weight.items()
            }
    return weight


def test_rake_against_brute_force(spark):
    rng = np.random.default_rng(1)
    cells = {(f"={a}", f"={b}"): float(rng.integers(1, 1000)) for a in range(6) for b in range(4) if (a + b) % 5}
    targets = [{f"={a}": 1 / 6 for a in range(6)}, {f"={b}": s for b, s in enumerate((0.3, 0.3, 0.2, 0.2))}]
    frame = spark.createDataFrame([(*c, t) for c, t in cells.items()], "_x string, _y string, tokens double")
    tables = {
        d: spark.createDataFrame(list(t.items()), f"_{d} string, target double")
        for d, t in zip("xy", targets, strict=True)
    }
    rows = rake(frame, tables, keep=0.3, sweeps=8, tolerance=0, block=4).collect()
    want = raked_by_hand(cells, targets, 0.3, 8)
    assert len(rows) == len(cells)
    assert all(abs(r["weight"] - want[r["_x"], r["_y"]]) < 1e-6 for r in rows)


def test_sample_meets_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, keep=0.7).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["probability"] <= 1 for r in rows)
    tokens = sum(r["tokens"] for r in rows)
    assert abs(sum(r["weight"] for r in rows) / tokens - 0.7) < 0.01
    for d, exponent in (("source", 0.7), ("lang", 0.7), ("topic", 0.9)):
        sums, weights, kept = defaultdict(float), defaultdict(float), defaultdict(float)
        for r in rows:
            sums[r[d]] += r["tokens"]
            weights[r[d]] += r["weight"]
            kept[r[d]] += r["tokens"] * r["kept"]
        whole = sum(s**exponent for s in sums.values())
        for value, s in sums.items():
            target = s**exponent / whole
            assert abs(weights[value] / sum(weights.values()) - target) < 0.02
            assert abs(kept[value] / sum(kept.values()) - target) < 0.06


def test_odd_rows(documents):
    rows = mix(documents(*ODD)).collect()
    assert len(rows) == len(ODD)
    assert all(r["kept"] in (True, False) and 0 <= r["probability"] <= 1 for r in rows)
    twins = {r["kept"] for r in rows if r["doc_id"] == 5}
    assert len(twins) == 1
    assert mix(documents((1, "x")).limit(0)).count() == 0


def test_given_targets(spark, documents):
    docs = documents(*[(i, f"w{i} x y z", "en" if i % 4 else None, f"s{i % 3}") for i in range(1200)])
    wanted = {
        "lang": spark.createDataFrame([("=en", 0.5), ("-", 0.5)], "_lang string, target double"),
        "source": spark.createDataFrame([(f"=s{k}", 1 / 3) for k in range(3)], "_source string, target double"),
    }
    rows = mix(docs, wanted, keep=0.4).collect()
    assert abs(sum(r["weight"] for r in rows if r["lang"] is None) / sum(r["weight"] for r in rows) - 0.5) < 1e-3
    assert set(DIMENSIONS) <= set(rows[0].asDict())


def drawn(doc_id, text, seed=11):
    """The number in [0, 1) that a document is drawn by."""
    h = 42
    for raw in (
        None if doc_id is None else struct.pack("<q", doc_id),
        None if text is None else text.encode(),
        struct.pack("<i", seed),
    ):
        h = h if raw is None else xxhash.xxh64_intdigest(raw, h)
    return (h & ((1 << 40) - 1)) / (1 << 40)


def form(text):
    text = text or ""
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    if n == 0:
        return "empty"
    if " | " in text:
        return "table"
    if n < 100:
        return "short"
    if text.count("\n") * 8 > n:
        return "list"
    return "long" if n >= 1000 else "prose"


def mixed_by_hand(docs, keep, tolerance=5e-4):
    """Tokens, topic, probability and draw of each (doc_id, text, source, lang)."""
    tokens = [max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t, _, _ in docs]
    cell_of = [(source, lang, form(t)) for _, t, source, lang in docs]
    cells = defaultdict(float)
    for c, n in zip(cell_of, tokens, strict=True):
        cells[c] += n
    targets = []
    for d, exponent in enumerate((0.7, 0.7, 0.9)):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[d]] += n
        whole = sum(s**exponent for s in sums.values())
        targets.append({v: s**exponent / whole for v, s in sums.items()})
    aim, weight = keep * sum(cells.values()), {}
    for sweeps in range(4, 61, 4):
        last, weight = (raked_by_hand(cells, targets, keep, s) for s in (sweeps - 1, sweeps))
        error = 0.0
        for d, wanted in enumerate(targets):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            error = max(error, *(abs(sums[v] - t * aim) / aim for v, t in wanted.items()))
        if min(error, sum(abs(weight[c] - last[c]) for c in cells) / aim) <= tolerance:
            break
    chances = [weight[c] / cells[c] for c in cell_of]
    return tokens, [c[2] for c in cell_of], chances, [drawn(i, t) for i, t, _, _ in docs], error


def same_as_by_hand(frame, keep):
    """Every row's tokens, topic, probability and draw; draws nearer than 1e-9 do not decide."""
    docs = [tuple(r) for r in frame.select("doc_id", "text", "source", "lang").collect()]
    tokens, topics, chances, draws, error = mixed_by_hand(docs, keep)
    columns = ("doc_id", "text", "source", "lang", "tokens", "topic")
    got = sorted(mix(frame, keep=keep).collect(), key=lambda r: repr([r[c] for c in columns]))
    want = sorted(zip(docs, tokens, topics, chances, draws, strict=True), key=lambda w: repr([*w[0], float(w[1]), w[2]]))
    assert len(got) == len(want)
    for r, (doc, n, topic, chance, draw) in zip(got, want, strict=True):
        assert (*doc, n, topic) == tuple(r[c] for c in columns)
        assert math.isclose(r["probability"], chance, abs_tol=1e-9)
        assert math.isclose(r["weight"], n * chance, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["unmet"], error, abs_tol=1e-9)
        assert abs(draw - chance) < 1e-9 or r["kept"] == (draw < chance)


def test_rows_against_brute_force(spark):
    same_as_by_hand(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.7)


def test_odd_rows_against_brute_force(documents):
    same_as_by_hand(documents(*ODD, (20, "a b", "en", None), (21, "a | b\nc", None, "s"), (22, "c d", "en", "s")), 0.4)


def test_targets_that_cannot_be_met_are_told(spark, documents):
    docs = documents(*[(i, "w x y z", "en" if i % 10 else "it", "s") for i in range(400)])
    wanted = {"lang": spark.createDataFrame([("=en", 0.5), ("=it", 0.5)], "_lang string, target double")}
    # A tenth of all tokens is a seventh of the weight, not half of it.
    (unmet,) = {r["unmet"] for r in mix(docs, wanted, keep=0.7).collect()}
    assert abs(unmet - (0.5 - 0.1 / 0.7)) < 1e-3
    assert mix(docs, wanted, keep=0.1).first()["unmet"] < 1e-3
