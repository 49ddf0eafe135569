import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from roadstats.operators import adjusted, chi_squared, count_itemsets, rule_counts, significant_rules
from roadstats.operators.significance import erfc

SCHEMA = "g string, items array<string>, n long"
COUNTS = "n long, n_antecedent long, n_consequent long, records long"


def sample(seed=1, rows=60, width=5):
    rnd = random.Random(seed)
    names = [f"i{k}" for k in range(width)]
    out = []
    for _ in range(rows):
        items = set(rnd.sample(names, rnd.randint(0, width)))
        if "i0" in items and rnd.random() < 0.8:
            items |= {"i1"}
        out.append((rnd.choice(["a", "b", None]), sorted(items), rnd.randint(1, 5)))
    return out


def tables(data):
    """The contingency counts of all rules, counted record by record."""
    out = {}
    for g in {r[0] for r in data}:
        own = [(set(i), n) for h, i, n in data if h == g]
        total = sum(n for _, n in own)

        def has(s, own=own):
            return sum(n for i, n in own if s <= i)

        names = sorted(set().union(*(i for i, _ in own)))
        for k in range(2, len(names) + 1):
            for s in itertools.combinations(names, k):
                if has(set(s)):
                    for c in s:
                        a = tuple(i for i in s if i != c)
                        out[g, a, c] = (has(set(s)), has(set(a)), has({c}), total)
    return out


def benjamini_hochberg(ps):
    order = sorted(range(len(ps)), key=lambda i: -ps[i])
    least, out = 1.0, [0.0] * len(ps)
    for at, i in enumerate(order):
        least = min(least, ps[i] * len(ps) / (len(ps) - at))
        out[i] = least
    return out


def test_erfc_against_the_library(spark):
    zs = [0.0, 1e-9, 0.01, 0.5, 1.0, 2.0, 2.499999, 2.5, 3.0, 5.0, 10.0, 20.0, 26.0, 40.0, 1e6]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", erfc(F.col("z")).alias("e")).collect()
    for r in got:
        assert r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-11, abs=1e-305)


def test_counts_chi_squared_and_correction(rows):
    data = sample()
    frame = rows(data, SCHEMA)
    got = significant_rules(count_itemsets(frame, by=["g"]), frame, ["g"]).collect()
    expected = tables(data)
    key = {(r["g"], tuple(r["antecedent"]), r["consequent"][0]): r for r in got}
    assert len(key) == len(got)
    assert {k: (r["n"], r["n_antecedent"], r["n_consequent"], r["records"]) for k, r in key.items()} == expected
    ps = {}
    for k, (n, a, c, t) in expected.items():
        cells = [(n, a * c), (a - n, a * (t - c)), (c - n, (t - a) * c), (t - a - c + n, (t - a) * (t - c))]
        chi2 = 0.0 if a == t or c == t else sum((o - e / t) ** 2 / (e / t) for o, e in cells)
        assert key[k]["chi2"] == pytest.approx(chi2, rel=1e-9, abs=1e-9)
        assert key[k]["atteso"] == pytest.approx(a * c / t)
        ps[k] = math.erfc(math.sqrt(chi2 / 2))
        assert key[k]["p"] == pytest.approx(ps[k], rel=1e-7)
    for k, q in zip(ps, benjamini_hochberg(list(ps.values())), strict=True):
        assert key[k]["p_corretto"] == pytest.approx(q, rel=1e-6)
    assert 0 < sum(r["p_corretto"] < 0.05 for r in got) < len(got)
    kept = significant_rules(count_itemsets(frame, by=["g"]), frame, ["g"], most=0.05)
    assert kept.count() == sum(r["p_corretto"] <= 0.05 for r in got)


def test_a_side_that_all_records_have(rows):
    got = chi_squared(rows([(5, 10, 5, 10), (5, 5, 10, 10), (10, 10, 10, 10)], COUNTS)).collect()
    assert [(r["chi2"], r["p"]) for r in got] == [(0.0, 1.0)] * 3


def test_large_counts_do_not_overflow(rows):
    n = 3_000_000_000_000
    got = chi_squared(rows([(n // 4 + 10**7, n // 2, n // 2, n)], COUNTS)).first()
    assert got["chi2"] == pytest.approx(16 * 10.0**14 / n, rel=1e-6)


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_correction_over_any_ranges_with_ties(spark, ranges):
    rnd = random.Random(ranges)
    # A third of all rules have one probability.
    ps = [0.5 if i % 3 == 0 else rnd.choice([0.0, 1.0, rnd.random(), rnd.random() ** 8]) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        frame = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
        got = {r["i"]: r["p_corretto"] for r in adjusted(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i] for i in range(300)] == pytest.approx(benjamini_hochberg(ps), rel=1e-12)


def test_without_groups_and_counts(rows):
    frame = rows([(["a", "b"],), (["a", "b"],), (["c"],), ([],)], "items array<string>")
    got = rule_counts(count_itemsets(frame), frame).collect()
    assert sorted((r["antecedent"], r["consequent"], *r[2:]) for r in got) == [
        (["a"], ["b"], 2, 2, 2, 4), (["b"], ["a"], 2, 2, 2, 4),
    ]


def test_no_rules(rows):
    empty = rows([], SCHEMA)
    assert significant_rules(count_itemsets(empty, by=["g"]), empty, ["g"]).isEmpty()
