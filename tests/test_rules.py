import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadstats.operators import (
    baseline_from_counts,
    baseline_from_rules,
    count_itemsets,
    filter_rules,
    itemsets,
    mine_rules,
    rule_lines,
    score_rules,
)


def sample(n=400, seed=5):
    rnd = random.Random(seed)
    return [
        (rnd.choice("12") + "g", rnd.choice(["x", "y", "", None]), rnd.choice(["1g", "z"]), rnd.choice("pq"))
        for _ in range(n)
    ]


FIELDS = {c: c for c in "abcd"}
SCHEMA = "a string, b string, c string, d string"


def brute(data):
    """Itemset counts and rules by enumeration."""
    counts = Counter()
    for row in data:
        items = sorted({v for v in row if v is not None})
        for k in range(1, len(items) + 1):
            counts.update(itertools.combinations(items, k))
    rules = {}
    for s, n in counts.items():
        for c in s if len(s) > 1 else ():
            a = tuple(i for i in s if i != c)
            rules[(a, c)] = n / counts[a]
    return counts, rules


def rule_dict(df):
    return {(tuple(r["antecedent"]), r["consequent"][0]): r["confidence"] for r in df.collect()}


def test_items_are_distinct_sorted_and_not_null(rows):
    df = rows([("b", "a", "b", None), (None, None, None, None)], SCHEMA)
    assert [r[0] for r in itemsets(df, FIELDS).collect()] == [["a", "b"], []]
    tagged = itemsets(df, FIELDS, tag_fields=True).first()[0]
    assert tagged == ["a=b", "b=a", "c=b"]


def test_powerset_equals_enumeration_and_fpgrowth(rows):
    data = sample()
    counts, rules = brute(data)
    sets = itemsets(rows(data, SCHEMA), FIELDS)
    for engine in ("powerset", "fpgrowth"):
        found = {tuple(r["items"]): r["n"] for r in count_itemsets(sets, engine=engine).collect()}
        assert found == counts
        got = rule_dict(mine_rules(sets, engine=engine))
        assert got.keys() == rules.keys()
        assert all(math.isclose(got[r], rules[r], rel_tol=1e-12) for r in rules)


def test_counted_rows_give_the_same_rules(rows):
    data = sample()
    df = rows(data, SCHEMA)
    counted = itemsets(df.groupBy(*FIELDS).count(), FIELDS, weight="count")
    assert rule_dict(mine_rules(counted)) == rule_dict(mine_rules(itemsets(df, FIELDS)))


def test_min_confidence_and_min_items(rows):
    data = sample()
    counts, rules = brute(data)
    sets = itemsets(rows(data, SCHEMA), FIELDS)
    got = rule_dict(mine_rules(sets, min_confidence=0.5))
    assert got.keys() == {r for r, c in rules.items() if c >= 0.5}
    big = count_itemsets(sets, min_items=3)
    assert {tuple(r["items"]) for r in big.collect()} == {s for s in counts if len(s) >= 3}


def test_min_support_uses_fpgrowth(rows):
    data = sample()
    counts, _ = brute(data)
    sets = itemsets(rows(data, SCHEMA), FIELDS)
    got = {tuple(r["items"]): r["n"] for r in count_itemsets(sets, min_support=0.2).collect()}
    assert got == {s: n for s, n in counts.items() if n >= 0.2 * len(data)}


def test_engine_checks(rows):
    wide = rows([([str(i) for i in range(9)],)], "items array<string>")
    with pytest.raises(PySparkException):
        count_itemsets(wide, max_width=8).collect()
    with pytest.raises(ValueError):
        mine_rules(wide.withColumn("n", F.lit(1)), engine="fpgrowth")
    with pytest.raises(ValueError):
        mine_rules(wide, engine="other")
    with pytest.raises(ValueError):
        mine_rules(wide, by=["g"])


@pytest.mark.parametrize("width", [9, 16, 17, 19])
def test_every_subset_of_wide_rows(rows, width):
    wide = rows([([f"i{i:02}" for i in range(width)],)], "items array<string>")
    assert count_itemsets(wide).count() == 2**width - 1
    if width == 9:
        assert count_itemsets(wide, engine="fpgrowth").count() == 2**width - 1
        assert mine_rules(wide).count() == sum(k * math.comb(width, k) for k in range(2, width + 1))


@pytest.mark.parametrize("width", [31, 32, 33, 70])
def test_very_wide_rows_with_a_support(rows, width):
    """Each item but two is in one row only; no width is refused or cut."""
    data = [([f"r{r}i{i:02}" for i in range(width - 2)] + ["x", "y"],) for r in range(4)]
    found = count_itemsets(rows(data, "items array<string>"), min_support=0.5).collect()
    assert {(tuple(r["items"]), r["n"]) for r in found} == {(("x",), 4), (("y",), 4), (("x", "y"), 4)}


def test_rows_without_end_are_refused(rows):
    with pytest.raises(PySparkException):
        count_itemsets(rows([([str(i) for i in range(63)],)], "items array<string>")).collect()


def test_support_on_counted_rows(rows):
    data = sample()
    counts, _ = brute(data)
    sets = itemsets(rows(data, SCHEMA), FIELDS)
    counted = sets.groupBy("items").count().withColumnRenamed("count", "n")
    want = {s: n for s, n in counts.items() if n >= math.ceil(0.1 * len(data))}
    for found in (
        count_itemsets(counted, min_support=0.1),
        count_itemsets(sets, min_support=0.1),
        count_itemsets(sets, min_support=0.1, engine="powerset"),
    ):
        assert {tuple(r["items"]): r["n"] for r in found.collect()} == want
    a = rule_dict(mine_rules(counted, min_support=0.1, min_confidence=0.3))
    b = rule_dict(mine_rules(sets, min_support=0.1, min_confidence=0.3))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_rules_by_group_are_each_groups_own(rows):
    data = sample()
    df = rows(data, SCHEMA)
    counted = itemsets(df.groupBy(*"abcd").count(), {c: c for c in "bcd"}, weight="count", keep=["a"])
    found = {}
    for r in mine_rules(counted, by=["a"]).collect():
        found.setdefault(r["a"], {})[tuple(r["antecedent"]), r["consequent"][0]] = r["confidence"]
    for group in {row[0] for row in data}:
        _, rules = brute([row[1:] for row in data if row[0] == group])
        assert found[group].keys() == rules.keys()
        assert all(math.isclose(found[group][k], rules[k]) for k in rules)


def test_a_baseline_with_an_item_twice_gives_each_rule_once(rows):
    rules = rows([(["a"], ["c"], 0.5)], RULES)
    base = rows([("c", 0.25), ("c", 0.5)], "item string, freq double")
    assert [r["score"] for r in score_rules(rules, base, "ratio").collect()] == [1.0]


RULES = "antecedent array<string>, consequent array<string>, confidence double"


def test_filter_rules(rows):
    df = rows(
        [(["a", "b"], ["c"], 0.5), (["a"], ["c"], 0.5), (["", "b"], ["c"], 0.5), (["a", "b"], [""], 0.5)],
        RULES,
    )
    kept = filter_rules(df, min_antecedent=2).collect()
    # An empty item is only excluded from the antecedent.
    assert [(r["antecedent"], r["consequent"]) for r in kept] == [(["a", "b"], ["c"]), (["a", "b"], [""])]


def test_scores(rows):
    df = rows([(["a"], ["c"], 0.5), (["b"], ["c"], 1.0), (["b"], ["d"], 0.01), (["b"], ["x"], 0.9)], RULES)
    base = rows([("c", 0.25), ("d", 0.2), ("e", 0.5)], "item string, freq double")
    ratio = {(r["antecedent"][0], r["consequent"][0]): r["score"] for r in score_rules(df, base, "ratio").collect()}
    # x has no baseline and is left out.
    assert ratio == {("a", "c"): 2.0, ("b", "c"): 4.0, ("b", "d"): pytest.approx(0.05)}
    assert score_rules(df, base, "ratio", threshold=0.1).count() == 2
    assert score_rules(df, base, "ratio", threshold=4.0).count() == 1
    log = {r["confidence"]: r["score"] for r in score_rules(df, score="inverse_log").collect()}
    assert log[1.0] == math.inf
    assert log[0.01] == pytest.approx(0.5)
    assert log[0.5] == pytest.approx(1 / abs(math.log10(0.5)))
    own = score_rules(df, base, lambda c, b: c / F.abs(F.log10(b)))
    assert own.count() == 3
    with pytest.raises(ValueError):
        score_rules(df, score="ratio")


def test_zero_baseline_is_infinite(rows):
    df = rows([(["a"], ["c"], 0.5)], RULES)
    base = rows([("c", 0.0)], "item string, freq double")
    assert score_rules(df, base, "ratio", threshold=0.1).first()["score"] == math.inf


def test_baselines(rows):
    df = rows([("a",), ("a",), ("b",), (None,)], "t string")
    assert {r["item"]: r["freq"] for r in baseline_from_counts(df, "t").collect()} == {"a": 0.5, "b": 0.25}
    rules = rows([(["b", "x"], ["c"], 0.5), (["b"], ["c"], 0.9)], RULES)
    got = baseline_from_rules(rules, ["x", "b"]).collect()
    assert [tuple(r) for r in got] == [("c", 0.5)]


def test_rule_lines(rows):
    df = score_rules(rows([(["a", "b"], ["c"], 0.5), (["a"], ["b"], 1.0)], RULES))
    assert [r[0] for r in rule_lines(df).collect()] == ["[a, b] => [c], 0.5", "[a] => [b], 1.0"]
