import itertools
import random

import pytest

from roadstats.operators import count_itemsets, essential_rules, mark_itemsets, mine_rules

SCHEMA = "g string, items array<string>, n long"


def sample(seed, rows=40, width=6):
    """Few rows with items that imply others, so that many counts are equal."""
    rnd = random.Random(seed)
    out = []
    for _ in range(rows):
        items = set(rnd.sample([f"i{k}" for k in range(width)], rnd.randint(0, width)))
        if "i0" in items:
            items |= {"i1"}
        if "i2" in items and rnd.random() < 0.9:
            items |= {"i3"}
        out.append((rnd.choice(["a", "b", None]), sorted(items), rnd.randint(1, 3)))
    return out


def counts_of(data):
    counts = {}
    for g, items, n in data:
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(items, k):
                counts[g, s] = counts.get((g, s), 0) + n
    return counts


@pytest.mark.parametrize(("seed", "support"), [(1, 0.0), (2, 0.0), (3, 0.15), (4, 0.4)])
def test_marks_against_all_larger_sets(rows, seed, support):
    data = sample(seed)
    found = count_itemsets(rows(data, SCHEMA), min_support=support, by=["g"])
    counts = {(r["g"], tuple(r["items"])): r["n"] for r in found.collect()}
    if not support:
        assert counts == counts_of(data)
    expected = {}
    for (g, s), n in counts.items():
        larger = [m for (h, t), m in counts.items() if h == g and set(s) < set(t)]
        expected[g, s] = (n, n not in larger, not larger)
    got = mark_itemsets(found, ["g"]).collect()
    assert {(r["g"], tuple(r["items"])): (r["n"], r["chiuso"], r["massimale"]) for r in got} == expected
    assert len(got) == len(expected)
    marks = {v[1:] for v in expected.values()}
    assert marks == {(True, True), (True, False), (False, False)}


def test_closed_sets_give_every_count(rows):
    data = sample(5)
    marked = mark_itemsets(count_itemsets(rows(data, SCHEMA), by=["g"]), ["g"]).collect()
    closed = [(r["g"], set(r["items"]), r["n"]) for r in marked if r["chiuso"]]
    assert len(closed) < len(marked)
    for r in marked:
        assert r["n"] == max(n for g, s, n in closed if g == r["g"] and set(r["items"]) <= s)


@pytest.mark.parametrize(("seed", "support"), [(1, 0.0), (2, 0.2), (6, 0.0)])
def test_rules_that_a_shorter_antecedent_gives(rows, seed, support):
    data = sample(seed)
    counts = counts_of(data)
    mined = mine_rules(rows(data, SCHEMA), support, by=["g"])
    every = {(r["g"], tuple(r["antecedent"]), r["consequent"][0]): r["confidence"] for r in mined.collect()}

    def records(g, a, c):
        return counts[g, tuple(sorted({*a, c}))], counts[g, a]

    expected = {
        (g, a, c): v
        for (g, a, c), v in every.items()
        if not any(
            h == g and d == c and set(b) < set(a) and records(h, b, d) == records(g, a, c) for h, b, d in every
        )
    }
    got = essential_rules(mined, ["g"])
    assert got.columns == mined.columns
    kept = {(r["g"], tuple(r["antecedent"]), r["consequent"][0]): r["confidence"] for r in got.collect()}
    assert kept == expected and 0 < len(kept) < len(every)


def test_without_groups(rows):
    frame = rows([(["a", "b"], 2), (["a", "b", "c"], 1), (["c"], 1)], "items array<string>, n long")
    got = mark_itemsets(count_itemsets(frame))
    assert {(tuple(r["items"]), r["n"], r["chiuso"], r["massimale"]) for r in got.collect()} == {
        (("a",), 3, False, False), (("b",), 3, False, False), (("c",), 2, True, False),
        (("a", "b"), 3, True, False), (("a", "c"), 1, False, False), (("b", "c"), 1, False, False),
        (("a", "b", "c"), 1, True, True),
    }
    rules = essential_rules(mine_rules(frame))
    assert (("a", "b"), ["c"]) not in [(tuple(r["antecedent"]), r["consequent"]) for r in rules.collect()]


def test_sets_of_two_and_more_only(rows):
    """Sizes may begin above one; smaller sets are not made up."""
    frame = rows([(["a", "b", "c"], 2), (["a", "b"], 1)], "items array<string>, n long")
    got = mark_itemsets(count_itemsets(frame, min_items=2)).collect()
    assert {(tuple(r["items"]), r["chiuso"]) for r in got} == {
        (("a", "b"), True), (("a", "c"), False), (("b", "c"), False), (("a", "b", "c"), True),
    }


def test_nothing_found(rows):
    empty = rows([], SCHEMA)
    assert mark_itemsets(empty, ["g"]).isEmpty()
    assert essential_rules(mine_rules(empty, by=["g"]), ["g"]).isEmpty()


def test_marks_take_one_shuffle(rows):
    plan = mark_itemsets(rows(sample(1), SCHEMA), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
