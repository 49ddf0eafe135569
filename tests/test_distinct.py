import random

from roadstats.operators import (
    compare_sketches,
    distinct_by,
    distinct_sketches,
    distinct_with_totals,
    merge_sketches,
    sketch_counts,
)

SCHEMA = "g string, k string, x string, w long"


def sample(n=400, seed=3):
    """A third of the rows in one category, half of these with one value; NULLs and empty texts."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(("hot", "a", "same" if i % 2 else f"v{rnd.randint(0, 40)}", rnd.randint(1, 4)))
        else:
            values = [None, "", *(f"v{j}" for j in range(30))]
            out.append((rnd.choice(["p", "q", "", None]), rnd.choice("ab"), rnd.choice(values), rnd.randint(1, 4)))
    return out


def brute(data, key):
    rows, values = {}, {}
    for r in data:
        rows[key(r)] = rows.get(key(r), 0) + r[3]
        values.setdefault(key(r), set()).add(r[2])
    return {(*k, rows[k], len(values[k] - {None})) for k in rows}


def as_set(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_rows_and_different_values(rows):
    data = sample()
    got = distinct_by(rows(data, SCHEMA), {"g": "g", "k": "k"}, "x", weight="w")
    assert got.columns == ["g", "k", "n", "distinti"]
    assert as_set(got) == brute(data, lambda r: (r[0], r[1]))
    filled = distinct_by(rows(data, SCHEMA), {"g": "g"}, "x", require=["g"])
    ones = [(*r[:3], 1) for r in data if r[0]]
    assert as_set(filled) == brute(ones, lambda r: (r[0],))


def test_totals_count_a_shared_value_once(rows):
    data = sample()
    got = as_set(distinct_with_totals(rows(data, SCHEMA), {"g": "g", "k": "k"}, "x", weight="w"))
    at = {level: {(*t[:-1],) for t in got if t[-1] == level} for level in (0, 1, 3)}
    assert len(got) == sum(map(len, at.values()))
    assert at[0] == brute(data, lambda r: (r[0], r[1]))
    assert at[1] == brute(data, lambda r: (r[0], None))
    assert at[3] == brute(data, lambda r: (None, None))
    # No sum: the categories share values.
    assert next(iter(at[3]))[-1] < sum(t[-1] for t in at[0])


def test_sketches_are_exact_while_they_hold_all(rows):
    data = sample()
    frame = rows(data, SCHEMA)
    exact = {(*t[:1], t[2]) for t in as_set(distinct_by(frame, {"g": "g"}, "x"))}
    assert as_set(sketch_counts(distinct_sketches(frame, {"g": "g"}, "x"))) == exact
    # Merged from finer ones, whatever their order.
    finer = distinct_sketches(frame, {"g": "g", "k": "k"}, "x")
    assert as_set(sketch_counts(merge_sketches(finer, ["g"]))) == exact
    assert as_set(sketch_counts(merge_sketches(finer.orderBy("k").repartition(3), ["g"]))) == exact


def test_sketches_beyond_that_stay_within_their_error(spark):
    frame = spark.range(200_000).selectExpr("CAST(id % 4 AS string) AS g", "id DIV 2 AS x")
    got = sketch_counts(merge_sketches(distinct_sketches(frame, {"g": "g"}, "x"), []))
    # Four standard errors of 2**-7.
    assert abs(got.first()[0] - 100_000) < 4 * 100_000 / 2**7


def test_sets_compared(rows):
    left = rows([("a", "1"), ("a", "2"), ("a", "2"), (None, "9"), ("l", "1"), ("n", None)], "g string, x string")
    right = rows([("a", "2"), ("a", "3"), (None, "9"), ("r", "")], "g string, x string")
    sides = [distinct_sketches(s, {"g": "g"}, "x") for s in (left, right)]
    got = compare_sketches(*sides, ["g"])
    assert got.columns == ["g", "sinistra", "destra", "entrambi", "unione"]
    assert as_set(got) == {
        ("a", 1, 1, 1, 3), (None, 0, 0, 1, 1), ("l", 1, 0, 0, 1), ("r", 0, 1, 0, 1), ("n", 0, 0, 0, 0),
    }


def test_nothing_to_count(rows):
    empty = rows([], SCHEMA)
    assert distinct_by(empty, {"g": "g"}, "x").isEmpty()
    assert sketch_counts(distinct_sketches(empty, {"g": "g"}, "x")).isEmpty()
    none = distinct_sketches(empty, {"g": "g"}, "x")
    assert compare_sketches(none, none, ["g"]).isEmpty()
    assert distinct_with_totals(empty, {"g": "g"}, "x").isEmpty()


def test_a_category_is_spread_by_its_values(rows):
    """The first shuffle is by key and value, after equal pairs of a task became one."""
    plan = distinct_by(rows(sample(), SCHEMA), {"g": "g"}, "x")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "_of" in exchanges[1] and "_of" not in exchanges[0]
    assert "Python" not in plan


def test_totals_expand_no_values(rows):
    data = [("a", "x", "1"), ("a", "y", "1"), ("a", "x", None), (None, "x", "1"), (None, None, "2"), ("b", "x", "2"), ("b", "x", "2")]
    found = distinct_with_totals(rows(data, "g string, s string, v string"), {"g": "g", "s": "s"}, "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Expand" in line and "_of" in line]
    expected = set()
    for level, key in ((0, lambda g, s: (g, s)), (1, lambda g, s: (g, None)), (3, lambda g, s: (None, None))):
        for k in {key(g, s) for g, s, _ in data}:
            values = [v for g, s, v in data if key(g, s) == k]
            expected.add((*k, len(values), len(set(values) - {None}), level))
    assert {tuple(r) for r in found.collect()} == expected
