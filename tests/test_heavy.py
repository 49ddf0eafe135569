import random

import pytest

from roadstats.operators import bucket_counts, merge_buckets, top_values

SCHEMA = "g string, x string, w long"


def sample(n=3000, seed=5):
    """A third of the rows in one group, half of these with one value; NULLs, empty texts, ties and a long tail."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(("hot", "same" if i % 2 else f"v{rnd.randint(0, 900)}", 1))
        else:
            x = rnd.choice([None, "", "a", "b", f"v{int(rnd.paretovariate(0.6)) % 2000}"])
            out.append((rnd.choice(["p", "q", "", None]), x, rnd.randint(1, 4)))
    return out


def brute(data, k, keep=lambda r: True):
    counts = {}
    for r in filter(keep, data):
        group = counts.setdefault(r[0], {})
        group[r[1]] = group.get(r[1], 0) + r[2]
    out = set()
    for g, values in counts.items():
        # NULL comes first, as in Spark's ascending order.
        order = sorted(values.items(), key=lambda v: (-v[1], v[0] is not None, v[0] or ""))
        out |= {(g, x, n, i + 1) for i, (x, n) in enumerate(order[:k])}
    return out


def as_set(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("buckets", [1, 3, 64, 4096])
@pytest.mark.parametrize("k", [1, 7])
def test_exact_with_any_number_of_buckets(rows, buckets, k):
    data = sample()
    got = top_values(rows(data, SCHEMA), {"g": "g"}, "x", k, weight="w", buckets=buckets)
    assert got.columns == ["g", "valore", "n", "pos"]
    assert as_set(got) == brute(data, k)


def test_more_places_than_values(rows):
    data = sample(60)
    assert as_set(top_values(rows(data, SCHEMA), {"g": "g"}, "x", 500, weight="w", buckets=8)) == brute(data, 500)


def test_ties_at_the_last_place(rows):
    data = [("g", f"v{i:03}", 2) for i in range(300)] + [("g", "z", 3)]
    assert as_set(top_values(rows(data, SCHEMA), {"g": "g"}, "x", 5, weight="w", buckets=16)) == brute(data, 5)


def test_required_values_and_names(rows):
    data = sample(900)
    got = top_values(rows(data, SCHEMA), {"grp": "g"}, "x", 3, "c", "p", ["grp", "valore"], "w", buckets=32)
    assert got.columns == ["grp", "valore", "c", "p"]
    assert as_set(got) == brute(data, 3, lambda r: r[0] and r[1])


def test_without_group_or_rows(rows):
    data = [("g", x, 1) for _, x, _ in sample(500)]
    got = top_values(rows(data, SCHEMA), {}, "x", 4, buckets=16)
    assert as_set(got) == {r[1:] for r in brute(data, 4)}
    assert top_values(rows([], SCHEMA), {"g": "g"}, "x", 4).collect() == []


def test_bounds_hold_and_do_not_grow_with_the_values(rows):
    data = [("g", f"v{i}", 1) for i in range(5000)] + [("g", "v7", 1)] * 800
    found = bucket_counts(rows(data, SCHEMA), {"g": "g"}, "x", buckets=50).collect()
    assert len(found) <= 100
    # Each hash row counts every record once, and one bucket of each holds the frequent value.
    for i in (0, 1):
        of_row = [r["n"] for r in found if r["riga"] == i]
        assert sum(of_row) == len(data) and max(of_row) >= 801


def test_a_merged_summary_serves_as_one_made_at_once(rows):
    data = sample()
    left, right = rows(data[:1000], SCHEMA), rows(data[1000:], SCHEMA)
    kept = bucket_counts(left, {"g": "g"}, "x", "c", weight="w").unionByName(
        bucket_counts(right, {"g": "g"}, "x", "c", weight="w")
    )
    summary = merge_buckets(kept, ["g"], "c")
    got = top_values(left.unionByName(right), {"g": "g"}, "x", 5, "c", weight="w", summary=summary)
    assert as_set(got) == brute(data, 5)


def test_only_values_near_the_top_are_counted(rows, monkeypatch):
    """Of 20,000 values, those that get past the buckets are few."""
    from roadstats.operators import heavy

    seen = []
    count = heavy.count_by

    def spy(df, keys, *args, **kwargs):
        if "valore" in keys:
            seen.append(df.select(*keys).distinct().count())
        return count(df, keys, *args, **kwargs)

    monkeypatch.setattr(heavy, "count_by", spy)
    data = [("g", f"v{i}", 1) for i in range(20000)] + [("g", f"top{i}", 400 + i) for i in range(5)]
    got = top_values(rows(data, SCHEMA), {"g": "g"}, "x", 5, weight="w", buckets=1024)
    assert as_set(got) == brute(data, 5)
    assert seen[0] < 600 and seen[-1] < 60
