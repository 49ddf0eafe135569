import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException

from roadstats.operators import months_by, with_trend

SCHEMA = "g string, t timestamp_ntz"


def as_dict(df):
    got = df.collect()
    out = {(r["g"], r["mese"]): r for r in got}
    assert len(out) == len(got)
    return out


def test_every_group_has_all_months(rows):
    data = [
        ("a", datetime(2015, 11, 30, 23, 59)), ("a", datetime(2016, 1, 1)), ("a", datetime(2016, 1, 31)),
        (None, datetime(2015, 12, 5)), ("", datetime(2015, 12, 1)), ("b", None),
    ]
    got = as_dict(months_by(rows(data, SCHEMA), {"g": "g"}, "t"))
    months = [date(2015, 11, 1), date(2015, 12, 1), date(2016, 1, 1)]
    counts = {"a": [1, 0, 2], None: [0, 1, 0], "": [0, 1, 0]}
    assert {k: r["n"] for k, r in got.items()} == {(g, m): n for g, c in counts.items() for m, n in zip(months, c)}
    filled = months_by(rows(data, SCHEMA), {"g": "g"}, "t", require=["g"])
    assert {r["g"] for r in filled.collect()} == {"a"}


def test_a_given_period(rows):
    data = [("a", datetime(2014, 1, 1)), ("a", datetime(2015, 3, 31, 12)), ("b", datetime(2016, 1, 1)), ("c", datetime(9999, 1, 1))]
    got = as_dict(months_by(rows(data, SCHEMA), {"g": "g"}, "t", date(2015, 2, 10), date(2015, 4, 20)))
    assert {k: r["n"] for k, r in got.items()} == {
        ("a", date(2015, 2, 1)): 0, ("a", date(2015, 3, 1)): 1, ("a", date(2015, 4, 1)): 0,
    }


def test_trend_against_enumeration(rows):
    rnd = random.Random(1)
    # One group with a third of all rows; months without rows in each.
    data = [
        ("hot" if i % 3 == 0 else rnd.choice("abcd"), datetime(rnd.choice([2013, 2014, 2016]), rnd.randint(1, 12), 3))
        for i in range(300)
    ]
    counts = Counter((g, t.year * 12 + t.month - 1) for g, t in data)
    first, last = min(m for _, m in counts), max(m for _, m in counts)
    got = as_dict(with_trend(months_by(rows(data, SCHEMA), {"g": "g"}, "t"), ["g"]))
    assert len(got) == 5 * (last - first + 1)
    for (g, day), r in got.items():
        m = day.year * 12 + day.month - 1
        frame = [counts[g, k] for k in range(max(first, m - 11), m + 1)]
        before = counts[g, m - 12] if m - 12 >= first else None
        assert (r["n"], r["anno_prima"]) == (counts[g, m], before)
        assert r["media"] == pytest.approx(sum(frame) / len(frame))
        assert r["variazione"] == (pytest.approx(r["n"] / before - 1) if before else None)


def test_frames_are_months_and_not_rows(rows):
    gaps = rows([("a", date(2015, 1, 1), 5), ("a", date(2015, 3, 1), 7), ("a", date(2016, 3, 1), 14)], "g string, mese date, n long")
    got = as_dict(with_trend(gaps, ["g"], window=2))
    assert [(r["media"], r["anno_prima"], r["variazione"]) for _, r in sorted(got.items())] == [
        (5.0, None, None), (7.0, None, None), (14.0, 7, 1.0),
    ]


def test_weighted_rows(rows):
    data = rows([("a", datetime(2015, 1, 2), 4), ("a", datetime(2015, 1, 3), 3)], SCHEMA + ", w long")
    assert [tuple(r) for r in months_by(data, {"g": "g"}, "t", weight="w").collect()] == [("a", date(2015, 1, 1), 7)]


def test_a_stray_date_is_refused(rows):
    data = rows([("a", datetime(14, 1, 1)), ("a", datetime(2015, 1, 1))], SCHEMA)
    with pytest.raises(PySparkException, match="months"):
        months_by(data, {"g": "g"}, "t").collect()
    assert months_by(data, {"g": "g"}, "t", first=date(2006, 1, 1)).count() == 109


def test_no_rows(rows):
    for data in ([], [("a", None)]):
        assert with_trend(months_by(rows(data, SCHEMA), {"g": "g"}, "t"), ["g"]).isEmpty()
