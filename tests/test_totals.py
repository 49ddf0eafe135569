import json

import pytest

from roadstats.operators import nest, with_totals
from roadstats.sources import as_json

SCHEMA = "a string, b string, n long"
DATA = [("x", "p", 2), ("x", None, 3), ("y", "p", 5), (None, "p", 7)]


def test_rollup_tells_null_values_from_totals(rows):
    got = {tuple(r) for r in with_totals(rows(DATA, SCHEMA), ["a", "b"]).collect()}
    assert got == {
        ("x", "p", 2, 0), ("x", None, 3, 0), ("y", "p", 5, 0), (None, "p", 7, 0),
        ("x", None, 5, 1), ("y", None, 5, 1), (None, None, 7, 1), (None, None, 17, 3),
    }


def test_every_subset_of_keys(rows):
    got = {tuple(r) for r in with_totals(rows(DATA, SCHEMA), ["a", "b"], every=True).collect()}
    assert {r for r in got if r[3] == 2} == {(None, "p", 14, 2), (None, None, 3, 2)}


def test_no_rows_have_no_total(rows):
    assert with_totals(rows([], SCHEMA), ["a", "b"]).isEmpty()


def test_records_are_read_once(spark):
    from test_jobs import plan_of

    for name, scans in (("times_totals", 1), ("drivers_totals", 2), ("makes_cube", 3)):
        plan = plan_of(spark, name)
        assert plan.count("FileScan") == scans and plan.count("Expand") == 1


def test_nested_totals(rows):
    flat = rows([("x", "p", "k", 2), ("x", "p", "l", 3), ("x", "q", "k", 4)], "a string, b string, c string, n long")
    doc = as_json(nest(flat, ["a", "b"], {"c": "c", "n": "n"}, ["bs", "cs"], count="n", total="t")).first()["doc"]
    assert json.loads(doc) == {
        "a": "x", "t": 9, "bs": [
            {"b": "p", "t": 5, "cs": [{"c": "l", "n": 3}, {"c": "k", "n": 2}]},
            {"b": "q", "t": 4, "cs": [{"c": "k", "n": 4}]},
        ],
    }
    with pytest.raises(ValueError):
        nest(flat, ["a"], {"c": "c"}, ["cs"], total="t")
