import pytest
from pyspark.errors import PySparkException

from roadstats.scratch import scratch
from roadstats.sources import apply_changes, count_changes, period_counts, replace_periods, save_period_counts

KEYS = ["g"]
SCHEMA = "g string, n long, period string"


def as_set(df):
    return {tuple(r) for r in df.collect()}


def state(spark, path):
    return as_set(period_counts(spark, path, SCHEMA).select("period", "g", "n"))


def test_replacing_a_period_equals_a_recount(spark, rows):
    path = scratch(spark, "counts")
    save_period_counts(rows([("a", 2, "p1"), ("b", 3, "p1"), ("a", 5, "p2"), (None, 1, "p2")], SCHEMA), path)
    totals = rows([("a", 7), ("b", 3), (None, 1)], "g string, n long")
    # p1 comes again without b, p2 is lost, p3 is new.
    after = replace_periods(rows([("a", 4, "p1"), ("c", 1, "p3")], SCHEMA), totals, path, KEYS, gone=["p2"])
    assert as_set(after) == {("a", 4), ("c", 1)}
    assert state(spark, path) == {("p1", "a", 4), ("p3", "c", 1)}
    # Taking in the same again changes nothing.
    again = replace_periods(rows([("a", 4, "p1"), ("c", 1, "p3")], SCHEMA), after, path, KEYS, gone=["p2"])
    assert as_set(again) == {("a", 4), ("c", 1)}
    assert state(spark, path) == {("p1", "a", 4), ("p3", "c", 1)}


def test_changes_meet_in_one_aggregation(rows):
    before = rows([("a", 2), ("b", 3), (None, 1)], "g string, n long")
    after = rows([("a", 2), ("b", 1), ("c", 4)], "g string, n long")
    assert as_set(count_changes(before, after, KEYS)) == {("b", -2), ("c", 4), (None, -1)}
    assert as_set(apply_changes(before, count_changes(before, after, KEYS), KEYS)) == as_set(after)


def test_more_taken_away_than_counted(rows):
    with pytest.raises(PySparkException):
        apply_changes(rows([("a", 2)], "g string, n long"), rows([("a", -3)], "g string, n long"), KEYS).collect()


def test_only_the_delivered_periods_are_read(spark, rows):
    path = scratch(spark, "counts")
    save_period_counts(rows([("a", 2, "p1"), ("a", 5, "p2")], SCHEMA), path)
    old = period_counts(spark, path, SCHEMA).filter("period IN ('p1')")
    # The filter on the period is one of folders: of the rows only ``n`` is tested.
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "= p1)], PushedFilters: [IsNotNull(n)]" in plan and "Filter isnotnull(n" in plan
    assert as_set(old.select("g", "n")) == {("a", 2)}
