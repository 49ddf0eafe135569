import random

from pyspark.sql import functions as F

from roadstats.functions import java_trim
from roadstats.operators import (
    count_by,
    count_dimensions,
    nest,
    nest_dimensions,
    nest_map,
    rank_in_group,
    top_groups,
)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_count_by_guards_and_weights(rows):
    df = rows(
        [("1", "a", 2), ("1 ", "a", 3), ("", "a", 1), (None, "b", 1), ("2", None, 4)],
        "g string, v string, w bigint",
    )
    keys = {"g": java_trim("g"), "v": "v"}
    assert as_set(count_by(df, keys, "n", require=["g"])) == {("1", "a", 2), ("2", None, 1)}
    assert as_set(count_by(df, keys, "n", require=["g", "v"], weight="w")) == {("1", "a", 5)}


def test_sum_of_counts_is_number_of_kept_rows(rows):
    rnd = random.Random(1)
    data = [(rnd.choice(["1", "2", "", None]), rnd.choice("xyz")) for _ in range(500)]
    df = rows(data, "g string, v string")
    got = count_by(df, {"g": "g", "v": "v"}, "n", require=["g"]).agg(F.sum("n")).first()[0]
    assert got == sum(1 for g, _ in data if g)


def test_counts_are_64_bit(rows):
    df = rows([("a", 2**31), ("a", 2**31)], "g string, w bigint")
    assert count_by(df, {"g": "g"}, weight="w").first()["n"] == 2**32


DIMS = {"p": F.col, "q": java_trim}


def test_count_dimensions(rows):
    df = rows(
        [("1", "a", "x "), ("1", "a", "x"), ("1 ", "", "y"), ("2", "b", None), ("", "b", "x")],
        "g string, p string, q string",
    )
    flat = count_dimensions(df, "g", DIMS, java_trim, out="G")
    assert as_set(flat) == {
        ("1", "p", "a", 2), ("1", "q", "x", 2), ("1", "q", "y", 1), ("2", "p", "b", 1),
    }
    every = count_dimensions(df, "g", DIMS, java_trim, out="G", require_all=True)
    assert {r[0] for r in every.collect()} == {"1"}


def test_rank_ties_by_label(rows):
    df = rows([("g", "b", 2), ("g", "a", 2), ("g", "c", 5), ("h", "z", 1)], "g string, v string, n int")
    got = {(r["g"], r["v"]): r["pos"] for r in rank_in_group(df, ["g"], "n", ["v"]).collect()}
    assert got == {("g", "c"): 1, ("g", "a"): 2, ("g", "b"): 3, ("h", "z"): 1}


def test_top_groups(rows):
    df = rows([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "g string, n int")
    assert [r[0] for r in top_groups(df, "g", "n", 3).collect()] == ["b", "c", "d"]


def test_nest_and_unnest(rows):
    rnd = random.Random(2)
    flat = {
        (g, d, b): rnd.randint(1, 9)
        for g in "ABC" for d in "xyz" for b in "pqrs" if rnd.random() < 0.6
    }
    df = rows([(*k, n) for k, n in flat.items()], "g string, d string, b string, n bigint")
    docs = nest(df, ["g", "d"], {"Band": "b", "Count": "n"}, ["Info", "Info"], count="n")
    back = {}
    for doc in docs.collect():
        assert [e["d"] for e in doc["Info"]] == sorted(e["d"] for e in doc["Info"])
        for day in doc["Info"]:
            order = [(-b["Count"], b["Band"]) for b in day["Info"]]
            assert order == sorted(order)
            back.update({(doc["g"], day["d"], b["Band"]): b["Count"] for b in day["Info"]})
    assert back == flat


def test_nest_without_count_sorts_by_fields(rows):
    df = rows([("g", "b", 1), ("g", "a", 9)], "g string, v string, n bigint")
    doc = nest(df, ["g"], {"v": "v", "n": "n"}, ["items"]).first()
    assert [tuple(e) for e in doc["items"]] == [("a", 9), ("b", 1)]


def test_nest_dimensions_and_map(rows):
    df = rows(
        [("1", "p", "b", 2), ("1", "p", "a", 1), ("1", "q", "z", 3)],
        "g string, dim string, valore string, n bigint",
    )
    doc = nest_dimensions(df, "g", {"p": "Tipo", "q": "Intensita"}).first().asDict(True)
    assert doc == {
        "g": "1",
        "p": [{"Tipo": "a", "Count": 1}, {"Tipo": "b", "Count": 2}],
        "q": [{"Intensita": "z", "Count": 3}],
    }
    info = nest_map(df, "g", ["p", "q", "r"]).first()["info"].asDict()
    assert info == {"p": {"a": 1, "b": 2}, "q": {"z": 3}, "r": {}}
