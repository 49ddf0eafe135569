from pyspark.sql import functions as F

from roadstats.operators import childless_keys, integrity, key_presence, orphan_keys


def presence(accidents, children):
    acc = accidents(*[{"ID": i} for i in ("1", "2", "2", "3", None)])
    return key_presence(
        acc,
        {
            "persone": children("persone", *[{"IDProtocollo": i} for i in ("1", "1", "2", "9", "9", None)]),
            "pedoni": children("pedoni", {"IDProtocollo": "1"}),
            "veicoli": children("veicoli"),
        },
    )


def test_presence_orphans_and_childless(accidents, children):
    found = presence(accidents, children)
    assert {tuple(r) for r in found.collect()} == {
        ("1", 1, 2, 1, 0), ("2", 2, 1, 0, 0), ("3", 1, 0, 0, 0), ("9", 0, 2, 0, 0), (None, 1, 1, 0, 0),
    }
    assert {tuple(r) for r in orphan_keys(found, "persone").collect()} == {("9", 2), (None, 1)}
    assert orphan_keys(found, "pedoni").isEmpty()
    assert {tuple(r) for r in childless_keys(found).collect()} == {("3", 1), (None, 1)}


def test_integrity_rows(accidents, children):
    got = {r["entita"]: tuple(r)[1:] for r in integrity(presence(accidents, children)).collect()}
    assert got == {
        "incidenti": (5, 3, 1, 1, 1, 2),
        "persone": (6, 3, 1, 2, 1, 3),
        "pedoni": (1, 1, 0, 0, 0, 0),
        "veicoli": (0, 0, 0, 0, 0, 0),
    }


def test_no_rows(accidents, children):
    none = key_presence(accidents(), {"persone": children("persone")})
    assert {tuple(r) for r in integrity(none).collect()} == {("incidenti", 0, 0, 0, 0, 0, 0), ("persone", 0, 0, 0, 0, 0, 0)}


def test_one_shuffle_and_a_hot_key(spark):
    rows = spark.range(0, 30_000, numPartitions=6)
    acc = rows.filter("id % 3 = 0").selectExpr("cast(id AS string) AS ID")
    # A third of the children have one number.
    persons = rows.selectExpr("if(id % 3 = 1, '0', cast(id AS string)) AS IDProtocollo")
    found = key_presence(acc, {"persone": persons})
    row = found.filter(F.col("chiave") == "0").first()
    assert (row["incidenti"], row["persone"]) == (1, 10_001)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") > 0 and "partial_sum" in plan
    assert orphan_keys(found, "persone").count() == 10_000


def test_equals_the_joins(accidents, children):
    acc = accidents(*[{"ID": str(i % 40)} for i in range(50)])
    cars = children("veicoli", *[{"IDProtocollo": str(i * 7 % 60)} for i in range(90)])
    found = key_presence(acc, {"veicoli": cars})
    anti = cars.join(acc, F.col("IDProtocollo") == F.col("ID"), "left_anti")
    assert anti.count() == (orphan_keys(found, "veicoli").agg(F.sum("n")).first()[0] or 0)
    outer = acc.select("ID").distinct().join(cars.select("IDProtocollo").distinct(), F.col("IDProtocollo") == F.col("ID"), "full_outer")
    assert outer.count() == found.count()
