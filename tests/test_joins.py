import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadstats.operators import count_by, join_for_count


def fixture(rows, accidents, children):
    return (
        rows(accidents, "ID string, g string"),
        rows(children, "IDProtocollo string, s string"),
    )


def expected(accidents, children):
    out = Counter()
    for i, g in accidents:
        for k, s in children:
            if i == k and i is not None:
                out[(g, s)] += 1
    return out


def counted(a, c):
    joined = join_for_count(a, c, {"g": "g"}, {"s": "s"})
    return Counter({(r["g"], r["s"]): r["n"] for r in count_by(joined, {"g": "g", "s": "s"}, weight="n").collect()})


def test_duplicates_multiply(rows):
    accidents = [("1", "A"), ("1", "A"), ("1", "B"), ("2", "A"), (None, "A"), ("3", "C")]
    children = [("1", "M"), ("1", "M"), ("1", "F"), ("2", None), (None, "M"), ("9", "F")]
    a, c = fixture(rows, accidents, children)
    assert counted(a, c) == expected(accidents, children)


def test_key_of_any_type(rows):
    a = rows([(1, "A"), (2, "B")], "ID bigint, g string")
    c = rows([("1", "M"), ("2", "F")], "IDProtocollo string, s string")
    assert counted(a, c) == {("A", "M"): 1, ("B", "F"): 1}


def hot(n=3000):
    """A third of the rows of both sides share one protocol number."""
    rnd = random.Random(3)
    accidents = [("hot" if i % 3 == 0 else str(i), rnd.choice("AB")) for i in range(n)]
    children = [("hot" if i % 3 == 0 else str(rnd.randrange(n)), rnd.choice("MF")) for i in range(2 * n)]
    return accidents, children


def hot_expected(accidents, children):
    per_key = {}
    for k, s in children:
        per_key.setdefault(k, Counter())[s] += 1
    out = Counter()
    for i, g in accidents:
        for s, n in per_key.get(i, {}).items():
            out[(g, s)] += n
    return out


def test_hot_key_is_counted_and_not_paired(rows):
    accidents, children = hot()
    a, c = fixture(rows, accidents, children)
    joined = join_for_count(a, c, {"g": "g"}, {"s": "s"})
    # 1000 x 2000 pairs of the hot key stay 1000 x 2 weighted rows.
    assert joined.count() <= 2 * len(accidents)
    assert counted(a, c) == hot_expected(accidents, children)


def test_hot_accident_key_is_split(spark, rows, tmp_path):
    """Adaptive execution splits the accident side of a repeated protocol number."""
    accidents, children = hot(60000)
    a, c = fixture(rows, accidents, children)
    # Text that does not compress, so that the hot partition is large in bytes.
    text = F.concat("g", F.sha2(F.monotonically_increasing_id().cast("string"), 512)).alias("x")
    a.select("ID", "g", text).repartition(8).write.parquet(str(tmp_path / "a"))
    c.repartition(8).write.parquet(str(tmp_path / "c"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = join_for_count(
            spark.read.parquet(str(tmp_path / "a")),
            spark.read.parquet(str(tmp_path / "c")),
            {"g": "g", "x": "x"},
            {"s": "s"},
        )
        flat = count_by(joined, {"g": F.substring("x", 1, 1), "s": "s"}, weight="n")
        got = Counter({(r["g"], r["s"]): r["n"] for r in flat.collect()})
        plan = flat._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan
    assert got == hot_expected(accidents, children)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_strategy_does_not_change_the_result(spark, rows, threshold):
    accidents, children = hot(300)
    a, c = fixture(rows, accidents, children)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert counted(a, c) == expected(accidents, children)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
