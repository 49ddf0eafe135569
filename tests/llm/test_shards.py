from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from roadstats.llm.shards import sampled_shards

from .conftest import ODD


def check(docs, rows, n_shards):
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert set(shards) <= set(range(n_shards))
    for held in shards.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    return {s: sum(r["size"] for r in held) for s, held in shards.items()}


@pytest.mark.parametrize("n_shards", [4, 40])
def test_the_tables(spark, n_shards):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in frame.collect()]
    rows = sampled_shards(frame, n_shards).collect()
    sums = check(docs, rows, n_shards)
    share, largest = sum(sums.values()) / n_shards, max(r["size"] for r in rows)
    assert len(sums) == n_shards
    assert all(abs(s - share) <= largest for s in sums.values())


def test_copies_stay_together(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, frame.collect()))
    where = defaultdict(set)
    for r in sampled_shards(frame, 8).collect():
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_hot_group_is_subdivided(documents):
    """A third of all rows has one text; shards stay near equal and no record is lost."""
    docs = [(i, "the same text") for i in range(1000)] + [(1000 + i, f"text number {i} of many") for i in range(2000)]
    rows = sampled_shards(documents(*docs), 10, sample=500).collect()
    sums = check(docs, rows, 10)
    assert max(sums.values()) - min(sums.values()) <= 200


def test_shards_do_not_depend_on_partitions(documents):
    frame = documents(*[(i, f"text {i % 70} " * (i % 9)) for i in range(300)])
    a = sampled_shards(frame.repartition(3), 5).select("doc_id", "shard", "slot").collect()
    b = sampled_shards(frame.repartition(7), 5).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)


def test_odd_rows_and_empty_table(documents):
    check(ODD, sampled_shards(documents(*ODD), 3).collect(), 3)
    assert sampled_shards(documents((1, "x")).limit(0), 3).count() == 0
    assert [tuple(r) for r in sampled_shards(documents((1, "x")), 3).select("doc_id", "slot").collect()] == [(1, 0)]
