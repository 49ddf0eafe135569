from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from roadstats.llm.warc import _ranges, _roles, archive_folder, read_record, read_records, write_archives, write_record

PAGES = "page_id long, url string, html string, digest string"
ROWS = [
    (1, "http://a/ä?x=1", "<p>same</p>", "own"),
    (5, "http://b/", "<p>same</p>", "own"),
    (3, None, "<p>same</p>", "own"),
    (2, "http://c/", "", "own"),
    (9, "http://d/", None, "own"),
    (4, "http://e/\r\nWARC-Type: x", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n", "own"),
    (6, "http://f/", "long ß " * 60_000, "own"),
    (None, "http://g/", "only nulls", "own"),
    (None, "http://h/", "<p>same</p>", "own"),
    (7, "http://i/", "twice", "own"),
    (7, "http://i/", "twice", "own"),
]


def expected(rows, least=0):
    largest = {}
    for i, _, html, _ in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    out = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = largest.get(html or "")
        revisit = first is not None and first != i and len(raw) >= least
        out.append((i, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize(
    ("least", "size", "hot"), [(0, 1 << 20, 100_000), (0, 1, 3), (5, 300, 100_000), (5, 300, 2), (1, 1 << 20, 4)]
)
def test_round_trip(spark, least, size, hot):
    pages = spark.createDataFrame(ROWS, PAGES)
    index = write_archives(pages, archive_folder(pages), least_bytes=least, archive_bytes=size, hot_rows=hot)
    rows = read_records(index).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == expected(ROWS, least)
    html = {(r["page_id"], r["url"]): r["payload"] for r in rows if r["record_type"] == "response"}
    assert html[6, "http://f/"].decode() == "long ß " * 60_000
    assert html[4, "http://e/\r\nWARC-Type: x"].decode() == ROWS[5][2]
    if least == 0:
        assert {r["url"] for r in rows} == {u for _, u, _, _ in ROWS}


@pytest.mark.parametrize("hot", [50, 100_000])
def test_a_third_of_the_pages_is_empty(spark, hot):
    rows = [(i, f"http://{i}/", None if i % 3 == 0 else f"<p>{i // 2}</p>", "own") for i in range(600)]
    pages = spark.createDataFrame(rows, PAGES).repartition(8)
    index = write_archives(pages, archive_folder(pages), hot_rows=hot)
    got = read_records(index).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == expected(rows)


def test_html_is_not_dealt_by_its_digest(spark):
    rows = [(i, f"http://{i}/", "same", "own") for i in range(400)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        made = _roles(spark.createDataFrame(rows, PAGES), 0, 100_000)
        sizes = made.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) < 200


def test_index_selects_records(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    index = write_archives(pages, archive_folder(pages))
    some = index.filter(F.col("url").isin("http://c/", "http://f/"))
    assert sorted(r["page_id"] for r in read_records(some).collect()) == [2, 6]


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    index = write_archives(pages, archive_folder(pages))
    assert index.count() == 0 and read_records(index).count() == 0


def test_ranges_are_coalesced():
    entries = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 900, 10), ("b", 0, 50), ("b", 50, 60)]
    assert list(_ranges(entries, gap=10, most=100)) == [
        ("a", 0, [(0, 10), (10, 10), (25, 5)]),
        ("a", 900, [(900, 10)]),
        ("b", 0, [(0, 50)]),
        ("b", 50, [(50, 60)]),
    ]


def test_damage_is_noticed():
    raw = write_record(1, "http://a/", b"payload", None, True, "2000-01-01T00:00:00Z")
    assert read_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        read_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError):
        read_record(raw[:-10])
