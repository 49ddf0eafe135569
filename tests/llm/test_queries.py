"""The registered queries on whole small tables, against SQL where there is some."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from roadstats.llm.oracle import ORACLE
from roadstats.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    frame = QUERIES[name](spark, SF)
    result = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(result, key=str)


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, len(QUERIES) + 1)]


@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] in ("op2", "op6", "op8", "op9")])
def test_a_row_for_each_document(spark, name):
    ids = [r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    docs = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(docs)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    before, quality, near, cut, mixed, packed = seen
    for frame in (quality, near, cut, mixed):
        assert frame.dtypes == docs.dtypes
    ids = [{r[0] for r in f.select("doc_id").collect()} for f in seen]
    assert ids[0] > ids[1] > ids[2] >= ids[3] > ids[4] == ids[5]
    assert quality.count() == len(ids[1]) and near.count() == len(ids[2])
    # A passage of 50 bytes is left in one document only.
    held = {}
    for doc_id, text in cut.select("doc_id", "text").collect():
        for i in range(len(text) - 49):
            held.setdefault(text[i : i + 50], set()).add(doc_id)
    texts = dict(near.select("doc_id", "text").collect())
    joined = [s for s, d in held.items() if len(d) > 1 and sum(s in texts[i] for i in d) > 1]
    assert not joined
    assert packed.agg({"length": "max"}).first()[0] <= 1024


def test_stages_take_rows_without_id_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("n_chars > 300").limit(30)
    odd = some.unionByName(some).unionByName(
        spark.createDataFrame([(None, " ".join(f"lone{i}" for i in range(60)), None, None, 400)], docs.schema)
    )
    near = corpus_pipeline.near_duplicates(spark, odd, SF)
    ids = [r[0] for r in near.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None in ids
    cut = corpus_pipeline.repeated_passages(spark, odd, SF)
    assert cut.filter("doc_id IS NULL").count() == 1 and cut.dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_runs_twice_alike(spark):
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())
