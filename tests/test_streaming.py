import os

import pytest
from pyspark.errors import StreamingQueryException

from roadstats.sources import read_raw, repair_lines
from roadstats.streaming import ingest_report, ingest_stream, stored_lines, stream_raw, take_in

DELIVERY = r"/consegna_([^/]+)/"


@pytest.fixture
def place(tmp_path):
    """``put(name, *lines)`` writes a raw file; the other three are folders of one ingest."""

    def put(name, *lines):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{x}\n" for x in lines))

    return put, *(str(tmp_path / n) for n in ("raw", "store", "checkpoint"))


def record(i, via="VIA"):
    return f'{{"ID":"{i}","Via":"{via}"}},'


def as_list(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one_shot(spark, raw):
    return as_list(repair_lines(read_raw(spark, raw)).select("value", "file_path", "entity", "period"))


def test_batches_and_a_restart_equal_one_shot(spark, place):
    put, raw, store, checkpoint = place
    put("r_2014_05/Incidenti.json", '{"Incidenti":[', record(1), record(2, 'a "b" c'), "]}")
    put("r_2014_05/Persone.json", '{"IDProtocollo":"1"}')
    put("r_2014_05/note.txt", record(9))
    take_in(spark, raw, store, checkpoint, files_a_batch=1)
    assert as_list(stored_lines(spark, store)) == one_shot(spark, raw)
    assert len(os.listdir(f"{checkpoint}/commits")) >= 3
    put("r_2014_06/Incidenti.json", record(3), record(3))
    put("r_2014_05/Incidenti_2.json", record(4), '{"ID":"5')
    put("r_2014_05/tabella.csv", record(6))
    take_in(spark, raw, store, checkpoint)
    got = as_list(stored_lines(spark, store))
    assert got == one_shot(spark, raw) and len(got) == 8
    # Nothing new: nothing changes.
    take_in(spark, raw, store, checkpoint)
    assert as_list(stored_lines(spark, store)) == got
    accidents = stored_lines(spark, store, "incidenti")
    assert accidents.count() == 6
    assert "PartitionFilters: [isnotnull(entity" in accidents._jdf.queryExecution().executedPlan().toString()


def test_a_batch_that_fails_is_run_again(spark, place, tmp_path):
    put, raw, store, checkpoint = place
    put("r_2014_05/Incidenti.json", record(1))
    take_in(spark, raw, store, checkpoint)
    put("r_2014_06/Incidenti.json", record(2), record(3))
    # The batch breaks off after its offsets are logged and before it is committed.
    stop = "CASE WHEN value LIKE '%\"3\"%' THEN raise_error('lost') ELSE value END AS value"
    broken = stream_raw(spark, raw).selectExpr(stop, "file_path", "entity", "period")
    with pytest.raises(StreamingQueryException):
        ingest_stream(broken, store, checkpoint).awaitTermination()
    assert stored_lines(spark, store).count() == 1
    # A file that comes in between is not mixed into the batch, and is not lost.
    put("r_2014_07/Incidenti.json", record(4))
    take_in(spark, raw, store, checkpoint)
    assert as_list(stored_lines(spark, store)) == one_shot(spark, raw)
    assert stored_lines(spark, store).count() == 4


def test_a_batch_whose_commit_was_lost_adds_nothing_twice(spark, place):
    put, raw, store, checkpoint = place
    put("r_2014_05/Incidenti.json", record(1))
    take_in(spark, raw, store, checkpoint)
    put("r_2014_06/Incidenti.json", record(2))
    take_in(spark, raw, store, checkpoint)
    # The sink has the last batch, the driver was lost before it noted so.
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    take_in(spark, raw, store, checkpoint)
    assert as_list(stored_lines(spark, store)) == one_shot(spark, raw)


def test_a_period_delivered_again_replaces_the_earlier(spark, place):
    put, raw, store, checkpoint = place
    put("consegna_1/r_2014_05/Incidenti.json", record(1), record(2))
    put("consegna_1/r_2014_05/Incidenti_2.json", record(3))
    put("consegna_1/r_2014_06/Incidenti.json", record(4), '{"ID":"5')
    put("consegna_1/r_2014_06/Persone.json", '{"IDProtocollo":"4"}')
    put("consegna_1/roma/Incidenti.json", record(6))
    put("r_2014_05/Incidenti.json", record(0))
    take_in(spark, raw, store, checkpoint)
    put("consegna_2/r_2014_05/Incidenti.json", record(1, "NUOVA"))
    put("consegna_2/r_2014_06/Persone.json", '{"Persone":[')
    put("consegna_2/roma/Incidenti.json", record(7))
    take_in(spark, raw, store, checkpoint)
    lines = stored_lines(spark, store, delivery=DELIVERY)
    assert sorted(r["value"] for r in lines.collect()) == sorted([
        record(1, "NUOVA")[:-1], record(4)[:-1], '{"ID":"5', record(6)[:-1], record(7)[:-1],
    ])
    assert as_list(ingest_report(spark, store, DELIVERY)) == sorted([
        ("incidenti", "2014_05", 1, 1, 0), ("incidenti", "2014_06", 1, 1, 1),
        ("persone", "2014_06", 1, 0, 0), ("incidenti", None, 2, 2, 0),
    ], key=repr)
    # Without a name for deliveries all lines stay.
    assert as_list(stored_lines(spark, store)) == one_shot(spark, raw)


def test_nothing_to_take_in(spark, place):
    put, raw, store, checkpoint = place
    put("r_2014_05/Incidenti.json")
    take_in(spark, raw, store, checkpoint)
    assert stored_lines(spark, store).isEmpty() and ingest_report(spark, store, DELIVERY).isEmpty()
    put("r_2014_05/_Incidenti.json", record(1))
    with pytest.raises(ValueError, match="does not read"):
        take_in(spark, raw, store, checkpoint)
    take_in(spark, raw, store, checkpoint, hidden="skip")


def test_a_stream_is_narrow(spark, place):
    put, raw, store, checkpoint = place
    put("r_2014_05/Incidenti.json", record(1))
    lines = stream_raw(spark, raw)
    assert lines.isStreaming
    plan = lines._jdf.queryExecution().logical().toString()
    assert "Aggregate" not in plan and "Python" not in plan


def test_last_delivery_is_found_without_moving_lines(spark, tmp_path):
    data = [("ID 1", "/c_1/a_x/i.json", "i", "x"), ("ID 2", "/c_2/a_x/i.json", "i", "x"), ("ID 3", "/a/i.json", "i", None), (None, "/c_1/n", None, "x")]
    spark.createDataFrame(data, "value string, file_path string, entity string, period string").write.parquet(f"{tmp_path}/s")
    found = stored_lines(spark, f"{tmp_path}/s", delivery=r"/c_(\d)/")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # Lines become files before the largest name is looked for.
    assert plan.count("partial_count") == 1
    assert sorted(r.value for r in found.collect()) == ["ID 2", "ID 3"]
