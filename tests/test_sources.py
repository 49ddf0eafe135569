import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats import schema as S
from roadstats.operators import count_by, recode_groups
from roadstats.sources import (
    bad_baseline,
    corrupt_records,
    good_records,
    hidden_files,
    load,
    load_baseline,
    parse_records,
    read_clean_lines,
    read_entity,
    read_raw,
    repair_lines,
    save_documents,
    save_rules,
    unrouted_lines,
    validation_counts,
    write_clean_lines,
)


def raw_tree(root):
    files = {
        "dati_2014_05/Incidenti_maggio.json": [
            '{"Incidenti":[',
            '{"ID":"1","Gruppo":" 3 ","NaturaIncidente":"urto "grave" laterale","Meteo":"sereno"},',
            '{"ID":"2","Gruppo":"4","NaturaIncidente":"a"},',
            '{"ID":"3","Gruppo":"4',
            "]}",
        ],
        "dati bis_2014_06/veicoli.txt": ['{"IDProtocollo":"1","Marca":"FIAT"},'],
        "dati_2014_06/Persone.json": ['{"IDProtocollo":"1","Sesso":"M"}', '{"IDProtocollo":7,"Sesso":"F"},'],
        "dati_2014_06/persone.csv": ['{"IDProtocollo":"not read"}'],
        "altro/pedoni.txt": ['{"IDProtocollo":"1"},'],
        "altro/note.txt": ["ID di nessuno"],
    }
    for name, lines in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\r\n".join(lines) + "\n")
    return str(root)


def test_read_raw_routes_files(spark, tmp_path):
    lines = read_raw(spark, raw_tree(tmp_path))
    got = {(r["entity"], r["period"]): r["n"] for r in count_by(lines, {"entity": "entity", "period": "period"}).collect()}
    assert got == {
        ("incidenti", "2014_05"): 5, ("veicoli", "2014_06"): 1, ("persone", "2014_06"): 2,
        ("pedoni", None): 1, (None, None): 1,
    }


def test_files_of_other_entities_are_not_read(spark, tmp_path):
    df = read_entity(spark, raw_tree(tmp_path), "pedoni")
    assert [r["IDProtocollo"] for r in df.collect()] == ["1"]
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1


def test_read_entity_keeps_corrupt_lines(spark, tmp_path):
    extra = T.StructType([T.StructField("Meteo", T.StringType())])
    df = read_entity(spark, raw_tree(tmp_path), "incidenti", extra=extra)
    good = {r["ID"]: r for r in good_records(df).collect()}
    assert good["1"]["NaturaIncidente"] == "urto grave laterale"
    assert good["1"]["Gruppo"] == " 3 " and good["1"]["Meteo"] == "sereno"
    assert good["2"]["Meteo"] is None
    assert [r["_corrupt_record"] for r in corrupt_records(df).collect()] == ['{"ID":"3","Gruppo":"4']
    clean = good_records(read_entity(spark, raw_tree(tmp_path), "incidenti", clean_strings=True))
    assert {r["Gruppo"] for r in clean.collect()} == {"3", "4"}


def test_validation_checks_every_line(spark, tmp_path):
    lines = repair_lines(read_raw(spark, raw_tree(tmp_path)).filter("entity IS NOT NULL"))
    got = {r["entity"]: (r["good"], r["corrupt"]) for r in validation_counts(lines).collect()}
    assert got == {"incidenti": (2, 1), "veicoli": (1, 0), "persone": (2, 0), "pedoni": (1, 0)}


def test_clean_lines_replace_only_their_period(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = repair_lines(read_raw(spark, raw_tree(tmp_path / "raw")))
    write_clean_lines(lines, out)
    write_clean_lines(lines.filter("entity = 'persone'").limit(1), out)
    counts = {
        (r["entity"], r["period"]): r["count"]
        for r in read_clean_lines(spark, out).groupBy("entity", "period").count().collect()
    }
    assert counts == {
        ("incidenti", "2014_05"): 3, ("veicoli", "2014_06"): 1, ("persone", "2014_06"): 1,
        ("pedoni", None): 1,
    }
    only = read_clean_lines(spark, out, "veicoli")
    assert [json.loads(r["value"]) for r in only.collect()] == [{"IDProtocollo": "1", "Marca": "FIAT"}]
    assert "entity" in only._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1][:60]


def test_parse_reads_numbers_as_text(rows):
    df = rows([('{"IDProtocollo":7,"Sesso":null}',), ("nothing",), (None,)], "value string")
    parsed = parse_records(df, S.ENTITIES["persone"])
    assert [r["IDProtocollo"] for r in good_records(parsed).collect()] == ["7", None]
    assert corrupt_records(parsed).count() == 1


def test_load_formats(spark, rows, tmp_path):
    df = rows([(1, "Fiat ", "x"), (2, None, "y")], "IDProtocollo bigint, Marca string, Colore string")
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).save(path)
        got = load(spark, "veicoli", path, fmt)
        assert got.schema == S.ENTITIES["veicoli"]
        assert {tuple(r) for r in got.collect()} == {("1", "Fiat "), ("2", None)}
        extra = S.text_schema("Colore")
        assert load(spark, "veicoli", path, fmt, keep_extra=True, extra=extra).columns[-1] == "Colore"
        assert load(spark, "veicoli", path, fmt, clean_strings=True).filter("Marca = 'Fiat'").count() == 1
    assert load(spark, "persone", str(tmp_path / "parquet")).select("Sesso").distinct().count() == 1


def test_load_reads_only_used_columns(spark, rows, tmp_path):
    path = str(tmp_path / "p")
    rows([("1", "a", "b")], "ID string, Gruppo string, Traffico string").write.parquet(path)
    df = count_by(load(spark, "incidenti", path), {"Gruppo": "Gruppo"}, require=["Gruppo"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Gruppo:string>" in plan
    assert "IsNotNull(Gruppo)" in plan


def test_baseline_file(spark, tmp_path):
    path = tmp_path / "base.txt"
    path.write_text("urto,0.25\nribaltamento,0.5\n")
    got = {tuple(r) for r in load_baseline(spark, str(path)).collect()}
    assert got == {("urto", 0.25), ("ribaltamento", 0.5)}
    path.write_text("urto,0.25\nsenza\nx,25%\n")
    with pytest.raises(PySparkException, match="unreadable baseline line"):
        load_baseline(spark, str(path)).collect()
    bad = {tuple(r) for r in bad_baseline(spark, str(path)).collect()}
    assert bad == {("senza", None), ("x", "25%")}
    with pytest.raises(ValueError):
        load(spark, "veicoli", str(path), "json", keep_extra=True)


def test_several_records_in_a_line(rows):
    lines = {
        '{"ID":"1"},{"ID":"2"}': ["1", "2"],
        '{"ID":"5"}{"ID":"6"}': ["5", "6"],
        '{"ID":"7"} {"ID":"8","Gruppo":"a}{b"}': ["7", "8"],
        '[{"ID":"9"}]': ["9"],
        '{"ID":"10"} e altro': None,
        '{"ID":"11"': None,
        '{"ID":"12"},5': None,
        "": None,
    }
    for line, ids in lines.items():
        parsed = parse_records(rows([(line,)], "value string"), S.ENTITIES["incidenti"])
        good = [r["ID"] for r in good_records(parsed).collect()]
        assert good == (ids or [])
        assert corrupt_records(parsed).count() == (ids is None)
    two = rows([("incidenti", '{"ID":"7"} {"ID":"8","Gruppo":"a}{b"}')], "entity string, value string")
    counts = validation_counts(two).first()
    assert (counts["good"], counts["corrupt"]) == (2, 0)


def test_charset_hidden_and_unrouted_files(spark, tmp_path):
    folder = tmp_path / "dati_2015"
    folder.mkdir()
    (folder / "incidenti.txt").write_bytes('{"ID":"1","Gruppo":"velocità"},\n'.encode("latin-1"))
    (folder / "note.txt").write_text("a\nb\n")
    rows = good_records(read_entity(spark, str(tmp_path), "incidenti", charset="ISO-8859-1")).collect()
    assert [r["Gruppo"] for r in rows] == ["velocità"]
    assert [r["n"] for r in unrouted_lines(read_raw(spark, str(tmp_path))).collect()] == [2]
    (folder / "_incidenti.json").write_text("{}")
    assert [x.rsplit("/", 1)[1] for x in hidden_files(spark, str(tmp_path))] == ["_incidenti.json"]
    with pytest.raises(ValueError, match="_incidenti.json"):
        read_raw(spark, str(tmp_path))
    assert read_raw(spark, str(tmp_path), hidden="skip").count() == 3


def test_a_period_without_records_is_replaced(spark, rows, tmp_path):
    schema = "entity string, period string, value string"
    raw = rows([("persone", "2014", '{"ID":"1"},'), ("persone", "2015", '{"ID":"2"},')], schema)
    write_clean_lines(repair_lines(raw), str(tmp_path / "out"), raw=raw)
    again = rows([("persone", "2014", "nothing")], schema)
    write_clean_lines(repair_lines(again), str(tmp_path / "out"), raw=again)
    left = read_clean_lines(spark, str(tmp_path / "out")).collect()
    assert [(r["period"], r["value"]) for r in left] == [("2015", '{"ID":"2"}')]


def test_documents_are_overwritten(spark, rows, tmp_path):
    path = str(tmp_path / "docs")
    df = rows([("1", [("a", 2)])], "Gruppo string, Info array<struct<Tipo:string,Count:bigint>>")
    save_documents(df, path)
    save_documents(df.withColumn("Gruppo", F.lit("2")), path)
    text = [r[0] for r in spark.read.text(path).collect()]
    assert text == ['{"Gruppo":"2","Info":[{"Tipo":"a","Count":2}]}']
    save_documents(df, path, mode="append", fmt="json")
    assert spark.read.text(path).count() == 2
    save_documents(df, str(tmp_path / "pq"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).collect() == df.collect()


def test_save_rules_counts_lines(spark, rows, tmp_path):
    scored = rows(
        [(["a", "b"], ["c"], 0.5, 2.0), (["a"], ["c"], 0.5, 0.125)],
        "antecedent array<string>, consequent array<string>, confidence double, score double",
    )
    path = str(tmp_path / "rules")
    assert save_rules(scored, path) == 2
    assert {r[0] for r in spark.read.text(path).collect()} == {"[a, b] => [c], 2.0", "[a] => [c], 0.125"}


def test_recode_groups(spark, rows):
    day = dt.datetime(2013, 3, 11)
    acc = rows(
        [("2", dt.datetime(2012, 1, 1)), ("2", day), ("9", dt.datetime(2012, 1, 1)), ("2", None)],
        "Gruppo string, ts timestamp_ntz",
    )
    cw = spark.createDataFrame([("2", "1", day), ("3", "2", day)], S.CROSSWALK)
    got = [r["Gruppo"] for r in recode_groups(acc, cw, "ts").collect()]
    assert sorted(got) == ["1", "2", "2", "9"]
    # Two reforms of one group: the next one after the accident counts, once.
    early = dt.datetime(2012, 1, 1)
    more = cw.unionByName(spark.createDataFrame([("2", "0", early), ("2", "x", None)], S.CROSSWALK))
    old = rows([("2", dt.datetime(2011, 1, 1)), ("2", early), ("2", day)], "Gruppo string, ts timestamp_ntz")
    assert [r["Gruppo"] for r in recode_groups(old, more, "ts").orderBy("ts").collect()] == ["0", "1", "2"]
