import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadstats import schema as S
from roadstats.functions import (
    age_band,
    birth_year,
    driver_age_band,
    java_trim,
    parse_when,
    paving_class,
    paving_class_or_upper,
    time_band,
    weekday_label,
)


def apply(rows, values, fn, kind="string"):
    df = rows([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("x")).collect()]


def test_trim_strips_control_characters(rows):
    values = ["a", " a ", "\ta\n", "\x00a b\x1f", "", "  ", None, "a\u00a0", "\r\na"]
    assert apply(rows, values, java_trim) == [
        "a", "a", "a", "a b", "", "", None, "a\u00a0", "a",
    ]


@pytest.mark.parametrize(
    "age, band",
    [
        (-5, "18-25"), (0, "18-25"), (10, "18-25"), (25, "18-25"), (26, "26-39"), (39, "26-39"),
        (40, "40-69"), (69, "40-69"), (70, "71-99"), (99, "71-99"),
        (100, "non-identificato"), (2016, "non-identificato"),
    ],
)
def test_age_band(rows, age, band):
    assert apply(rows, [2016 - age], age_band, "int") == [band]


def test_age_band_of_text(rows):
    values = ["1990", "1991", "", None, "n.d.", "19x0", " ", "99999999999", "-2147483", "+1980"]
    out = apply(rows, values, lambda c: age_band(birth_year(c)))
    unknown = "non-identificato"
    assert out == [
        "26-39", "18-25", unknown, unknown, unknown, unknown, unknown, unknown, unknown, "26-39",
    ]


def test_age_band_other_year(rows):
    assert apply(rows, [1990], lambda c: age_band(c, 2010), "int") == ["18-25"]


def test_driver_age_band(rows):
    df = rows([("Conducente", 1990), ("Passeggero", 1990), (None, 1990)], "t string, y int")
    got = [r[0] for r in df.select(driver_age_band("t", "y")).collect()]
    assert got == ["26-39", "non-identificato", "non-identificato"]


WHEN = [
    ("03/05/2014 05:59:59", dt.datetime(2014, 5, 3, 5, 59, 59), "Sabato", "0-6"),
    ("31/12/2015 24:00:00", dt.datetime(2016, 1, 1), "Venerdi", "0-6"),
    ("32/01/2016 10:00:00", dt.datetime(2016, 2, 1, 10), "Lunedi", "10-13"),
    ("3/5/2014 7:08:09", dt.datetime(2014, 5, 3, 7, 8, 9), "Sabato", "7-9"),
    ("03/05/2014", dt.datetime(2014, 5, 3), "Sabato", "non-definita"),
    ("03/05/2014 07:08", dt.datetime(2014, 5, 3), "Sabato", "non-definita"),
    ("03/05/2014 07:08:09 xx", dt.datetime(2014, 5, 3, 7, 8, 9), "Sabato", "7-9"),
    ("03/13/2014 09:00:00", dt.datetime(2015, 1, 3, 9), "Sabato", "10-13"),
    ("29/02/2015 25:61:61", dt.datetime(2015, 3, 2, 2, 2, 1), "Lunedi", "0-6"),
    ("\t01/01/2014 01:02:03", dt.datetime(2014, 1, 1, 1, 2, 3), "Mercoledi", "0-6"),
    ("", None, "non-definito", "non-definita"),
    ("n.d.", None, "non-definito", "non-definita"),
    ("1/1/999999", None, "non-definito", "non-definita"),
    ("12345678/1/2014", None, "non-definito", "non-definita"),
    (None, None, "non-definito", "non-definita"),
]


def test_parse_when(rows):
    df = rows([(i, w[0]) for i, w in enumerate(WHEN)], "i int, x string")
    parsed = df.select("i", parse_when("x").alias("w"))
    got = parsed.select(
        "w.ts", weekday_label("w.ts").alias("d"), time_band("w.ts", "w.has_time").alias("b"), "i"
    ).orderBy("i")
    assert [tuple(r)[:3] for r in got.collect()] == [w[1:] for w in WHEN]


def test_parse_when_survives_hostile_numbers(rows):
    values = ["9999/9999/9999 9999:9999:9999", "0/0/0", "9999/0/0 0:0:9999"]
    df = rows([(v,) for v in values], "x string")
    got = df.select(parse_when("x")["ts"].isNotNull()).collect()
    assert [r[0] for r in got] == [True] * 3


@pytest.mark.parametrize(
    "time, band",
    [
        ("05:59:59", "0-6"), ("06:00:00", "7-9"), ("08:59:59", "7-9"), ("09:00:00", "10-13"),
        ("12:59:59", "10-13"), ("13:00:00", "14-17"), ("16:59:59", "14-17"), ("17:00:00", "18-20"),
        ("19:59:59", "18-20"), ("20:00:00", "21-24"), ("23:59:59", "21-24"),
    ],
)
def test_time_band(rows, time, band):
    df = rows([(f"01/02/2010 {time}",)], "x string").select(parse_when("x").alias("w"))
    assert df.select(time_band("w.ts", "w.has_time")).first()[0] == band


def test_paving(rows):
    labels = [(raw, cls) for cls, raws in S.PAVING_CLASSES.items() for raw in raws]
    assert len(labels) == 11
    values = [raw for raw, _ in labels] + ["altro", "", " Asfaltata", None]
    assert apply(rows, values, paving_class) == [c for _, c in labels] + [None] * 4
    assert apply(rows, values, paving_class_or_upper) == [c for _, c in labels] + [
        "ALTRO", "", " ASFALTATA", None,
    ]


def test_expressions_need_no_python(rows):
    df = rows([("x",)], "x string").select(
        java_trim("x"), age_band(birth_year("x")), parse_when("x"), F.upper("x")
    )
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
