"""The nine analyses. Each has a flat form (one row per count) and, where the
result is a document, a ``*_documents`` form nested from it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats import schema as S
from roadstats.functions import (
    age_band,
    birth_year,
    driver_age_band,
    is_filled,
    java_trim,
    parse_when,
    paving_class,
    paving_class_or_upper,
    time_band,
    weekday_label,
)
from roadstats.operators import (
    baseline_from_counts,
    bucket_counts,
    count_by,
    count_dimensions,
    distinct_by,
    distinct_sketches,
    distinct_with_totals,
    essential_rules,
    filter_rules,
    itemsets,
    join_for_count,
    mine_rules,
    months_by,
    nest,
    nest_dimensions,
    nest_map,
    rank_in_group,
    score_rules,
    top_values,
    with_totals,
    with_trend,
)
from roadstats.scratch import written


def accidents_by_group(accidents: DataFrame) -> DataFrame:
    """Accidents per municipality."""
    return count_by(
        accidents, {"Municipio": java_trim("Gruppo")}, "NumIncidenti", require=["Municipio"]
    )


def types_by_group(accidents: DataFrame) -> DataFrame:
    """Accident types per municipality, ranked by count."""
    keys = {"Gruppo": java_trim("Gruppo"), "TipoIncidente": java_trim("NaturaIncidente")}
    counts = count_by(accidents, keys, "n", require=list(keys))
    return rank_in_group(counts, ["Gruppo"], "n", ["TipoIncidente"])


def types_documents(accidents: DataFrame) -> DataFrame:
    keys = {"Gruppo": java_trim("Gruppo"), "TipoIncidente": java_trim("NaturaIncidente")}
    counts = count_by(accidents, keys, "n", require=list(keys))
    fields = {"TipoIncidente": "TipoIncidente", "Count": "n"}
    return nest(counts, ["Gruppo"], fields, ["Info"], count="n")


def _times(accidents: DataFrame) -> DataFrame:
    when = accidents.select(
        java_trim("Gruppo").alias("Gruppo"), parse_when(java_trim("DataOraIncidente")).alias("w")
    )
    keys = {
        "Gruppo": "Gruppo",
        "Giorno": weekday_label("w.ts"),
        "FasciaOraria": time_band("w.ts", "w.has_time"),
    }
    return count_by(when, keys, "n", require=["Gruppo"])


def types_by_period(accidents: DataFrame) -> DataFrame:
    """Accident types per municipality and year; accidents without a readable date have no year."""
    when = parse_when(java_trim("DataOraIncidente"))
    keys = {
        "Gruppo": java_trim("Gruppo"),
        "TipoIncidente": java_trim("NaturaIncidente"),
        "period": F.coalesce(F.date_format(when["ts"], "yyyy"), F.lit("ignoto")),
    }
    return count_by(accidents, keys, "n", require=["Gruppo", "TipoIncidente"])


def times_by_group(accidents: DataFrame) -> DataFrame:
    """Weekday and time band per municipality; bands ranked within the weekday."""
    return rank_in_group(_times(accidents), ["Gruppo", "Giorno"], "n", ["FasciaOraria"])


def times_documents(accidents: DataFrame, total: str | None = None) -> DataFrame:
    """``total`` names a field for the accidents of each day and municipality."""
    fields = {"FasciaOraria": "FasciaOraria", "Count": "n"}
    return nest(_times(accidents), ["Gruppo", "Giorno"], fields, ["Info", "Info"], count="n", total=total)


def times_with_totals(accidents: DataFrame) -> DataFrame:
    """The counts of weekday and time band, those of the days and municipalities, and all."""
    return with_totals(_times(accidents), ["Gruppo", "Giorno", "FasciaOraria"])


def conditions_by_group(accidents: DataFrame) -> DataFrame:
    """Paving, traffic and signage per municipality; only municipalities with all three."""
    dims = {"Pavimentazione": paving_class, "Traffico": java_trim, "Segnaletica": java_trim}
    return count_dimensions(accidents, "Gruppo", dims, java_trim, require_all=True)


def conditions_documents(accidents: DataFrame) -> DataFrame:
    labels = {"Pavimentazione": "Tipo", "Traffico": "Intensita", "Segnaletica": "Tipo"}
    return nest_dimensions(conditions_by_group(accidents), "Gruppo", labels)


_PEDESTRIAN_DIMS = ["Segnaletica", "Visibilita", "Illuminazione"]


def pedestrian_conditions_by_group(accidents: DataFrame, pedestrians: DataFrame) -> DataFrame:
    """Signage, visibility and lighting of pedestrian accidents, one count per pedestrian."""
    cols = {c: c for c in ["Gruppo", *_PEDESTRIAN_DIMS]}
    joined = join_for_count(accidents.filter(is_filled("Gruppo")), pedestrians, cols)
    dims = {d: F.col for d in _PEDESTRIAN_DIMS}
    return count_dimensions(joined, "Gruppo", dims, out="Municipio", weight="n")


def pedestrian_documents(accidents: DataFrame, pedestrians: DataFrame) -> DataFrame:
    flat = pedestrian_conditions_by_group(accidents, pedestrians)
    return nest_map(flat, "Municipio", _PEDESTRIAN_DIMS)


def _driving(accidents: DataFrame, persons: DataFrame, reference_year: int) -> DataFrame:
    """Drivers with their accident's number, counted by ``join_for_count``."""
    joined = join_for_count(
        accidents.filter(is_filled("Gruppo")),
        persons.filter(F.col("TipoPersona") == S.DRIVER),
        {"Municipio": "Gruppo", "ID": "ID"},
        {"FasciaEta": age_band(birth_year("AnnoNascita"), reference_year), "Sesso": "Sesso"},
    )
    return joined.withColumn("Sesso", F.coalesce("Sesso", F.lit("")))


_DRIVER_KEYS = {c: c for c in ["Municipio", "FasciaEta", "Sesso"]}


def _drivers(accidents: DataFrame, persons: DataFrame, reference_year: int) -> DataFrame:
    return count_by(_driving(accidents, persons, reference_year), _DRIVER_KEYS, "n", weight="n")


def drivers_accidents(
    accidents: DataFrame, persons: DataFrame, totals: bool = False, reference_year: int = S.REFERENCE_YEAR
) -> DataFrame:
    """Drivers per municipality, age band and sex, and the accidents that they were in.

    Two drivers of one band in one accident are two drivers and one accident. With
    ``totals`` also those of the bands and municipalities, and all.
    """
    counted = distinct_with_totals if totals else distinct_by
    rows = _driving(accidents, persons, reference_year)
    return counted(rows, _DRIVER_KEYS, "ID", "NumIncidenti", weight="n")


def accident_sketches_by_period(accidents: DataFrame) -> DataFrame:
    """Sketches of the accidents' numbers per municipality, type and year, to be kept and merged."""
    when = parse_when(java_trim("DataOraIncidente"))
    keys = {
        "Gruppo": java_trim("Gruppo"),
        "TipoIncidente": java_trim("NaturaIncidente"),
        "period": F.coalesce(F.date_format(when["ts"], "yyyy"), F.lit("ignoto")),
    }
    return distinct_sketches(accidents, keys, "ID", require=["Gruppo", "TipoIncidente"])


def drivers_by_group(
    accidents: DataFrame, persons: DataFrame, reference_year: int = S.REFERENCE_YEAR
) -> DataFrame:
    """Drivers per municipality, age band and sex; sexes ranked within the band."""
    flat = _drivers(accidents, persons, reference_year)
    return rank_in_group(flat, ["Municipio", "FasciaEta"], "n", ["Sesso"])


def drivers_documents(
    accidents: DataFrame,
    persons: DataFrame,
    reference_year: int = S.REFERENCE_YEAR,
    total: str | None = None,
) -> DataFrame:
    """``total`` names a field for the drivers of each band and municipality."""
    flat = _drivers(accidents, persons, reference_year)
    fields = {"Sesso": "Sesso", "Count": "n"}
    return nest(flat, ["Municipio", "FasciaEta"], fields, ["info", "Info"], count="n", total=total)


def types_by_month(accidents: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Accidents per municipality, type and month without gaps, with moving mean and change on the year."""
    rows = accidents.select(
        java_trim("Gruppo").alias("Gruppo"),
        java_trim("NaturaIncidente").alias("TipoIncidente"),
        parse_when(java_trim("DataOraIncidente")).alias("w"),
    )
    keys = ["Gruppo", "TipoIncidente"]
    return with_trend(months_by(rows, {k: k for k in keys}, "w.ts", first, last, require=keys), keys)


def busiest_accidents(accidents: DataFrame, persons: DataFrame, k: int = 10) -> DataFrame:
    """The accidents with the most persons of every municipality."""
    cols = {"Gruppo": java_trim("Gruppo"), "ID": "ID"}
    joined = written(join_for_count(accidents.filter(is_filled("Gruppo")), persons, cols), "joined")
    return top_values(joined, {"Gruppo": "Gruppo"}, "ID", k, "NumPersone", require=["Gruppo"], weight="n")


def accident_days(accidents: DataFrame) -> DataFrame:
    """``Gruppo, giorno, period`` of the accidents with a known day, written: it is read several times."""
    when = parse_when(java_trim("DataOraIncidente"))["ts"]
    rows = accidents.select(java_trim("Gruppo").alias("Gruppo"), F.to_date(when).alias("giorno"))
    rows = written(rows, "days").filter(F.col("giorno").isNotNull())
    return rows.withColumn("period", F.date_format("giorno", "yyyy"))


def worst_days(days: DataFrame, k: int = 10, summary: DataFrame | None = None) -> DataFrame:
    """The days of :func:`accident_days` with the most accidents of every municipality.

    ``summary`` are the merged counts of :func:`day_buckets_by_period` for the same days.
    """
    out = top_values(days, {"Gruppo": "Gruppo"}, "giorno", k, require=["Gruppo"], summary=summary)
    return out.withColumnRenamed("valore", "giorno")


def day_buckets_by_period(days: DataFrame) -> DataFrame:
    """Bucket counts of the days of :func:`accident_days` per municipality and year, to be kept and merged."""
    return bucket_counts(days, {"Gruppo": "Gruppo", "period": "period"}, "giorno", require=["Gruppo"])


def drivers_with_totals(
    accidents: DataFrame, persons: DataFrame, reference_year: int = S.REFERENCE_YEAR
) -> DataFrame:
    """The counts of drivers, those of the bands and municipalities, and all."""
    return with_totals(_drivers(accidents, persons, reference_year), ["Municipio", "FasciaEta", "Sesso"])


def makes_by_type(accidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicles per make, accident type and road surface."""
    joined = join_for_count(
        accidents,
        vehicles.filter(is_filled("Marca")),
        {
            "TipoIncidente": F.coalesce("NaturaIncidente", F.lit("")),
            "FondoStradale": F.coalesce("FondoStradale", F.lit("")),
        },
        {"Marca": "Marca"},
    )
    keys = {c: c for c in ["Marca", "TipoIncidente", "FondoStradale"]}
    return count_by(joined, keys, "NumIncidenti", weight="n")


def makes_with_totals(accidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicles per make, type and surface, and the totals over any of the three."""
    keys = ["Marca", "TipoIncidente", "FondoStradale"]
    return with_totals(makes_by_type(accidents, vehicles), keys, "NumIncidenti", every=True)


def makes_accidents(accidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Vehicles per make and accident type, and the accidents that they were in."""
    joined = join_for_count(
        accidents,
        vehicles.filter(is_filled("Marca")),
        {"TipoIncidente": F.coalesce("NaturaIncidente", F.lit("")), "ID": "ID"},
        {"Marca": "Marca"},
    )
    keys = {c: c for c in ["Marca", "TipoIncidente"]}
    return distinct_by(joined, keys, "ID", "NumIncidenti", "NumVeicoli", weight="n")


def makes_documents(accidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    flat = makes_by_type(accidents, vehicles).withColumnRenamed("Marca", "MarcaMacchina")
    fields = {"FondoStradale": "FondoStradale", "NumIncidenti": "NumIncidenti"}
    return nest(flat, ["MarcaMacchina", "TipoIncidente"], fields, ["Incidenti", "Condizioni"])


def _in_groups(accidents: DataFrame, groups: Sequence[str] | None) -> DataFrame:
    return accidents if groups is None else accidents.filter(F.col("Gruppo").isin(list(groups)))


def scenario_itemsets(
    accidents: DataFrame,
    groups: Sequence[str] | None = None,
    tag_fields: bool = False,
    counted: bool = True,
) -> DataFrame:
    """Itemsets of paving class, lighting and accident type, one per accident.

    ``counted`` gives one row per combination with its number of accidents.
    """
    rows, weight = _in_groups(accidents, groups), None
    if counted:
        raw = ["Pavimentazione", "Illuminazione", "NaturaIncidente"]
        rows, weight = count_by(rows, {c: c for c in raw}, "n"), "n"
    fields: dict[str, Column | str] = {
        "Pavimentazione": paving_class_or_upper("Pavimentazione"),
        "Illuminazione": "Illuminazione",
        "NaturaIncidente": "NaturaIncidente",
    }
    return itemsets(rows, fields, tag_fields, weight)


def scenario_rules(
    accidents: DataFrame,
    groups: Sequence[str] | None = None,
    engine: str = "auto",
    baseline: DataFrame | None = None,
    score: str = "inverse_log",
) -> DataFrame:
    """Rules between lighting, paving and accident type, scored by inverse log."""
    sets = scenario_itemsets(accidents, groups, counted=engine != "fpgrowth")
    rules = filter_rules(mine_rules(sets, engine=engine), min_antecedent=2)
    return score_rules(rules, baseline, score)


def driver_itemsets(
    accidents: DataFrame,
    persons: DataFrame,
    groups: Sequence[str] | None = None,
    tag_fields: bool = False,
    reference_year: int = S.REFERENCE_YEAR,
    counted: bool = True,
) -> DataFrame:
    """Itemsets of municipality, accident type, sex and age band of drivers, one per person.

    ``counted`` gives one row per combination with its number of persons.
    """
    band = driver_age_band("TipoPersona", birth_year("AnnoNascita"), reference_year)
    accident_cols: dict[str, Column | str] = {
        "Gruppo": "Gruppo",
        "NaturaIncidente": "NaturaIncidente",
    }
    accidents = _in_groups(accidents, groups)
    fields = {c: c for c in ["Gruppo", "NaturaIncidente", "Sesso", "FasciaEta"]}
    weight = None
    if counted:
        joined = join_for_count(
            accidents, persons, accident_cols, {"Sesso": "Sesso", "FasciaEta": band}
        )
        joined, weight = count_by(joined, fields, "n", weight="n"), "n"
    else:
        # Counted before the join like the others, and listed only after it.
        joined = join_for_count(
            accidents, persons, accident_cols, {"Sesso": "Sesso", "FasciaEta": band}
        )
        joined = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return itemsets(joined, fields, tag_fields, weight)


def driver_rules(
    accidents: DataFrame,
    persons: DataFrame,
    baseline: DataFrame | None = None,
    threshold: float = 0.1,
    groups: Sequence[str] | None = None,
    engine: str = "auto",
    reference_year: int = S.REFERENCE_YEAR,
) -> DataFrame:
    """Rules from municipality, sex and age band to accident type, relative to its frequency.

    Without a ``baseline`` the frequencies are taken from all accidents.
    """
    if baseline is None:
        baseline = baseline_from_counts(accidents, "NaturaIncidente")
    sets = driver_itemsets(
        accidents, persons, groups, reference_year=reference_year, counted=engine != "fpgrowth"
    )
    rules = filter_rules(mine_rules(sets, engine=engine), min_antecedent=3)
    return score_rules(rules, baseline, "ratio", threshold)


def wide_itemsets(accidents: DataFrame) -> DataFrame:
    """Itemsets of all described fields of an accident and its time, counted by municipality."""
    raw = [
        "Pavimentazione",
        "Illuminazione",
        "NaturaIncidente",
        "Segnaletica",
        "Visibilita",
        "Traffico",
        "FondoStradale",
    ]
    when = parse_when(java_trim("DataOraIncidente"))
    keys: dict[str, Column | str] = {"Gruppo": java_trim("Gruppo"), **{c: c for c in raw}}
    rows = accidents.select("*", when.alias("w"))
    keys |= {"Giorno": weekday_label("w.ts"), "FasciaOraria": time_band("w.ts", "w.has_time")}
    counted = count_by(rows, keys, "n", require=["Gruppo"])
    fields: dict[str, Column | str] = {c: F.nullif(F.col(c), F.lit("")) for c in [*raw, "Giorno", "FasciaOraria"]}
    fields["Pavimentazione"] = paving_class("Pavimentazione")
    return itemsets(counted, fields, tag_fields=True, weight="n", keep=["Gruppo"])


def scenario_rules_by_group(
    accidents: DataFrame,
    score: str = "inverse_log",
    min_support: float = 0.0,
    essential: bool = False,
    min_antecedent: int = 2,
) -> DataFrame:
    """The scenario rules of every municipality, mined in one pass over the accidents.

    With ``min_support`` a rule's items must occur together in that share of the
    municipality's accidents; with ``essential`` rules go that a shorter antecedent gives.
    """
    raw = ["Gruppo", "Pavimentazione", "Illuminazione", "NaturaIncidente"]
    counted = count_by(accidents, {c: c for c in raw}, "n")
    counted = counted.withColumn("Gruppo", java_trim("Gruppo")).filter(is_filled("Gruppo"))
    fields: dict[str, Column | str] = {
        "Pavimentazione": paving_class_or_upper("Pavimentazione"),
        "Illuminazione": "Illuminazione",
        "NaturaIncidente": "NaturaIncidente",
    }
    sets = itemsets(counted, fields, weight="n", keep=["Gruppo"])
    rules = mine_rules(sets, min_support, by=["Gruppo"])
    if essential:
        # The rules are read twice, the accidents once.
        rules = essential_rules(written(rules, "rules"), ["Gruppo"])
    return score_rules(filter_rules(rules, min_antecedent), None, score)


def driver_rules_by_group(
    accidents: DataFrame,
    persons: DataFrame,
    baseline: DataFrame | None = None,
    threshold: float = 0.1,
    reference_year: int = S.REFERENCE_YEAR,
) -> DataFrame:
    """Rules from sex and age band to accident type of every municipality, in one pass.

    They are relative to the types' frequencies among all accidents or in ``baseline``.
    """
    if baseline is None:
        baseline = baseline_from_counts(accidents, "NaturaIncidente")
    band = driver_age_band("TipoPersona", birth_year("AnnoNascita"), reference_year)
    joined = join_for_count(
        accidents.filter(is_filled("Gruppo")),
        persons,
        {"Gruppo": "Gruppo", "NaturaIncidente": "NaturaIncidente"},
        {"Sesso": "Sesso", "FasciaEta": band},
    )
    fields = ["Gruppo", "NaturaIncidente", "Sesso", "FasciaEta"]
    counted = count_by(joined, {c: c for c in fields}, "n", weight="n")
    sets = itemsets(counted, {c: c for c in fields[1:]}, weight="n", keep=["Gruppo"])
    rules = filter_rules(mine_rules(sets, by=["Gruppo"]), min_antecedent=2)
    return score_rules(rules, baseline, "ratio", threshold)
