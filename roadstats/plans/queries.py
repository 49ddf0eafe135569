"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
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
from roadstats.functions.repair import (
    FEW_QUOTES,
    MANY_QUOTES,
    file_entity,
    file_period,
    is_raw_file,
    normalise_line,
    strip_stray_quotes,
)
from roadstats.operators import (
    baseline_from_counts,
    baseline_from_rules,
    childless_keys,
    compare_sketches,
    count_by,
    count_itemsets,
    distinct_sketches,
    essential_rules,
    filter_rules,
    integrity,
    join_for_count,
    key_presence,
    mark_itemsets,
    merge_buckets,
    merge_sketches,
    mine_rules,
    orphan_keys,
    recode_groups,
    rule_lines,
    score_rules,
    significant_rules,
    sketch_counts,
    top_groups,
    top_values,
    with_totals,
)
from roadstats.plans import jobs
from roadstats.plans.views import view
from roadstats.scratch import scratch, written
from roadstats.sources import (
    as_json,
    good_records,
    load,
    load_baseline,
    parse_records,
    period_counts,
    read_clean_lines,
    read_raw,
    repair_lines,
    replace_periods,
    save_documents,
    save_period_counts,
    save_rules,
    unrouted_lines,
    validation_counts,
    write_clean_lines,
)
from roadstats.streaming import ingest_report, stored_lines, take_in

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(items: str) -> F.Column:
    return F.array_join(items, " + ")


def _flat_rules(rules: DataFrame, *rest: str) -> DataFrame:
    return rules.select(
        _joined("antecedent").alias("antecedent"), F.col("consequent")[0].alias("consequent"), *rest
    )


# --- the nine analyses, flat -------------------------------------------------


@query
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.accidents_by_group(view(spark, sf_dir, "incidenti"))


@query
def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.types_by_group(view(spark, sf_dir, "incidenti"))


@query
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.times_by_group(view(spark, sf_dir, "incidenti"))


@query
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.conditions_by_group(view(spark, sf_dir, "incidenti"))


@query
def pedestrian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pedestrian_conditions_by_group(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "pedoni")
    )


@query
def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drivers_by_group(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))


@query
def makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.makes_by_type(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "veicoli"))


@query
def scenario_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.scenario_rules(view(spark, sf_dir, "incidenti"))
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("score"))


@query
def scenario_rules_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.scenario_rules(view(spark, sf_dir, "incidenti"), engine="fpgrowth")
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("score"))


@query
def driver_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.driver_rules(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("ratio"))


@query
def driver_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a threshold that removes rules."""
    rules = jobs.driver_rules(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"), threshold=1.2
    )
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("ratio"))


@query
def driver_rules_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.driver_rules(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"), engine="fpgrowth"
    )
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("ratio"))


@query
def driver_rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the frequencies from a baseline file, in which each type is listed twice."""
    accidents, path = view(spark, sf_dir, "incidenti"), scratch(spark, "baseline")
    listed = baseline_from_counts(accidents, "NaturaIncidente")
    listed.unionByName(listed.withColumn("freq", F.col("freq") / 2)).write.csv(path)
    rules = jobs.driver_rules(accidents, view(spark, sf_dir, "persone"), load_baseline(spark, path))
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("ratio"))


@query
def scenario_rules_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rules with a score of one's own."""
    rules = filter_rules(mine_rules(jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))), 2)
    scored = score_rules(rules, score=lambda confidence, baseline: confidence * confidence)
    return _flat_rules(scored, "confidence", F.round("score", 9).alias("score"))


@query
def scenario_rules_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rules of every municipality in one run."""
    rules = jobs.scenario_rules_by_group(view(spark, sf_dir, "incidenti"))
    return _flat_rules(rules, "Gruppo", "confidence", F.round("score", 9).alias("score"))


@query
def driver_rules_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex and age rules of every municipality in one run."""
    rules = jobs.driver_rules_by_group(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    return _flat_rules(rules, "Gruppo", "confidence", F.round("score", 9).alias("ratio"))


@query
def driver_rules_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within single municipalities."""
    rules = jobs.driver_rules(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"), groups=["7", "8"]
    )
    return _flat_rules(rules, "confidence", F.round("score", 9).alias("ratio"))


# --- the same as documents ---------------------------------------------------


@query
def group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(group_count(spark, sf_dir))


@query
def nested_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(jobs.types_documents(view(spark, sf_dir, "incidenti")))


@query
def nested_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(jobs.times_documents(view(spark, sf_dir, "incidenti")))


@query
def nested_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(jobs.conditions_documents(view(spark, sf_dir, "incidenti")))


@query
def nested_pedestrian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(
        jobs.pedestrian_documents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "pedoni"))
    )


@query
def nested_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(
        jobs.drivers_documents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    )


@query
def nested_makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(
        jobs.makes_documents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "veicoli"))
    )


# --- itemsets, baselines, scores, text ---------------------------------------


@query
def itemset_accident(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"), counted=False)
    return sets.select(_joined("items").alias("items"))


@query
def itemset_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = jobs.driver_itemsets(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"), counted=False
    )
    return sets.select(_joined("items").alias("items"))


@query
def itemset_person_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = jobs.driver_itemsets(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    return count_by(sets, {"items": _joined("items")}, "n", weight="n")


@query
def itemset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every itemset of lighting, paving and type with at least two items."""
    found = count_itemsets(jobs.scenario_itemsets(view(spark, sf_dir, "incidenti")), min_items=2)
    return found.select(_joined("items").alias("items"), "n")


@query
def itemset_counts_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"), tag_fields=True)
    return count_itemsets(sets).select(_joined("items").alias("items"), "n")


@query
def itemset_counts_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemsets with a minimum support, from the counted rows."""
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))
    found = count_itemsets(sets, min_items=2, min_support=0.02)
    return found.select(_joined("items").alias("items"), "n")


@query
def rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule between lighting, paving and type, one or two antecedent items."""
    return _flat_rules(
        mine_rules(jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))), "confidence"
    )


@query
def rules_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))
    return _flat_rules(mine_rules(sets, min_confidence=0.25), "confidence")


@query
def baseline_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_from_counts(view(spark, sf_dir, "incidenti"), "NaturaIncidente")


@query
def baseline_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of each type on asphalt under one kind of lighting."""
    rules = mine_rules(jobs.scenario_itemsets(view(spark, sf_dir, "incidenti")))
    return baseline_from_rules(rules, ["Asfaltata", "ill 1"])


@query
def scenario_rules_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rules relative to the optimal scenario instead of by inverse log."""
    accidents = view(spark, sf_dir, "incidenti")
    rules = mine_rules(jobs.scenario_itemsets(accidents))
    baseline = baseline_from_rules(rules, ["Asfaltata", "ill 1"])
    scored = score_rules(filter_rules(rules, min_antecedent=2), baseline, "ratio")
    return _flat_rules(scored, F.round("score", 9).alias("score"))


@query
def rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.driver_rules(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    return rule_lines(rules.withColumn("score", F.round("score", 4).cast("decimal(18,4)")))


@query
def scenario_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rules as text lines with the inverse-log score; infinite scores as such."""
    rules = jobs.scenario_rules(view(spark, sf_dir, "incidenti"))
    number = F.round("score", 4).try_cast("decimal(18,4)").cast("string")
    return rule_lines(rules.withColumn("score", F.coalesce(number, F.lit("Infinity"))))


@query
def rules_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver rules written as text, read back, with the number that the sink reports."""
    rules = jobs.driver_rules(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    path = scratch(spark, "rules")
    kept = save_rules(rules.withColumn("score", F.round("score", 4).cast("decimal(18,4)")), path)
    return spark.read.text(path).withColumn("kept", F.lit(kept).cast("long"))


# --- scalars over whole columns ----------------------------------------------


@query
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "incidenti")
    padded = F.concat(F.lit("\t \n"), "Gruppo", F.lit("\r "))
    return rows.select("ID", java_trim(padded).alias("Gruppo"))


@query
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "persone")
    keys = {
        "AnnoNascita": "AnnoNascita",
        "FasciaEta": age_band(birth_year("AnnoNascita")),
        "FasciaConducente": driver_age_band("TipoPersona", birth_year("AnnoNascita")),
    }
    return count_by(rows, keys)


@query
def when_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "incidenti").select("ID", parse_when("DataOraIncidente").alias("w"))
    return rows.select(
        "ID",
        F.col("w.ts").alias("ts"),
        weekday_label("w.ts").alias("Giorno"),
        time_band("w.ts", "w.has_time").alias("FasciaOraria"),
    )


@query
def paving_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {
        "Pavimentazione": "Pavimentazione",
        "classe": paving_class("Pavimentazione"),
        "classe_o_testo": paving_class_or_upper("Pavimentazione"),
    }
    return count_by(view(spark, sf_dir, "incidenti"), keys)


@query
def top_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_groups(group_count(spark, sf_dir), "Municipio", "NumIncidenti", 3)


@query
def group_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    accidents = view(spark, sf_dir, "incidenti").select(
        java_trim("Gruppo").alias("Gruppo"), parse_when("DataOraIncidente")["ts"].alias("ts")
    )
    recoded = recode_groups(accidents, view(spark, sf_dir, "crosswalk"), "ts")
    return count_by(recoded, {"Gruppo": "Gruppo"}, require=["Gruppo"])


@query
def clean_group_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers per group after trimming every text once on load."""
    path = scratch(spark, "incidenti")
    view(spark, sf_dir, "incidenti").write.parquet(path)
    accidents = load(spark, "incidenti", path, clean_strings=True)
    return jobs.drivers_by_group(accidents, view(spark, sf_dir, "persone"))


# --- raw files ---------------------------------------------------------------


@query
def quotes_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "grezzi")
    return rows.select("file_path", strip_stray_quotes("value", FEW_QUOTES).alias("value"))


@query
def quotes_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "grezzi")
    return rows.select("file_path", strip_stray_quotes("value", MANY_QUOTES).alias("value"))


@query
def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "grezzi")
    return rows.select("entity", "k", normalise_line("value").alias("value"))


@query
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines left after repair, by entity."""
    return count_by(repair_lines(view(spark, sf_dir, "grezzi")), {"entity": "entity"})


_RAW_FIELDS = {
    "incidenti": ("ID", "Via", "NaturaIncidente", "Gruppo"),
    "persone": ("IDProtocollo", "Sesso", "Nome"),
}


def _both_entities(lines: DataFrame, *rest: str) -> DataFrame:
    """The good records of both entities: ``entity``, ``rest``, and their fields by place."""
    out = None
    for entity, names in _RAW_FIELDS.items():
        own = lines.filter(F.col("entity") == entity).select("entity", *rest, "value")
        parsed = good_records(parse_records(own, S.text_schema(*names)))
        cells = [F.col(n) for n in names] + [F.lit(None).cast("string")] * (4 - len(names))
        flat = parsed.select(
            "entity", *rest, *[c.alias(n) for c, n in zip(cells, ("chiave", "uno", "due", "tre"), strict=True)]
        )
        out = flat if out is None else out.unionByName(flat)
    return out


@query
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw lines of both entities, repaired and parsed."""
    return _both_entities(repair_lines(view(spark, sf_dir, "grezzi").select("entity", "value")))


@query
def corrupt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_counts(repair_lines(view(spark, sf_dir, "grezzi")))


@query
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "grezzi").select("file_path")
    keys = {"entity": file_entity("file_path"), "period": file_period("file_path")}
    return count_by(rows.filter(is_raw_file("file_path")), keys)


@query
def unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that name no entity, by file."""
    rows = view(spark, sf_dir, "grezzi").select("value", "file_path").filter(is_raw_file("file_path"))
    return unrouted_lines(rows.withColumn("entity", file_entity("file_path")))


@query
def replaced_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods written, then one of them again without any record; what is left."""
    path = scratch(spark, "clean")
    period = F.when(F.col("entity") == "persone", "2015").otherwise("2014_05")
    raw = view(spark, sf_dir, "grezzi").select("entity", period.alias("period"), "value")
    write_clean_lines(repair_lines(raw), path, raw=raw)
    wrappers = raw.filter((F.col("entity") == "incidenti") & F.contains("value", F.lit('"Incidenti":[')))
    write_clean_lines(repair_lines(wrappers), path, raw=wrappers)
    return count_by(read_clean_lines(spark, path), {"entity": "entity", "period": "period"})


def _raw_files(lines: DataFrame, entity: str, path: str) -> None:
    """An entity's lines as raw files, whose names begin with the entity as in the originals."""
    own = lines.filter(F.col("entity") == entity).select("value")
    own.write.option("mapreduce.output.basename", entity.capitalize()).text(path)


@query
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of two entities, routed by name, repaired, stored by entity and
    period, read back and parsed."""
    raw, clean = scratch(spark, "raw"), scratch(spark, "clean")
    lines = view(spark, sf_dir, "grezzi")
    for entity, folder in {"incidenti": "dati_2014_05", "persone": "dati_2015"}.items():
        _raw_files(lines, entity, f"{raw}/{folder}")
    # The writer's own markers are no raw files.
    found = read_raw(spark, raw)
    write_clean_lines(repair_lines(found), clean, raw=found)
    return _both_entities(read_clean_lines(spark, clean), "period")


@query
def documents_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON, read back and counted out again."""
    path = scratch(spark, "documents")
    save_documents(jobs.times_documents(view(spark, sf_dir, "incidenti")), path)
    info = "array<struct<Giorno:string,Info:array<struct<FasciaOraria:string,Count:bigint>>>>"
    rows = spark.read.schema(f"Gruppo string, Info {info}").json(path)
    days = rows.select("Gruppo", F.explode("Info").alias("d"))
    bands = days.select("Gruppo", "d.Giorno", F.explode("d.Info").alias("b"))
    return bands.select("Gruppo", "Giorno", "b.FasciaOraria", F.col("b.Count").alias("n"))


@query
def load_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity written as a table with typed and foreign columns, loaded by schema."""
    path = scratch(spark, "incidenti")
    accidents = view(spark, sf_dir, "incidenti")
    typed = accidents.withColumn("ID", F.col("ID").cast("bigint")).drop("Visibilita")
    typed.withColumn("Meteo", F.lit("sereno")).write.mode("overwrite").parquet(path)
    return load(spark, "incidenti", path)


# --- itemsets with a support, from counted rows ----------------------------------


@query
def itemsets_wide_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemsets of ten fields of an accident that a tenth of a municipality's accidents share."""
    found = count_itemsets(jobs.wide_itemsets(view(spark, sf_dir, "incidenti")), min_support=0.1, by=["Gruppo"])
    return found.select("Gruppo", _joined("items").alias("items"), "n")


@query
def scenario_rules_by_group_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rules that a hundredth of a municipality's accidents follow."""
    rules = jobs.scenario_rules_by_group(view(spark, sf_dir, "incidenti"), min_support=0.01)
    return _flat_rules(rules, "Gruppo", "confidence", F.round("score", 9).alias("score"))


@query
def itemset_counts_levelwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The itemsets of ``itemset_counts_support``, level by level."""
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))
    found = count_itemsets(sets, min_items=2, min_support=0.02, engine="levelwise")
    return found.select(_joined("items").alias("items"), "n")


# --- subtotals ---------------------------------------------------------------------


@query
def times_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday and time band per municipality, with the totals of days, municipalities and all."""
    return jobs.times_with_totals(view(spark, sf_dir, "incidenti"))


@query
def drivers_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drivers_with_totals(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))


@query
def makes_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles by make, type and surface, with the totals over any of them."""
    return jobs.makes_with_totals(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "veicoli"))


@query
def nested_times_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(jobs.times_documents(view(spark, sf_dir, "incidenti"), total="Totale"))


@query
def nested_drivers_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    accidents, persons = view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone")
    return as_json(jobs.drivers_documents(accidents, persons, total="Totale"))


# --- how the entities fit together ---------------------------------------------------


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = {n: view(spark, sf_dir, n) for n in ("persone", "pedoni", "veicoli")}
    return key_presence(view(spark, sf_dir, "incidenti"), children)


@query
def entity_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each protocol number and its rows in the four entities."""
    return _presence(spark, sf_dir)


@query
def entity_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity(_presence(spark, sf_dir))


@query
def orphan_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol numbers of persons without an accident."""
    return orphan_keys(_presence(spark, sf_dir), "persone")


@query
def childless_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol numbers of accidents without a person, pedestrian or vehicle."""
    children = {n: view(spark, sf_dir, n) for n in ("pedoni",)}
    return childless_keys(key_presence(view(spark, sf_dir, "incidenti"), children))


# --- counts by period ------------------------------------------------------------------


@query
def replaced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types per municipality, kept by year, after one year came again, one was lost and one is new."""
    keys, path = ["Gruppo", "TipoIncidente"], scratch(spark, "counts")
    accidents = view(spark, sf_dir, "incidenti")
    counted = written(jobs.types_by_period(accidents), "types")
    first = counted.filter("period <> '1998'")
    save_period_counts(first, path)
    totals = written(count_by(first, {k: k for k in keys}, "n", weight="n"), "totals")
    again = counted.filter("period = '1994'").withColumn("n", F.col("n") * 2)
    again = again.unionByName(counted.filter("period = '1998'"))
    totals = replace_periods(again, totals, path, keys, gone=["1996"])
    # The state by period and the totals must agree.
    schema = "Gruppo string, TipoIncidente string, n long, period string"
    state = count_by(period_counts(spark, path, schema), {k: k for k in keys}, "n", weight="n")
    return totals.withColumnRenamed("n", "totale").join(state, keys, "full_outer").select(*keys, "totale", "n")


# --- raw files that keep arriving --------------------------------------------------------


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``ingest_files`` as a stream: one entity, a few files a batch, then
    a new start that takes in the other; parsed from what is stored."""
    raw, store, checkpoint = (scratch(spark, n) for n in ("raw", "store", "checkpoint"))
    lines = view(spark, sf_dir, "grezzi")
    _raw_files(lines, "incidenti", f"{raw}/dati_2014_05")
    take_in(spark, raw, store, checkpoint, files_a_batch=4)
    _raw_files(lines, "persone", f"{raw}/dati_2015")
    take_in(spark, raw, store, checkpoint)
    return _both_entities(stored_lines(spark, store), "period")


@query
def ingest_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period of accidents that is delivered a second time, in part, beside other periods:
    what of it counts, by entity and period."""
    raw, store, checkpoint = (scratch(spark, n) for n in ("raw", "store", "checkpoint"))
    lines = view(spark, sf_dir, "grezzi")
    _raw_files(lines, "incidenti", f"{raw}/consegna_1/dati_2014_05")
    _raw_files(lines, "persone", f"{raw}/consegna_1/dati_2015")
    take_in(spark, raw, store, checkpoint)
    _raw_files(lines.filter("k % 2 = 0"), "incidenti", f"{raw}/consegna_2/dati_2014_05")
    _raw_files(lines.filter("k % 3 = 0"), "incidenti", f"{raw}/consegna_2/dati_2014_06")
    take_in(spark, raw, store, checkpoint)
    return ingest_report(spark, store, delivery=r"/consegna_(\d+)/").drop("files")


# --- different accidents per category ----------------------------------------------------


@query
def drivers_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers and different accidents per municipality, age band and sex."""
    return jobs.drivers_accidents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))


@query
def drivers_accidents_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drivers_accidents(
        view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"), totals=True
    )


@query
def makes_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.makes_accidents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "veicoli"))


@query
def accidents_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different accidents per municipality from sketches kept by year, one of which is lost.

    Exact while a municipality has at most 16,384 of them.
    """
    path = scratch(spark, "sketches")
    kept = jobs.accident_sketches_by_period(view(spark, sf_dir, "incidenti"))
    save_period_counts(kept, path)
    save_period_counts(kept.limit(0), path, gone=["1996"])
    schema = "Gruppo string, TipoIncidente string, sketch binary, period string"
    return sketch_counts(merge_sketches(period_counts(spark, path, schema, "sketch"), ["Gruppo"]), out="NumIncidenti")


@query
def pedestrians_and_young(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per municipality: accidents with pedestrians only, with drivers below 26 only, with both, with either."""
    accidents = view(spark, sf_dir, "incidenti").filter(F.col("Gruppo") != "")
    persons = view(spark, sf_dir, "persone").filter(F.col("TipoPersona") == S.DRIVER)
    young = persons.filter(age_band(birth_year("AnnoNascita")) == "18-25")
    cols = {"Gruppo": "Gruppo", "ID": "ID"}
    sides = (join_for_count(accidents, c, cols) for c in (view(spark, sf_dir, "pedoni"), young))
    left, right = (distinct_sketches(s, {"Gruppo": "Gruppo"}, "ID") for s in sides)
    return compare_sketches(left, right, ["Gruppo"])


# --- closed and maximal itemsets, essential rules ----------------------------------------


@query
def itemsets_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All itemsets of the scenarios, listed without a support, with their marks."""
    found = count_itemsets(jobs.scenario_itemsets(view(spark, sf_dir, "incidenti")))
    return mark_itemsets(found).select(_joined("items").alias("items"), "n", "chiuso", "massimale")


@query
def itemsets_closed_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The itemsets of ``itemsets_wide_by_group`` with their marks."""
    found = count_itemsets(jobs.wide_itemsets(view(spark, sf_dir, "incidenti")), min_support=0.1, by=["Gruppo"])
    marked = mark_itemsets(written(found, "found"), ["Gruppo"])
    return marked.select("Gruppo", _joined("items").alias("items"), "n", "chiuso", "massimale")


@query
def scenario_rules_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of every municipality's scenarios that no shorter antecedent gives."""
    rules = jobs.scenario_rules_by_group(view(spark, sf_dir, "incidenti"), essential=True, min_antecedent=1)
    return _flat_rules(rules, "Gruppo", "confidence", F.round("score", 9).alias("score"))


# --- rules that are no chance --------------------------------------------------------------


def _tested(rules: DataFrame, *rest: str) -> DataFrame:
    numbers = [F.round(c, 6).alias(c) for c in ("atteso", "chi2")] + [F.round(c, 9).alias(c) for c in ("p", "p_corretto")]
    return _flat_rules(rules, *rest, "n", "n_antecedent", "n_consequent", "records", *numbers)


@query
def rules_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenario rules with chi-squared and corrected probability."""
    sets = jobs.scenario_itemsets(view(spark, sf_dir, "incidenti"))
    return _tested(significant_rules(count_itemsets(sets), sets))


@query
def rules_tested_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within every municipality, over the rules of five records and more in a hundred;
    corrected for all of them."""
    sets = written(jobs.wide_itemsets(view(spark, sf_dir, "incidenti")), "sets")
    found = count_itemsets(sets, min_support=0.05, by=["Gruppo"])
    return _tested(significant_rules(found, sets, ["Gruppo"]), "Gruppo")


# --- months ----------------------------------------------------------------------------------


def _trend(series: DataFrame) -> DataFrame:
    return series.withColumns({c: F.round(c, 9) for c in ("media", "variazione")})


@query
def types_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accidents per municipality, type and month of the whole period, with their trend."""
    return _trend(jobs.types_by_month(view(spark, sf_dir, "incidenti")))


@query
def types_monthly_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from December 1993 to May 1996."""
    return _trend(jobs.types_by_month(view(spark, sf_dir, "incidenti"), date(1993, 12, 1), date(1996, 5, 31)))


# --- the most frequent values of a group ---------------------------------------------------


@query
def busiest_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten accidents with the most persons of every municipality."""
    found = jobs.busiest_accidents(view(spark, sf_dir, "incidenti"), view(spark, sf_dir, "persone"))
    return found.withColumnRenamed("valore", "ID")


@query
def worst_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days with the most accidents of every municipality."""
    return jobs.worst_days(jobs.accident_days(view(spark, sf_dir, "incidenti")))


@query
def worst_days_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from bucket counts kept by year, one of which was delivered twice and one lost."""
    path, keys = scratch(spark, "days"), ["Gruppo", "riga", "cesto"]
    days = jobs.accident_days(view(spark, sf_dir, "incidenti"))
    kept = written(jobs.day_buckets_by_period(days), "kept")
    save_period_counts(kept, path)
    totals = merge_buckets(kept, ["Gruppo"])
    totals = replace_periods(kept.filter("period = '1994'"), totals, path, keys, gone=["1996"])
    return jobs.worst_days(days.filter("period <> '1996'"), summary=totals)


@query
def worst_days_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred days with the most accidents of all municipalities."""
    days = jobs.accident_days(view(spark, sf_dir, "incidenti"))
    return top_values(days, {}, "giorno", 100).withColumnRenamed("valore", "giorno")
