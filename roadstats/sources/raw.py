"""From malformed raw files to typed records. Narrow steps only, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats import schema as S
from roadstats.functions import java_trim
from roadstats.functions.repair import (
    file_entity,
    file_period,
    is_raw_file,
    is_record_line,
    let,
    repair_line,
)

CORRUPT = "_corrupt_record"


# Between two records of one line: a brace each, and a key after the second.
_NEXT = r"\}\s*\{(?=\s*\"[^\"]*\"\s*:)"


def hidden_files(spark: SparkSession, path: str) -> list[str]:
    """Raw files below ``path`` that Spark's readers pass over, as their names begin with _ or a dot."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, open_ = [], [root]
    while open_:
        for status in store.listStatus(open_.pop()):
            name = status.getPath().getName()
            if status.isDirectory():
                open_.append(status.getPath())
            elif name[:1] in "_." and re.search(r"\.[^.]*(?:json|txt)[^.]*$", name) and not name.endswith(".crc"):
                found.append(status.getPath().toString())
    return sorted(found)


def refuse_hidden(spark: SparkSession, path: str, hidden: str) -> None:
    if hidden != "skip" and (passed := hidden_files(spark, path)):
        raise ValueError(f"Spark does not read files with these names: {passed[:10]}")


def routed_lines(lines: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """``value, file_path, entity, period`` of the lines of json/txt files, from the text source's rows."""
    # The reported path is a URI; give names with blanks back their blanks.
    uri = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    name = F.when(F.contains(uri, F.lit("%")), decoded).otherwise(uri)
    value = F.col("value")
    if charset.upper() != "UTF-8":
        # The text source keeps a line's bytes as they are.
        value = F.decode(value.cast("binary"), charset)
    return (
        lines.select(value.alias("value"), name.alias("file_path"))
        .filter(is_raw_file("file_path"))
        .withColumn("entity", file_entity("file_path"))
        .withColumn("period", file_period("file_path"))
    )


def read_raw(spark: SparkSession, path: str, charset: str = "UTF-8", hidden: str = "refuse") -> DataFrame:
    """Lines of all json/txt files below ``path``: ``value, file_path, entity, period``.

    Files that name no entity keep ``entity`` NULL; :func:`unrouted_lines` counts
    them. A filter on the file columns prunes files before they are opened.
    ``charset`` is the files' (any that Spark's ``decode`` knows and that writes
    line ends as single bytes). Spark does not read files whose names begin with
    _ or a dot; raw files with such names are refused unless ``hidden`` is "skip".
    """
    refuse_hidden(spark, path, hidden)
    return routed_lines(spark.read.option("recursiveFileLookup", "true").text(path), charset)


def unrouted_lines(lines: DataFrame) -> DataFrame:
    """``file_path, n``: lines of files that name no entity, which no output takes."""
    missed = lines.filter(F.col("entity").isNull())
    return missed.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def repair_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Repaired record lines; every other column passes through.

    The lines are filtered inside an array of one, which makes Spark repair each
    line once; a plain filter would be pushed below the repair and repeat it.
    """
    rest = [c for c in lines.columns if c != column]
    kept = F.explode(F.filter(F.array(repair_line(column)), is_record_line))
    return lines.select(*rest, kept.alias(column))


def parse_records(
    lines: DataFrame,
    schema: T.StructType,
    column: str = "value",
    extra: T.StructType | None = None,
    clean_strings: bool = False,
) -> DataFrame:
    """Parse record lines with ``schema`` (and ``extra`` fields); all are checked.

    A line may hold several records, with or without commas between them and
    brackets around them; each is a row. A line that is anything else, also in
    part, is one row with NULL fields and its text in ``_corrupt_record``.
    ``clean_strings`` trims every text field once, so that no job needs to.
    """
    fields = list(schema.fields) + (list(extra.fields) if extra else [])
    record = T.StructType(fields)
    line = F.col(column)
    bare = F.when(line.startswith("[") & line.endswith("]"), F.substring(line, F.lit(2), F.length(line) - 2))
    # Nearly no line has a second record, for which a second brace is needed.
    plain = F.coalesce(bare, line)
    body = F.when(F.locate("{", line, 2) > 0, F.regexp_replace(plain, _NEXT, "},{")).otherwise(plain)
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(record))

    def rows(found: Column) -> Column:
        none = F.lit(None).cast("string").alias(CORRUPT)
        good = F.transform(found, lambda r: F.struct(*[r[f.name].alias(f.name) for f in fields], none))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        bad = F.array(F.struct(*empty, line.alias(CORRUPT)))
        whole = (F.size(found) > 0) & ~F.exists(found, lambda r: r.isNull())
        return F.when(F.coalesce(whole, F.lit(False)), good).otherwise(bad)

    rest = [c for c in lines.columns if c != column]
    # Expanded from an array, so that filters on the fields do not parse again.
    parsed = lines.select(*rest, F.inline(let(parsed, rows)))
    if clean_strings:
        text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        parsed = parsed.withColumns({c: java_trim(c) for c in text})
    return parsed


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNotNull())


def validation_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """``entity, good, corrupt``: records and corrupt lines among the repaired lines, by entity.

    Lines of files that name no entity count under NULL if ``lines`` has them.
    """
    keys = T.StructType([T.StructField(c, T.StringType(), True) for c in ("ID", "IDProtocollo")])
    parsed = parse_records(lines.select("entity", column), keys, column)
    bad = F.col(CORRUPT).isNotNull()
    return parsed.groupBy("entity").agg(
        F.count_if(~bad).alias("good"), F.count_if(bad).alias("corrupt")
    )


def write_clean_lines(
    lines: DataFrame, path: str, column: str = "value", raw: DataFrame | None = None
) -> None:
    """Write repaired lines as one folder per entity and period, replacing only those.

    Rows are written where they were read: no shuffle, and a period that holds
    most of the data stays spread over its input splits. With the ``raw`` lines
    that ``lines`` come from, a period of which no record line is left is
    replaced as well: it gets one blank line, which :func:`read_clean_lines`
    leaves out.
    """
    routed = lines.select(F.col(column).alias("value"), "entity", "period")
    if raw is not None:
        seen = raw.select("entity", "period").distinct()
        routed = routed.unionByName(seen.withColumn("value", F.lit("")))
    (
        routed.filter(F.col("entity").isNotNull())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("entity", "period")
        .text(path)
    )


def read_clean_lines(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """Lines written by :func:`write_clean_lines`; ``entity`` reads that folder only."""
    lines = spark.read.schema("value string, entity string, period string").text(path)
    lines = lines if entity is None else lines.filter(F.col("entity") == entity)
    return lines.filter(F.col("value") != "")


def read_entity(
    spark: SparkSession,
    path: str,
    entity: str,
    extra: T.StructType | None = None,
    clean_strings: bool = False,
    charset: str = "UTF-8",
) -> DataFrame:
    """Raw files to parsed records of one entity, corrupt ones included."""
    lines = read_raw(spark, path, charset).filter(F.col("entity") == entity)
    return parse_records(
        repair_lines(lines), S.ENTITIES[entity], extra=extra, clean_strings=clean_strings
    )
