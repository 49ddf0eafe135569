"""Entity tables, baseline files and result sinks on Spark data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats import schema as S
from roadstats.functions import java_trim
from roadstats.operators.rules import rule_lines

# Formats whose files carry no types; they are read with the entity's schema.
_UNTYPED = {"json", "csv", "text"}


def load(
    spark: SparkSession,
    entity: str,
    path: str,
    fmt: str = "parquet",
    keep_extra: bool = False,
    clean_strings: bool = False,
    extra: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """An entity collection with the columns of its schema, all as text.

    ``fmt`` is any Spark data source (parquet, orc, json, or a connector on the
    classpath). Typed columns are cast, missing ones are NULL, and others are
    dropped unless ``keep_extra``; only columns a job uses are read in the end.
    Files without types are read by the schema and the ``extra`` fields, with no
    pass to infer them.
    """
    schema = S.ENTITIES[entity]
    reader = spark.read.format(fmt).options(**options)
    if fmt in _UNTYPED:
        if keep_extra and extra is None:
            raise ValueError(f"name the extra fields of {fmt} files")
        reader = reader.schema(T.StructType([*schema, *(extra or [])]))
    df = reader.load(path)
    present = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    if clean_strings:
        cols = [java_trim(c).alias(f.name) for c, f in zip(cols, schema)]
    extra = [c for c in df.columns if c not in schema.names] if keep_extra else []
    return df.select(*cols, *extra)


def _baseline_lines(spark: SparkSession, path: str) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in S.BASELINE])
    return spark.read.schema(text).csv(path).withColumn("number", F.col("freq").try_cast("double"))


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``item, freq`` from comma files without header.

    A line without an item or a readable frequency raises; :func:`bad_baseline`
    lists such lines.
    """
    lines = _baseline_lines(spark, path)
    told = F.concat(
        F.lit("unreadable baseline line: "), F.concat_ws(",", F.col("item"), F.col("freq"))
    )
    good = F.col("item").isNotNull() & F.col("number").isNotNull()
    return lines.select(
        F.when(good, F.col("item")).otherwise(F.raise_error(told)).alias("item"),
        F.when(good, F.col("number")).otherwise(F.raise_error(told).cast("double")).alias("freq"),
    )


def bad_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a baseline file that :func:`load_baseline` refuses, as text."""
    return (
        _baseline_lines(spark, path)
        .filter(F.col("item").isNull() | F.col("number").isNull())
        .select("item", "freq")
    )


def save_documents(
    df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", **options: str
) -> None:
    """Write the (nested) rows of a job; one document per row."""
    df.write.format(fmt).mode(mode).options(**options).save(path)


def save_rules(scored: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write rules as text lines and return how many were written, in one pass."""
    seen = Observation()
    lines = rule_lines(scored).observe(seen, F.count(F.lit(1)).alias("kept"))
    lines.write.mode(mode).text(path)
    return seen.get["kept"]


def as_json(df: DataFrame, out: str = "doc") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))
