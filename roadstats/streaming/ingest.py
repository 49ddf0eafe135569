"""Raw files that keep arriving: each is read once, repaired and stored by entity and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadstats import schema as S
from roadstats.functions.repair import is_record_line, repair_line
from roadstats.operators.counts import count_by
from roadstats.sources.raw import CORRUPT, parse_records, refuse_hidden, routed_lines

_STORED = "value string, file_path string, entity string, period string"


def stream_raw(
    spark: SparkSession,
    path: str,
    charset: str = "UTF-8",
    hidden: str = "refuse",
    files_a_batch: int | None = None,
) -> DataFrame:
    """The stream of lines of all json/txt files below ``path``, with the columns of ``read_raw``.

    ``files_a_batch`` bounds a micro-batch; without it one takes all new files.
    """
    refuse_hidden(spark, path, hidden)
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return routed_lines(reader.text(path), charset)


def ingest_stream(
    lines: DataFrame, store: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start to store the repaired lines of a stream, a folder per entity and period.

    Without ``every`` the query takes what there is and ends; with it, it goes on
    in that interval. The file sink's log names the files of every finished batch:
    a batch that is run again after a failure adds nothing twice, and what a lost
    task left behind is read by nobody. A batch is one narrow stage. Lines that
    hold no record are kept as NULL, which tells that their file was read.
    """
    kept = F.explode_outer(F.filter(F.array(repair_line("value")), is_record_line))
    rows = lines.select(kept.alias("value"), "file_path", "entity", "period")
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("entity", "period")
        .option("checkpointLocation", checkpoint)
        .option("path", store)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def take_in(
    spark: SparkSession,
    path: str,
    store: str,
    checkpoint: str,
    charset: str = "UTF-8",
    hidden: str = "refuse",
    files_a_batch: int | None = None,
) -> None:
    """Store all files below ``path`` that no earlier call with this ``checkpoint`` has stored.

    Returns when they are stored and raises if a batch fails. The next call goes on
    where a failed one stopped. A file is known by its path: one that is changed in
    place is not read again; a correction is a new file (see :func:`stored_lines`).
    """
    lines = stream_raw(spark, path, charset, hidden, files_a_batch)
    ingest_stream(lines, store, checkpoint).awaitTermination()


def _delivered(spark: SparkSession, store: str, delivery: str | None) -> DataFrame:
    """Stored lines; with ``delivery``, those of each entity's and period's last one."""
    rows = spark.read.schema(_STORED).parquet(store)
    if delivery is None:
        return rows
    name: Column = F.regexp_extract("file_path", delivery, 1)
    # Lines are reduced to files first, as the largest text is found by sorting. One row for each entity
    # and period is left, also where one of them has most of the lines; it is sent to the lines.
    # Spark takes a plain distinct() below a maximum out again, hence the test of the count.
    files = count_by(rows, {c: c for c in ("entity", "period", "file_path")}, "_lines").filter("_lines > 0")
    last = F.broadcast(
        files.groupBy(F.col("entity").alias("_entity"), F.col("period").alias("_period")).agg(F.max(name).alias("_last"))
    )
    rows = rows.withColumn("_delivery", name)
    same = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("period").eqNullSafe(F.col("_period"))
    old = F.col("period").isNotNull() & (F.col("_delivery") < F.col("_last"))
    return rows.join(last, same).filter(~old).select("value", "file_path", "entity", "period")


def stored_lines(
    spark: SparkSession, store: str, entity: str | None = None, delivery: str | None = None
) -> DataFrame:
    """``value, file_path, entity, period``: the record lines that were taken in.

    ``delivery`` is a pattern whose first group names the delivery in a file's path.
    Of an entity's period that was delivered several times only the delivery whose
    name sorts last counts, also if no record is left in it; files without such a
    name come before all others. Files without a period never replace each other.
    Lines of files that name no entity have a NULL there. ``entity`` reads one folder.
    """
    rows = _delivered(spark, store, delivery).filter(F.col("value").isNotNull())
    return rows if entity is None else rows.filter(F.col("entity") == entity)


def ingest_report(spark: SparkSession, store: str, delivery: str | None = None) -> DataFrame:
    """``entity, period, files, good, corrupt``: what was taken in, by entity and period.

    Records and corrupt lines are told apart by the identifiers' fields. A period of
    which only lines without a record came has zeros; a file without any line leaves
    no trace.
    """
    rows = _delivered(spark, store, delivery)
    # Files are counted from counted rows, so that no task meets a period's lines.
    parsed = parse_records(
        rows.withColumn("_line", F.col("value").isNotNull()), S.text_schema("ID", "IDProtocollo")
    )
    bad = F.col(CORRUPT).isNotNull()
    by_file = parsed.groupBy("entity", "period", "file_path").agg(
        F.count_if(F.col("_line") & ~bad).alias("good"), F.count_if(bad).alias("corrupt")
    )
    return by_file.groupBy("entity", "period").agg(
        F.count(F.lit(1)).alias("files"), F.sum("good").alias("good"), F.sum("corrupt").alias("corrupt")
    )
