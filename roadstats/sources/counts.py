"""Counts kept by period, so that a period that is delivered again costs only itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by
from roadstats.scratch import written


def save_period_counts(counts: DataFrame, path: str, period: str = "period", gone: Sequence[str] = ()) -> None:
    """Replace the counts of the periods in ``counts``; the other periods' files stay as they are.

    ``gone`` names periods of which nothing is left: they get an empty set of
    counts. A period is one folder and is replaced as a whole, so writing it
    twice, or again after a failure, leaves the same state.
    """
    spark = counts.sparkSession
    values = [c for c in counts.columns if c != period]
    rows = counts.select(*values, period)
    if gone:
        # A folder is only replaced by rows: a marker that :func:`period_counts` leaves out.
        marks = spark.createDataFrame([(p,) for p in gone], f"{period} string")
        lost = marks.join(counts.select(period).distinct(), period, "left_anti")
        rows = rows.unionByName(lost, allowMissingColumns=True).select(*values, period)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period)
        .parquet(path)
    )


def period_counts(spark: SparkSession, path: str, schema: str, n: str = "n") -> DataFrame:
    """The counts of all periods, as :func:`save_period_counts` left them; ``schema`` includes the period."""
    return spark.read.schema(schema).parquet(path).filter(F.col(n).isNotNull())


def count_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """``keys, n``: by how much each count differs, what is gone with a minus; equal ones are left out.

    Both sides meet in one aggregation as plus and minus.
    """
    minus = before.select(*keys, (-F.col(n)).alias(n))
    both = after.select(*keys, n).unionByName(minus)
    return count_by(both, {k: k for k in keys}, n, weight=n).filter(F.col(n) != 0)


def apply_changes(totals: DataFrame, changes: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Totals after ``changes``; counts that fall to zero leave. A count below zero raises."""
    both = totals.select(*keys, n).unionByName(changes.select(*keys, n))
    summed = count_by(both, {k: k for k in keys}, n, weight=n).filter(F.col(n) != 0)
    wrong = F.raise_error(F.lit("a change takes away more than was counted")).cast("long")
    return summed.withColumn(n, F.when(F.col(n) > 0, F.col(n)).otherwise(wrong))


def replace_periods(
    new: DataFrame,
    totals: DataFrame,
    path: str,
    keys: Sequence[str],
    period: str = "period",
    gone: Sequence[str] = (),
    n: str = "n",
) -> DataFrame:
    """Take in periods that were delivered (again) and return the totals of all periods.

    ``new`` has the counts of whole periods (``keys, period, n``). What was counted for
    them before is read from their folders alone and taken back from ``totals``
    (``keys, n``), so neither the other periods nor any record is read. ``totals`` must
    be those of the state at ``path``.
    """
    spark = new.sparkSession
    new = written(new.select(*keys, period, n), "new")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    # The names of the delivered periods; each is a folder, of which Spark reads no other.
    names = sorted({r[0] for r in new.select(period).distinct().collect()} | set(gone))
    before = period_counts(spark, path, schema, n).filter(F.col(period).isin(names))
    changes = written(count_changes(before, new, keys, n), "changes")
    save_period_counts(new, path, period, gone)
    return apply_changes(totals, changes, keys, n)
