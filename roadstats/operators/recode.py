"""Bring records from an old division of groups to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recode_groups(
    accidents: DataFrame, crosswalk: DataFrame, ts: str, group: str = "Gruppo"
) -> DataFrame:
    """Replace ``group`` by the crosswalk's new value where ``ts < valid_before``.

    Several rows of one old value are several reforms: the one with the smallest
    ``valid_before`` after ``ts`` counts (then the smallest new value), so no
    record is multiplied. They are gathered to one short list per old value. No
    hint is given: Spark broadcasts the crosswalk while it is below the
    broadcast threshold and otherwise falls back to a shuffle join, whose large
    groups adaptive execution splits.
    """
    steps = F.sort_array(F.collect_list(F.struct(F.col("valid_before").alias("end"), F.col("new").alias("new"))))
    cw = (
        crosswalk.filter(F.col("valid_before").isNotNull())
        .groupBy(F.col("old").alias("_old"))
        .agg(steps.alias("_steps"))
    )
    first = F.get(F.filter("_steps", lambda s: F.col(ts) < s["end"]), F.lit(0))["new"]
    recoded = F.coalesce(first, F.col(group))
    return (
        accidents.join(cw, F.col(group) == F.col("_old"), "left")
        .withColumn(group, recoded)
        .drop("_old", "_steps")
    )
