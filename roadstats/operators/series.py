"""Counts by month without gaps, and what can be read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by
from roadstats.scratch import written

#: A thousand years. A stray date must not make every group longer than that.
MOST_MONTHS = 12_000


def month_number(day: Column) -> Column:
    """Months since the year 0, so that neighbours differ by one."""
    return F.year(day) * 12 + F.month(day) - 1


def months_by(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    when: Column | str,
    first: date | None = None,
    last: date | None = None,
    n: str = "n",
    month: str = "mese",
    require: Sequence[str] = (),
    weight: str | None = None,
    most_months: int = MOST_MONTHS,
) -> DataFrame:
    """``keys, mese, n``: rows per key combination and month, with 0 for the months without any.

    Every combination with a row in the period has all its months, from that of
    ``first`` to that of ``last``; without these, from the first to the last month of
    the whole table. Rows without a date or outside the period are left out. A period
    of more than ``most_months`` raises. The rows are counted by month first; the
    zeros and the counts then meet in one aggregation of a row for each month of each
    combination, whatever the number of records.
    """
    day = F.trunc(F.col(when) if isinstance(when, str) else when, "MM").alias(month)
    counts = count_by(df, {**keys, month: day}, n, require=require, weight=weight)
    # Filters on the month come after this, as they would parse every date again.
    counts = written(counts, "months").filter(F.col(month).isNotNull())
    if first is not None:
        counts = counts.filter(F.col(month) >= F.trunc(F.lit(first), "MM"))
    if last is not None:
        counts = counts.filter(F.col(month) <= F.lit(last))
    # One row: the ends of the period.
    ends = counts.agg(F.min(month).alias("_from"), F.max(month).alias("_to"))
    start = F.lit(first) if first is not None else ends.select("_from").scalar()
    end = F.lit(last) if last is not None else ends.select("_to").scalar()
    start, end = F.trunc(start, "MM"), F.trunc(end, "MM")
    fits = month_number(end) - month_number(start) < most_months
    wrong = F.raise_error(F.lit(f"the period has more than {most_months} months")).cast("date")
    months = F.sequence(start, F.when(fits, end).otherwise(wrong), F.expr("INTERVAL 1 MONTH"))
    none = counts.select(*keys).distinct().select(*keys, F.explode(months).alias(month), F.lit(0).cast("long").alias(n))
    return count_by(counts.unionByName(none), {k: k for k in [*keys, month]}, n, weight=n)


def with_trend(
    series: DataFrame, keys: Sequence[str], n: str = "n", month: str = "mese", window: int = 12
) -> DataFrame:
    """Adds ``media, anno_prima, variazione`` to a series of :func:`months_by`.

    ``media`` is the mean of the month and the ``window - 1`` before it, as far as the
    series goes back; ``anno_prima`` the count of the same month a year before and
    ``variazione`` the change against it as a share, NULL where there is none or it is
    0. The frames are ranges of months, so a gap would not shift them. A window holds
    one combination's months.
    """
    at = Window.partitionBy(*keys).orderBy("_month")
    out = series.withColumn("_month", month_number(F.col(month)))
    out = out.withColumn("media", F.sum(n).over(at.rangeBetween(1 - window, 0)) / F.count(n).over(at.rangeBetween(1 - window, 0)))
    out = out.withColumn("anno_prima", F.sum(n).over(at.rangeBetween(-12, -12)))
    change = F.when(F.col("anno_prima") != 0, (F.col(n) - F.col("anno_prima")) / F.col("anno_prima"))
    return out.withColumn("variazione", change).drop("_month")
