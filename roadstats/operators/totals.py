"""Subtotals over counted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(
    counts: DataFrame,
    keys: Sequence[str],
    n: str = "n",
    every: bool = False,
    level: str = "livello",
) -> DataFrame:
    """Counted rows with the totals above them: ``keys, n, livello``.

    Totals are taken over the keys from the last to the first, up to the sum of
    all; with ``every``, over each subset of them. A key that was summed over is
    NULL there, and ``livello`` tells such rows from those whose own value is
    NULL: bit i from the right is set if the i-th last key was summed over. Only
    counted rows are expanded, so the records are read once.
    """
    grouped = counts.cube(*keys) if every else counts.rollup(*keys)
    totals = grouped.agg(F.sum(n).alias(n), F.grouping_id().alias(level))
    # An empty table has no total either.
    return totals.filter(F.col(n).isNotNull()).select(*keys, n, level)
