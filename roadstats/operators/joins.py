"""Accident-to-child joins that feed a count."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.functions import entity_key
from roadstats.operators.counts import count_by


def join_for_count(
    accidents: DataFrame,
    children: DataFrame,
    accident_cols: Mapping[str, Column | str],
    child_cols: Mapping[str, Column | str] | None = None,
    weight: str = "n",
    accident_key: str = "ID",
    child_key: str = "IDProtocollo",
) -> DataFrame:
    """Inner join on the protocol number; each output row stands for ``weight`` pairs.

    Equal to the plain join, where duplicates multiply, once the weights are
    summed. The child side is counted by (protocol number, child columns) before
    it is joined: a protocol number shared by very many children is reduced on
    the map side and meets each accident as a few weighted rows, so neither its
    rows nor its pairs pile up in one task. A protocol number repeated on the
    accident side stays linear for the same reason, and adaptive execution
    splits its partition. Only the columns named here reach the shuffles.
    """
    child_cols = dict(child_cols or {})
    counted = count_by(children, {"_key": entity_key(child_key), **child_cols}, weight)
    left = accidents.select(
        entity_key(accident_key).alias("_key"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in accident_cols.items()],
    )
    return left.join(counted, "_key").drop("_key")
