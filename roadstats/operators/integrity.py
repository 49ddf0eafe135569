"""How the entities fit together: keys without a partner, repeated keys, missing keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.functions import entity_key

#: Name of the accidents' own column.
ACCIDENTS = "incidenti"


def key_presence(
    accidents: DataFrame,
    children: Mapping[str, DataFrame],
    accident_key: str = "ID",
    child_key: str = "IDProtocollo",
) -> DataFrame:
    """``chiave`` and, for the accidents and every child entity, its number of rows with that key.

    All tables meet in one aggregation: each row is a key and a one in its
    entity's column, summed on the map side before the only shuffle, so that a
    key of very many rows costs each task one row. A row for the missing key
    (NULL) stays. The result holds what any outer or anti join of the tables on
    the key would say.
    """
    tables = {ACCIDENTS: (accidents, accident_key)} | {n: (df, child_key) for n, df in children.items()}
    rows = [
        df.select(entity_key(key).alias("chiave"), *[F.lit(int(n == name)).cast("long").alias(n) for n in tables])
        for name, (df, key) in tables.items()
    ]
    every = reduce(DataFrame.unionAll, rows)
    return every.groupBy("chiave").agg(*[F.sum(n).alias(n) for n in tables])


def orphan_keys(presence: DataFrame, entity: str) -> DataFrame:
    """``chiave, n``: keys of a child entity that no accident has, with their rows. A NULL key is one."""
    lone = F.col("chiave").isNull() | (F.col(ACCIDENTS) == 0)
    return presence.filter((F.col(entity) > 0) & lone).select("chiave", F.col(entity).alias("n"))


def childless_keys(presence: DataFrame) -> DataFrame:
    """``chiave, n``: keys of accidents that no child entity has, with the accidents' rows."""
    entities = [c for c in presence.columns if c not in ("chiave", ACCIDENTS)]
    none = F.col("chiave").isNull() | (sum((F.col(e) for e in entities), F.lit(0)) == 0)
    return presence.filter((F.col(ACCIDENTS) > 0) & none).select("chiave", F.col(ACCIDENTS).alias("n"))


def integrity(presence: DataFrame) -> DataFrame:
    """One row for each entity: what its keys look like and whether they meet.

    ``righe`` counts its rows, ``chiavi`` its different keys, ``senza_chiave`` rows
    with a NULL key, ``ripetute`` keys that several of its rows have, and
    ``spaiate`` keys without a partner (for accidents: in no child entity; for
    children: among no accidents), ``righe_spaiate`` their rows. Rows with a NULL
    key have no partner.
    """
    entities = [c for c in presence.columns if c != "chiave"]
    known = F.col("chiave").isNotNull()

    def lone(entity: str) -> Column:
        if entity == ACCIDENTS:
            return sum((F.col(e) for e in entities if e != entity), F.lit(0)) == 0
        return F.col(ACCIDENTS) == 0

    def row(entity: str) -> Column:
        n = F.col(entity)
        has = known & (n > 0)
        return F.struct(
            F.lit(entity).alias("entita"),
            F.coalesce(F.sum(n), F.lit(0)).alias("righe"),
            F.count_if(has).alias("chiavi"),
            F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("senza_chiave"),
            F.count_if(known & (n > 1)).alias("ripetute"),
            F.count_if(has & lone(entity)).alias("spaiate"),
            F.coalesce(F.sum(F.when(~known | lone(entity), n)), F.lit(0)).alias("righe_spaiate"),
        )

    counted = presence.agg(F.array(*[row(e) for e in entities]).alias("r"))
    return counted.select(F.inline("r"))
