"""Build nested documents from flat counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(
    flat: DataFrame,
    parents: Sequence[str],
    fields: Mapping[str, str],
    arrays: Sequence[str],
    count: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Nest flat rows below ``parents``, outermost parent first, to any depth.

    ``fields`` maps the names in the innermost structs to columns and
    ``arrays[i]`` names the array below ``parents[i]``. The innermost list is
    sorted by ``count`` descending and then by its fields, or by its fields
    alone; every other list is sorted by its label. ``total`` names a field that
    holds the sum of ``count`` below each parent. Meant for rows that are
    already counted: a document then has one entry per category, not per record.
    """
    if total and not count:
        raise ValueError("a total needs the count that it sums")
    if len(parents) != len(arrays):
        raise ValueError("one array name per parent is needed")
    # Everything below one outermost parent ends in one document, so one
    # exchange on that parent serves all levels.
    df = flat.repartition(parents[0]) if len(parents) > 1 else flat
    entry = F.struct(*[F.col(c).alias(name) for name, c in fields.items()])
    key = F.struct(*([(-F.col(count)).alias("_n")] if count else []), entry.alias("_entry"))
    for depth in range(len(parents), 0, -1):
        keys, array = list(parents[:depth]), arrays[depth - 1]
        sums = [F.sum(count if depth == len(parents) else total).alias(total)] if total else []
        df = df.groupBy(*keys).agg(*sums, F.sort_array(F.collect_list(key)).alias(array))
        df = df.withColumn(array, F.transform(array, lambda x: x["_entry"]))
        key = F.struct(F.struct(F.col(keys[-1]), *([total] if total else []), F.col(array)).alias("_entry"))
    return df


def nest_dimensions(
    flat: DataFrame, group: str, dims: Mapping[str, str], value: str = "valore", n: str = "n"
) -> DataFrame:
    """One array per dimension: ``dims`` maps each dimension to its label field."""
    entries = {
        d: F.sort_array(
            F.collect_list(
                F.when(
                    F.col("dim") == d, F.struct(F.col(value).alias(label), F.col(n).alias("Count"))
                )
            )
        )
        for d, label in dims.items()
    }
    return flat.groupBy(group).agg(*[e.alias(d) for d, e in entries.items()])


def nest_map(
    flat: DataFrame,
    group: str,
    dims: Sequence[str],
    out: str = "info",
    value: str = "valore",
    n: str = "n",
) -> DataFrame:
    """One struct of maps, a map per dimension with the values as keys."""
    maps = [
        F.sort_array(F.collect_list(F.when(F.col("dim") == d, F.struct(value, n)))).alias(d)
        for d in dims
    ]
    lists = flat.groupBy(group).agg(*maps)
    return lists.select(group, F.struct(*[F.map_from_entries(d).alias(d) for d in dims]).alias(out))
