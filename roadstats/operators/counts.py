"""Counting: by key, by several dimensions in one pass, ranked in a group, top groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.functions import is_filled


def _total(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def count_by(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    out: str = "n",
    require: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """One row per key combination with its number of input rows.

    ``keys`` maps output names to columns. Rows whose ``require`` keys are null
    or empty are dropped before counting. With ``weight`` the rows stand for
    that many rows each. Partial aggregation runs before the one shuffle, so a
    key that holds a third of the input costs each task one row.
    """
    cols = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keys.items()]
    rows = df.select(*cols, *([weight] if weight else []))
    for name in require:
        rows = rows.filter(is_filled(name))
    return rows.groupBy(*keys).agg(_total(weight).alias(out))


def count_dimensions(
    df: DataFrame,
    group: str,
    dims: Mapping[str, Callable[[str], Column]],
    group_fn: Callable[[str], Column] = F.col,
    out: str = "Gruppo",
    require_all: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Count the values of several dimensions per group from a single scan.

    ``dims`` maps columns to the function that cleans them, ``group_fn`` cleans
    the group. Output: ``out, dim, valore, n`` without empty groups and values.
    The rows are first counted by the raw combination of all columns: only the
    combinations, not the source rows, are then cleaned and unpivoted. With
    ``require_all`` a group stays only if every dimension has a value in it.
    """
    combos = count_by(df, {c: c for c in [group, *dims]}, "n", weight=weight)
    entry = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dim"), fn(d).alias("valore")) for d, fn in dims.items()])
    )
    flat = count_by(
        combos.select(group_fn(group).alias(out), entry.alias("e"), "n"),
        {out: out, "dim": "e.dim", "valore": "e.valore"},
        "n",
        require=[out, "valore"],
        weight="n",
    )
    if not require_all:
        return flat
    seen = F.size(F.collect_set("dim").over(Window.partitionBy(out)))
    return flat.withColumn("_seen", seen).filter(F.col("_seen") == len(dims)).drop("_seen")


def rank_in_group(
    df: DataFrame, parents: Sequence[str], n: str, labels: Sequence[str], out: str = "pos"
) -> DataFrame:
    """Position of each counted row in its group: count descending, ties by label."""
    w = Window.partitionBy(*parents).orderBy(F.desc(n), *labels)
    return df.withColumn(out, F.row_number().over(w))


def top_groups(counts: DataFrame, group: str, n: str, k: int) -> DataFrame:
    """The ``k`` groups with the highest count, ties by group."""
    return counts.orderBy(F.desc(n), group).limit(k)
