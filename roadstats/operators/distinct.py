"""How many different keys a category has: exactly, and by sketches that can be merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by

#: Power of two of the keys that a sketch holds. Up to so many its counts are exact.
SKETCH_LOG = 14


def _pairs(
    df: DataFrame, keys: Mapping[str, Column | str], of: Column | str, n: str, require: Sequence[str], weight: str | None
) -> DataFrame:
    return count_by(df, {**keys, "_of": of}, n, require=require, weight=weight)


def distinct_by(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    of: Column | str,
    out: str = "distinti",
    n: str = "n",
    require: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """``keys, n, distinti``: the rows of each key combination and their different values of ``of``.

    Equal pairs become one row first, spread by the value as well as the key, and the
    pairs are then counted by key: a category with most of the rows is counted by all
    tasks, and none holds its values. NULL values count as rows only. ``require`` and
    ``weight`` as in :func:`count_by`.
    """
    pairs = _pairs(df, keys, of, n, require, weight)
    return pairs.groupBy(*keys).agg(F.sum(n).alias(n), F.count("_of").alias(out))


def distinct_with_totals(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    of: Column | str,
    out: str = "distinti",
    n: str = "n",
    require: Sequence[str] = (),
    weight: str | None = None,
    level: str = "livello",
) -> DataFrame:
    """``keys, n, distinti, livello``: :func:`distinct_by` with the totals above.

    A value that several categories share counts once in their total. A value's pairs
    are put next to each other in the order of the keys, and the first of each total
    is marked: the marks are summed like the rows, so the pairs are not expanded to the
    levels and no task holds a level's values. Levels as in :func:`with_totals`.
    """
    names = list(keys)
    pairs = _pairs(df, keys, of, n, require, weight)
    before = F.lag(F.struct(F.lit(True).alias("_any"), *names)).over(Window.partitionBy("_of").orderBy(*names))
    pairs = pairs.withColumn("_before", before)
    # Mark i: the value's first pair with these first i keys; a value that is NULL has none.
    marks = [f"_{i}" for i in range(len(names) + 1)]
    same = [F.coalesce(F.col("_before._any"), F.lit(False))]
    for c in names:
        same.append(same[-1] & F.col(c).eqNullSafe(F.col("_before")[c]))
    firsts = [(F.col("_of").isNotNull() & ~s).cast("long").alias(m) for s, m in zip(same, marks, strict=True)]
    counted = pairs.select(*names, n, *firsts).groupBy(*names).agg(*[F.sum(c).alias(c) for c in [n, *marks]])
    # Only the counted categories are expanded to the levels.
    sums = [F.sum(c).alias(c) for c in [n, *marks]]
    totals = counted.rollup(*names).agg(*sums, F.grouping_id().alias(level)).filter(F.col(marks[0]).isNotNull())
    # A level's bits are those of the keys that are summed over, the last ones.
    own = F.coalesce(*[F.when(F.col(level) == (1 << (len(names) - i)) - 1, F.col(m)) for i, m in enumerate(marks)])
    return totals.select(*names, n, own.alias(out), level)


def distinct_sketches(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    of: Column | str,
    out: str = "sketch",
    require: Sequence[str] = (),
    log: int = SKETCH_LOG,
) -> DataFrame:
    """``keys, sketch``: a theta sketch of the different values of ``of`` for each key combination.

    Sketches merge in any order and grouping (:func:`merge_sketches`), so they can be
    kept by period and only a new period's records are read. Of at most ``2**log``
    values the count is exact; beyond, its standard error is ``2**(-log / 2)`` (0.8 %
    by default). NULL values are left out.
    """
    cols = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in keys.items()]
    # A sketch passes over empty text, which is a value here like any other.
    value = F.concat(F.lit("="), (F.col(of) if isinstance(of, str) else of).cast("string"))
    rows = df.select(*cols, value.alias("_of"))
    for name in require:
        rows = rows.filter(F.col(name) != "")
    return rows.groupBy(*keys).agg(F.theta_sketch_agg("_of", log).alias(out))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], sketch: str = "sketch", log: int = SKETCH_LOG) -> DataFrame:
    """``keys, sketch``: the union of the sketches of each key combination."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg(sketch, log).alias(sketch))


def sketch_counts(sketches: DataFrame, sketch: str = "sketch", out: str = "distinti") -> DataFrame:
    """The sketches replaced by the number of different values, rounded."""
    rest = [c for c in sketches.columns if c != sketch]
    return sketches.select(*rest, F.round(F.theta_sketch_estimate(sketch)).cast("long").alias(out))


def compare_sketches(
    left: DataFrame, right: DataFrame, keys: Sequence[str], sketch: str = "sketch", log: int = SKETCH_LOG
) -> DataFrame:
    """``keys, sinistra, destra, entrambi, unione``: two sketches of each key combination compared.

    The numbers of values in the left one only, in the right one only, in both and in
    either. A combination that one side lacks has no values there; NULL keys match.
    Beyond the exact range the error of each number is that share of the union, not
    of the number itself.
    """
    both = left.select(*keys, F.col(sketch).alias("_l"), F.lit(None).cast("binary").alias("_r")).unionByName(
        right.select(*keys, F.lit(None).cast("binary").alias("_l"), F.col(sketch).alias("_r"))
    )
    # One aggregation instead of an outer join; the union of no sketch is an empty one.
    sides = both.groupBy(*keys).agg(
        F.theta_union_agg("_l", log).alias("_l"), F.theta_union_agg("_r", log).alias("_r")
    )

    def number(c: Column) -> Column:
        return F.round(F.theta_sketch_estimate(c)).cast("long")

    return sides.select(
        *keys,
        number(F.theta_difference("_l", "_r")).alias("sinistra"),
        number(F.theta_difference("_r", "_l")).alias("destra"),
        number(F.theta_intersection("_l", "_r")).alias("entrambi"),
        number(F.theta_union("_l", "_r", log)).alias("unione"),
    )
