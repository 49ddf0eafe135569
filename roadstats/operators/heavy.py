"""The most frequent values of each group, of columns with any number of different values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by, rank_in_group
from roadstats.operators.support import group_key
from roadstats.scratch import written

#: Buckets of each of a group's hash rows.
BUCKETS = 4096
#: Hash rows. A value counts towards one bucket of each.
HASH_ROWS = 2


def _buckets(value: Column, buckets: int, hash_rows: int) -> list[Column]:
    # The hash passes over NULL and would give it the bucket of its seed: a value like any other.
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(buckets)).cast("int") for i in range(hash_rows)]


def _rows(
    df: DataFrame, keys: Mapping[str, Column | str], value: Column | str, require: Sequence[str], weight: str | None
) -> DataFrame:
    cols = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in keys.items()]
    what = (F.col(value) if isinstance(value, str) else value).alias("valore")
    n = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w")
    rows = df.select(*cols, what, n)
    for name in require:
        rows = rows.filter(F.col(name) != "")
    return rows


def bucket_counts(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    value: Column | str,
    n: str = "n",
    require: Sequence[str] = (),
    weight: str | None = None,
    buckets: int = BUCKETS,
    hash_rows: int = HASH_ROWS,
) -> DataFrame:
    """``keys, riga, cesto, n``: the rows of each key combination by the hash of their value.

    A bucket's count is an upper bound of the count of every value in it. The table has
    at most ``buckets * hash_rows`` rows for each key combination, however many values
    there are. Counts add up and can be taken back, so they can be kept by period (see
    ``sources.counts``) and merged with :func:`merge_buckets`. They are summed on the
    map side.
    """
    rows = _rows(df, keys, value, require, weight)
    places = _buckets(F.col("valore"), buckets, hash_rows)
    each = rows.select(*keys, F.posexplode(F.array(*places)).alias("riga", "cesto"), "_w")
    return count_by(each, {k: k for k in [*keys, "riga", "cesto"]}, n, weight="_w")


def merge_buckets(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """``keys, riga, cesto, n``: the sums of the bucket counts of each key combination."""
    return count_by(counts, {k: k for k in [*keys, "riga", "cesto"]}, n, weight=n)


def top_values(
    df: DataFrame,
    keys: Mapping[str, Column | str],
    value: Column | str,
    k: int,
    n: str = "n",
    pos: str = "pos",
    require: Sequence[str] = (),
    weight: str | None = None,
    summary: DataFrame | None = None,
    buckets: int = BUCKETS,
    hash_rows: int = HASH_ROWS,
) -> DataFrame:
    """``keys, valore, n, pos``: the ``k`` most frequent values of each key combination, ties by value.

    The counts are exact and no value is missed. The values of the ``2 * k`` fullest
    buckets are counted first; the ``k``-th largest of these counts is one that every
    value of the result reaches. A value can only reach it if all its buckets do, so
    only the values of such buckets are counted and ranked. What a task holds depends
    on the buckets and on the values near the top, not on how many values there are;
    where many values are about as frequent as the ``k``-th, more of them are counted.

    ``df`` is read three times, or twice with a ``summary``, which must be the
    :func:`bucket_counts` of exactly these rows with the same buckets. NULL is a value,
    and a key, like any other; ``require`` names columns (also ``valore``) whose NULL and empty values are
    left out. Groups with fewer than ``k`` values give all of them.
    """
    names = list(keys)
    if summary is None:
        summary = bucket_counts(df, keys, value, "n", require, weight, buckets, hash_rows)
    else:
        summary = summary.withColumnRenamed(n, "n")
    summary = written(summary.select(*names, "riga", "cesto", "n"), "buckets")
    rows = _rows(df, keys, value, require, weight).withColumn("_by", group_key(names))
    places = _buckets(F.col("valore"), buckets, hash_rows)

    def within(rows: DataFrame, chosen: DataFrame, i: int) -> DataFrame:
        of = chosen.filter(F.col("riga") == i).select(group_key(names).alias("_of"), F.col("cesto").alias("_cesto"))
        return rows.join(of, (F.col("_by") == F.col("_of")) & (places[i] == F.col("_cesto")), "left_semi")

    def ranked(rows: DataFrame) -> DataFrame:
        counts = count_by(rows, {c: c for c in [*names, "valore"]}, "n", weight="_w")
        return rank_in_group(counts, names, "n", ["valore"], "_pos").filter(F.col("_pos") <= k)

    fullest = rank_in_group(summary.filter("riga = 0"), names, "n", ["cesto"], "_pos").filter(F.col("_pos") <= 2 * k)
    reached = ranked(within(rows, written(fullest, "fullest"), 0)).filter(F.col("_pos") == k)
    reached = reached.select(group_key(names).alias("_of"), F.col("n").alias("_least"))
    # Groups with fewer than k values in these buckets have no bound.
    bounded = summary.join(reached, group_key(names) == F.col("_of"), "left")
    strong = written(bounded.filter(F.col("_least").isNull() | (F.col("n") >= F.col("_least"))), "strong")
    for i in range(hash_rows):
        rows = within(rows, strong, i)
    return ranked(rows).select(*names, "valore", F.col("n").alias(n), F.col("_pos").alias(pos))
