"""Itemsets with a minimum support from weighted rows, level by level and within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by
from roadstats.scratch import written

#: Every later place of the row.
_LATER = """if(element_at(s, -1) + 1 < size(items), sequence(element_at(s, -1) + 1, size(items) - 1), cast(array() AS array<int>))"""

#: The row's sets (arrays of places in ``items``, ascending) and every later place of the row
#: give the sets one larger; each must have all its smaller sets among the row's.
_LARGER_WIDE = f"""flatten(transform(sets, s -> transform(
  filter(
    {_LATER},
    j -> forall(
      sequence(1, size(s)),
      p -> array_contains(sets, concat(slice(s, 1, p - 1), slice(s, p + 1, size(s)), array(j)))
    )
  ),
  j -> concat(s, array(j))
)))"""

#: The same where the places are few enough for the bits of a long: sets are looked up as numbers.
_LARGER = f"""if(size(items) > 62, {_LARGER_WIDE}, get(transform(
  array(transform(sets, s -> aggregate(s, 0L, (bits, i) -> bits | shiftleft(1L, i)))),
  codes -> flatten(transform(sets, (s, k) -> transform(
    filter(
      {_LATER},
      j -> forall(s, i -> array_contains(codes, (get(codes, k) | shiftleft(1L, j)) ^ shiftleft(1L, i)))
    ),
    j -> concat(s, array(j))
  )))
), 0))"""


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one value that is never NULL, so that it can be joined."""
    return F.struct(*by) if by else F.lit(True)


def _least(rows: DataFrame, min_support: float) -> DataFrame:
    """The number of records that the support asks for in each group."""
    return rows.groupBy(F.col("_by").alias("_of")).agg(
        F.ceil(F.lit(min_support) * F.sum("n")).alias("_least")
    )


def _frequent(counts: DataFrame, least: DataFrame) -> DataFrame:
    enough = counts.join(least, F.col("_by") == F.col("_of")).filter(F.col("n") >= F.col("_least"))
    return enough.select(*counts.columns)


def supported_itemsets(
    transactions: DataFrame, min_support: float, by: Sequence[str] = ()
) -> DataFrame:
    """``by, items, n``: the itemsets that at least ``min_support`` of their group's records have.

    ``transactions`` have ``items`` (distinct, sorted) and, if their rows stand for
    several records, the weight ``n``; columns ``by`` name the group (NULL is one).
    Level by level: items that are not frequent in their group leave the rows, rows
    that are then equal become one, and a row lists a larger set only if all
    smaller ones in it are frequent. Each level is one count and one semi-join, is
    written, and ends the loop if it is empty; nothing but that reaches the driver.
    Rows may have any width; a row carries its own frequent sets of one size.
    """
    if not 0 < min_support <= 1:
        raise ValueError("a support is a share above 0")
    weight = "n" if "n" in transactions.columns else None
    keyed = transactions.withColumn("_by", group_key(by))
    rows = written(count_by(keyed, {"_by": "_by", "items": "items"}, "n", weight=weight), "rows")
    least = written(_least(rows, min_support), "least")

    entries = rows.select("*", F.explode("items").alias("item"))
    singles = count_by(entries, {"_by": "_by", "item": "item"}, "n", weight="n")
    singles = written(_frequent(singles, least), "sets")
    known = singles.select(F.col("_by").alias("_of"), F.col("item").alias("_item"))
    left = entries.join(known, (F.col("_by") == F.col("_of")) & (F.col("item") == F.col("_item")), "left_semi")
    left = left.groupBy("_by", "items", "n").agg(F.sort_array(F.collect_list("item")).alias("left"))
    rows = count_by(left, {"_by": "_by", "items": "left"}, "n", weight="n")
    first = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.array(i))
    rows = written(rows.select("*", first.alias("sets"), F.monotonically_increasing_id().alias("_row")), "rows")

    found = singles.select("_by", F.array("item").alias("items"), "n")
    while True:
        # The larger sets are found once: their count and the choice among them both read the files.
        rows = written(rows.select("_row", "_by", "items", "n", F.expr(_LARGER).alias("larger")), "rows")
        listed = rows.select("_row", "_by", "items", "n", F.explode("larger").alias("_at"))
        listed = listed.withColumn("_set", F.transform("_at", lambda i: F.get("items", i)))
        counts = count_by(listed, {"_by": "_by", "items": "_set"}, "n", weight="n")
        level = written(_frequent(counts, least), "sets")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        known = level.select(F.col("_by").alias("_of"), F.col("items").alias("_known"))
        on = (F.col("_by") == F.col("_of")) & (F.col("_set") == F.col("_known"))
        rows = listed.join(known, on, "left_semi").groupBy("_row").agg(
            *[F.first(c).alias(c) for c in ("_by", "items", "n")], F.collect_list("_at").alias("sets")
        )
    return found.select(*[F.col("_by")[c].alias(c) for c in by], "items", "n")


def supported_rules(found: DataFrame, min_confidence: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """``by, antecedent, consequent, confidence`` of itemsets that hold all their subsets.

    Every rule has one consequent item; its antecedent's count is looked up among
    the itemsets, so the records are not read again.
    """
    keyed = found.withColumn("_by", group_key(by))
    split = keyed.filter(F.size("items") > 1).select("_by", "items", "n", F.explode("items").alias("item"))
    split = split.withColumn("antecedent", F.array_remove("items", F.col("item")))
    alone = keyed.select(F.col("_by").alias("_of"), F.col("items").alias("_alone"), F.col("n").alias("_n"))
    on = (F.col("_by") == F.col("_of")) & (F.col("antecedent") == F.col("_alone"))
    rules = split.join(alone, on).withColumn("confidence", F.col("n") / F.col("_n"))
    return rules.filter(F.col("confidence") >= min_confidence).select(
        *[F.col("_by")[c].alias(c) for c in by], "antecedent", F.array("item").alias("consequent"), "confidence"
    )
