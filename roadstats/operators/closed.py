"""Which of the found itemsets and rules say something that the others do not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.operators.support import group_key


def mark_itemsets(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, items, n, chiuso, massimale``: found itemsets that are closed, and that are maximal.

    Closed: no larger itemset of the group is in as many records, so the smaller one
    is not implied by it. Maximal: no larger one was found at all. The closed sets give
    every other set's count, the maximal ones only which sets there are. ``found`` has
    the itemsets of :func:`count_itemsets` (sorted items; with any minimum support, but
    all sizes above the smallest kept). A larger set only needs to be compared with
    those one smaller, as counts never grow with the set: each set sends its count to
    them, and the largest that arrives decides. One aggregation, no join.
    """
    keyed = found.select(group_key(by).alias("_by"), "items", "n")
    own = keyed.select("_by", "items", "n", F.lit(None).cast("long").alias("_up"))
    left_out = F.transform("items", lambda i: F.array_remove("items", i))
    smaller = keyed.filter(F.size("items") > 1).select(
        "_by", F.explode(left_out).alias("items"), F.lit(None).cast("long").alias("n"), F.col("n").alias("_up")
    )
    marked = own.unionByName(smaller).groupBy("_by", "items").agg(F.max("n").alias("n"), F.max("_up").alias("_up"))
    return marked.filter(F.col("n").isNotNull()).select(
        *[F.col("_by")[c].alias(c) for c in by],
        "items",
        "n",
        F.coalesce(F.col("_up") < F.col("n"), F.lit(True)).alias("chiuso"),
        F.col("_up").isNull().alias("massimale"),
    )


def essential_rules(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rules without those that a shorter antecedent already gives.

    A rule goes if a part of its antecedent is in exactly the same records: the rule
    from that part has the same consequent, confidence and number of records, and is
    kept. That part exists if some rule within the antecedent is certain (confidence
    1), so the certain rules, joined into sets, are all that needs to be looked up.
    ``rules`` are those of :func:`mine_rules` before short antecedents are filtered.
    """
    implied = rules.filter(F.col("confidence") == 1).select(
        group_key(by).alias("_of"),
        F.sort_array(F.concat("antecedent", "consequent")).alias("_set"),
    )
    # A set may come from several certain rules; a semi-join needs it once.
    on = (F.col("_by") == F.col("_of")) & (F.sort_array("antecedent") == F.col("_set"))
    keyed = rules.withColumn("_by", group_key(by))
    return keyed.join(implied.distinct(), on, "left_anti").drop("_by")
