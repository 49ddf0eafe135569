"""Whether a rule could be chance: contingency counts, chi-squared and corrected probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by
from roadstats.operators.support import group_key
from roadstats.scratch import written

# Terms of the two expansions of erfc below; more change nothing in a double.
_TERMS = 70


def erfc(z: Column) -> Column:
    """The complementary error function of a number that is not negative.

    Below 2.5 by the power series of erf, above by the continued fraction, both
    from the last term to the first; each loses no digits where it is used.
    """
    last_first = F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(last_first, F.lit(1.0), lambda rest, k: 1 + rest * 2 * z * z / (2 * k + 1))
    fraction = F.aggregate(last_first, z.cast("double"), lambda rest, k: z + k / 2 / rest)
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2.5, 1 - 2 * z * scale * series).otherwise(scale / fraction)


def rule_counts(found: DataFrame, transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, antecedent, consequent, n, n_antecedent, n_consequent, records`` of every rule.

    ``found`` are the itemsets of :func:`count_itemsets` over ``transactions``, of all
    sizes; a rule's counts are looked up among them. The transactions are only read for
    the number of records in each group.
    """
    weight = "n" if "n" in transactions.columns else None
    records = count_by(transactions, {"_of": group_key(by)}, "records", weight=weight)
    keyed = written(found.select(group_key(by).alias("_by"), "items", "n"), "found")
    split = keyed.filter(F.size("items") > 1).select("_by", "items", "n", F.explode("items").alias("item"))
    split = split.withColumn("antecedent", F.array_remove("items", F.col("item")))

    def counted(out: str) -> DataFrame:
        return keyed.select(F.col("_by").alias("_of"), F.col("items").alias("_set"), F.col("n").alias(out))

    def on(column: Column) -> Column:
        return (F.col("_by") == F.col("_of")) & (column == F.col("_set"))

    rules = split.join(counted("n_antecedent"), on(F.col("antecedent"))).drop("_of", "_set")
    singles = counted("n_consequent").filter(F.size("_set") == 1)
    rules = rules.join(singles, on(F.array("item"))).drop("_of", "_set")
    rules = rules.join(records, F.col("_by") == F.col("_of"))
    return rules.select(
        *[F.col("_by")[c].alias(c) for c in by],
        "antecedent",
        F.array("item").alias("consequent"),
        "n",
        "n_antecedent",
        "n_consequent",
        "records",
    )


def chi_squared(counts: DataFrame) -> DataFrame:
    """Adds ``atteso, chi2, p`` to :func:`rule_counts`.

    ``atteso`` is how many records would follow the rule if its sides were independent,
    ``chi2`` the statistic of the two-by-two table with one degree of freedom and ``p``
    the probability of one at least as large. A side that all records of the group have
    says nothing: 0 and 1. How far a count is off is taken exactly, in decimals, as
    near independence two large products differ by little.
    """
    total, left, right = (F.col(c) for c in ("records", "n_antecedent", "n_consequent"))

    def exact(x: Column, y: Column) -> Column:
        return x.cast("decimal(19,0)") * y.cast("decimal(19,0)")

    off = (exact(F.col("n"), total) - exact(left, right)).cast("double")
    spread = left.cast("double") * right * (total - left) * (total - right)
    chi2 = F.when(spread > 0, off * off * total / spread).otherwise(F.lit(0.0))
    out = counts.withColumn("atteso", left.cast("double") * right / total).withColumn("chi2", chi2)
    return out.withColumn("p", erfc(F.sqrt(F.col("chi2") / 2)))


def adjusted(rules: DataFrame, p: str = "p", out: str = "p_corretto") -> DataFrame:
    """Adds the probabilities corrected for the number of rules (Benjamini-Hochberg).

    Of the rules whose corrected probability is at most a, a share of a is expected to
    be chance. Needs every rule's rank among all. Equal probabilities are counted first
    and then sorted by ranges; a range's place and what comes after it follow from one
    row for each range, so no task sees more than a range of different values.
    """
    rules = written(rules, "rules")
    values = count_by(rules, {"_p": p}, "_m", weight=None)
    ranged = values.repartitionByRange("_p").withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")

    # One row for each range; there are at most as many as shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum("_m").alias("_size"))
    places = sizes.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_all"),
    )
    within = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_rank", F.sum("_m").over(within))
    ranked = ranked.join(places, F.col("_range") == F.col("_of")).select(
        "_p", "_range", (F.col("_p") * F.col("_all") / (F.col("_before") + F.col("_rank"))).alias("_q")
    )
    ranked = written(ranked, "ranked")

    # The least of a rule's own value and those of all that are less significant.
    after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    least = ranked.groupBy("_range").agg(F.min("_q").alias("_least"))
    later = least.select(F.col("_range").alias("_of"), F.min("_least").over(after).alias("_later"))
    here = Window.partitionBy("_range").orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    final = ranked.withColumn("_here", F.min("_q").over(here)).join(later, F.col("_range") == F.col("_of"))
    final = final.select("_p", F.least(F.lit(1.0), "_here", "_later").alias(out))
    return rules.join(final, F.col(p) == F.col("_p")).drop("_p")


def significant_rules(
    found: DataFrame, transactions: DataFrame, by: Sequence[str] = (), most: float | None = None
) -> DataFrame:
    """Rules with their counts, ``atteso``, ``chi2``, ``p`` and ``p_corretto``.

    The correction is for all rules of all groups. ``most`` keeps the rules with at
    most that corrected probability.
    """
    out = adjusted(chi_squared(rule_counts(found, transactions, by)))
    return out if most is None else out.filter(F.col("p_corretto") <= most)
