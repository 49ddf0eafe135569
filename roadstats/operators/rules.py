"""Itemsets, association rules and their scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.operators.counts import count_by
from roadstats.operators.support import supported_itemsets, supported_rules

# Bits of a subset's mask that one array lists.
_STRETCH = 16
# A mask is a long; no engine could list the subsets of wider rows anyway.
_MOST_ITEMS = 62

Score = Callable[[Column, Column], Column]


def _items(fields: Sequence[str], tag_fields: bool) -> Column:
    cells = [
        F.concat(F.lit(f + "="), F.col(f)) if tag_fields else F.col(f) for f in fields
    ]
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*cells))))


def itemsets(
    df: DataFrame,
    fields: Mapping[str, Column | str],
    tag_fields: bool = False,
    weight: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The set of distinct non-null field values of each row, as a sorted array ``items``.

    Rows that were counted first carry their ``weight`` along as ``n``; mining
    then works on the few counted rows and not on the records. ``tag_fields``
    gives ``field=value`` items, which keeps equal values of two fields apart.
    Columns to ``keep`` are passed on.
    """
    cols = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]
    kept = [F.col(weight).alias("n")] if weight else []
    items = _items(list(fields), tag_fields).alias("items")
    rest = [F.col(c).alias(f"_{c}") for c in keep]
    out = df.select(*cols, *kept, *rest).select(items, *(["n"] if weight else []), *[f"_{c}" for c in keep])
    return out.withColumnsRenamed({f"_{c}": c for c in keep})


def _checked(items: Column, max_width: int) -> Column:
    too_wide = F.raise_error(F.lit(f"a row has more than {max_width} items; set a minimum support"))
    return F.when(F.size(items) <= max_width, items).otherwise(too_wide)


def _subsets(transactions: DataFrame, max_width: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Every non-empty subset of each transaction (``items``), the items left out, the weight, ``by``.

    The masks come from nested lists of a bounded length, so that a wide row's
    subsets are never held at once.
    """
    rows = transactions
    if "n" not in transactions.columns:
        rows = count_by(rows, {"items": "items"}, "n")
    most = min(max_width or _MOST_ITEMS, _MOST_ITEMS)
    rows = rows.select(_checked(F.col("items"), most).alias("items"), "n", *by)

    def masks(bits: Column) -> Column:
        last = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sequence(F.lit(0).cast("long"), last)

    # The mask in stretches of bits, lowest first; wide rows fill several.
    listed, mask = rows, F.lit(0).cast("long")
    for at in range(0, most, _STRETCH):
        bits = F.greatest(F.least(F.size("items") - at, F.lit(_STRETCH)), F.lit(0))
        listed = listed.select("*", F.explode(masks(bits)).alias(f"_{at}"))
        mask = mask + F.call_function("shiftleft", F.col(f"_{at}"), F.lit(at))
    listed = listed.select("items", "n", *by, mask.alias("mask"))

    # Bit i of the mask chooses item i; mask 0 is listed so that a row without
    # items needs no filter, which would be evaluated on every source row.
    def chosen(bit: int) -> Column:
        return F.filter("items", lambda x, i: F.getbit(F.col("mask"), i) == bit)

    return listed.filter("mask > 0").select(chosen(1).alias("items"), chosen(0).alias("rest"), "n", *by)


def _engine(engine: str, transactions: DataFrame, min_support: float, by: Sequence[str] = ()) -> str:
    if engine == "auto":
        if by:
            return "levelwise" if min_support else "powerset"
        return "powerset" if min_support == 0 or "n" in transactions.columns else "fpgrowth"
    if engine not in ("powerset", "fpgrowth", "levelwise"):
        raise ValueError(f"unknown engine {engine!r}")
    if by and engine == "powerset" and min_support:
        raise ValueError("a support within groups needs the levelwise engine")
    if by and engine == "fpgrowth":
        raise ValueError("fpgrowth knows no groups")
    return engine


def _least(transactions: DataFrame, min_support: float) -> Column:
    """The number of records that a support asks for."""
    weight = F.sum("n") if "n" in transactions.columns else F.count(F.lit(1))
    return F.ceil(F.lit(min_support) * transactions.agg(weight).scalar())


def _fit(transactions: DataFrame, min_support: float, min_confidence: float):
    if "n" in transactions.columns:
        raise ValueError("fpgrowth needs one row per record, not counted rows")
    fpm = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    return fpm.fit(transactions)


def count_itemsets(
    transactions: DataFrame,
    min_items: int = 1,
    min_support: float = 0.0,
    engine: str = "auto",
    max_width: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``items, n``: every itemset with at least ``min_items`` items and its number of records.

    ``powerset`` lists the subsets of the counted rows in plain DataFrame steps,
    with or without a support; ``fpgrowth`` is Spark ML's, takes one row per
    record and suits wide rows with a minimum support. ``auto`` takes the second
    for such rows only. ``levelwise`` takes wide rows with a support as well, counted
    or not, and the support may be one of each value of the columns ``by``, which
    come first in the result; ``auto`` takes it for groups with a support. A
    ``max_width`` makes ``powerset`` fail on wider rows.
    """
    chosen = _engine(engine, transactions, min_support, by)
    if chosen == "levelwise":
        out = supported_itemsets(transactions, min_support, by)
    elif chosen == "fpgrowth":
        found = _fit(transactions, min_support, 0.0).freqItemsets
        out = found.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"))
    else:
        keys = {k: k for k in [*by, "items"]}
        out = count_by(_subsets(transactions, max_width, by), keys, "n", weight="n")
        if min_support:
            out = out.filter(F.col("n") >= _least(transactions, min_support))
    return out.filter(F.size("items") >= min_items)


def mine_rules(
    transactions: DataFrame,
    min_support: float = 0.0,
    min_confidence: float = 0.0,
    engine: str = "auto",
    max_width: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``antecedent, consequent, confidence`` for every rule with one consequent item.

    ``powerset`` works in one pass: each counted row adds its weight to every
    subset and to every (subset, left-out item) pair, so no self-join of the
    itemsets is needed. Engines as in :func:`count_itemsets`. With ``by``
    (columns of counted rows) rules are mined within each of its values, in the
    same pass; the columns come first in the result. With a support as well, it is
    one of each value's records, and ``levelwise`` finds the itemsets.
    """
    chosen = _engine(engine, transactions, min_support, by)
    if by and "n" not in transactions.columns:
        raise ValueError("rules by group need counted rows")
    if chosen == "levelwise":
        return supported_rules(supported_itemsets(transactions, min_support, by), min_confidence, by)
    if chosen == "fpgrowth":
        rules = _fit(transactions, min_support, min_confidence).associationRules
        return rules.select(
            F.sort_array("antecedent").alias("antecedent"), "consequent", "confidence"
        )
    none = F.array(F.lit(None).cast("string"))
    keys = [*by, "antecedent", "item"]
    pairs = count_by(
        _subsets(transactions, max_width, by).select(
            *by,
            F.col("items").alias("antecedent"),
            F.explode(F.concat(none, F.col("rest"))).alias("item"),
            "n",
        ),
        {k: k for k in keys},
        "n",
        weight="n",
    )
    alone = F.max(F.when(F.col("item").isNull(), F.col("n")))
    within = Window.partitionBy(*by, "antecedent")
    confidence = F.col("n") / alone.over(within)
    kept = F.col("item").isNotNull() & (F.col("confidence") >= min_confidence)
    if min_support:
        kept = kept & (F.col("n") >= _least(transactions, min_support))
    return (
        pairs.withColumn("confidence", confidence)
        .filter(kept)
        .select(
            *by,
            "antecedent",
            F.array("item").alias("consequent"),
            "confidence",
        )
    )


def filter_rules(
    rules: DataFrame, min_antecedent: int = 1, exclude_items: Sequence[str] = ("",)
) -> DataFrame:
    """Keep rules with enough antecedent items, none of them excluded."""
    keep = F.size("antecedent") >= min_antecedent
    for item in exclude_items:
        keep = keep & ~F.array_contains("antecedent", item)
    return rules.filter(keep)


def baseline_from_counts(df: DataFrame, item: Column | str, out: str = "freq") -> DataFrame:
    """``item, freq``: share of each value among all rows of ``df``, from one scan.

    Rows without a value count for the total and go only after it is taken, from
    the few counted rows.
    """
    counts = count_by(df, {"item": item}, "n")
    total = F.sum("n").over(Window.partitionBy())
    shares = counts.select("item", (F.col("n") / total).alias(out))
    return shares.filter(F.col("item").isNotNull())


def baseline_from_rules(rules: DataFrame, antecedent: Sequence[str]) -> DataFrame:
    """``item, freq``: confidence of each consequent under one given antecedent."""
    wanted = F.array(*[F.lit(i) for i in sorted(antecedent)])
    return rules.filter(F.col("antecedent") == wanted).select(
        F.col("consequent")[0].alias("item"), F.col("confidence").alias("freq")
    )


def ratio_score(confidence: Column, baseline: Column) -> Column:
    """Confidence relative to how frequent the consequent is anyway."""
    return F.when(baseline == 0, F.lit(float("inf"))).otherwise(confidence / baseline)


def inverse_log_score(confidence: Column, baseline: Column | None = None) -> Column:
    """1 / abs(log10(confidence)); a certain rule scores infinity."""
    return F.when(confidence == 1, F.lit(float("inf"))).otherwise(1 / F.abs(F.log10(confidence)))


SCORES: dict[str, Score] = {
    "confidence": lambda confidence, baseline: confidence,
    "ratio": ratio_score,
    "inverse_log": inverse_log_score,
}


def score_rules(
    rules: DataFrame,
    baseline: DataFrame | None = None,
    score: str | Score = "confidence",
    threshold: float | None = None,
) -> DataFrame:
    """Add ``score`` and keep the rules that reach ``threshold``.

    With a ``baseline`` (``item, freq``) only rules whose consequent it lists
    are kept; of an item listed twice the largest frequency counts. ``score`` is a name from ``SCORES`` or a function of the
    confidence and the baseline frequency.
    """
    freq = F.lit(None).cast("double")
    if baseline is not None:
        known = baseline.groupBy(F.col("item").alias("_item")).agg(F.max("freq").alias("_freq"))
        rules = rules.join(known, F.col("consequent")[0] == F.col("_item"))
        freq = F.col("_freq")
    elif score == "ratio":
        raise ValueError("the ratio needs a baseline")
    fn = SCORES[score] if isinstance(score, str) else score
    scored = rules.withColumn("score", fn(F.col("confidence"), freq)).drop("_item", "_freq")
    return scored if threshold is None else scored.filter(F.col("score") >= threshold)


def rule_lines(scored: DataFrame) -> DataFrame:
    """Rules as text lines: ``[a, b] => [c], score``."""

    def bracket(c: str) -> Column:
        return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))

    line = F.concat(
        bracket("antecedent"),
        F.lit(" => "),
        bracket("consequent"),
        F.lit(", "),
        F.col("score").cast("string"),
    )
    return scored.select(line.alias("value"))
