"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed once per cell (source, language, topic). The cells' weights
are raked: scaled in turn so that their sums over each dimension meet its
targets, never above the tokens a cell has, until all sums agree. A cell's weight over
its tokens is the probability with which its documents are sampled, so the
sample's expected tokens meet the targets and no document is taken twice. Cells
are as many as the categories' combinations, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.llm.common import let, materialize, without, words_of

DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the default targets: a share p gets a target in proportion to p ** exponent.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}


def topic_of(text: Column) -> Column:
    """A topic by form, for tables without one: empty, short, table, list, long or prose."""
    plain = F.coalesce(text, F.lit(""))

    def of(n: Column) -> Column:
        lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
        return (
            F.when(n == 0, "empty")
            .when(F.contains(plain, F.lit(" | ")), "table")
            .when(n < 100, "short")
            .when(lines * 8 > n, "list")
            .when(n >= 1000, "long")
            .otherwise("prose")
        )

    return let(F.size(words_of(plain)), of)


def with_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tokens`` (words of the whole text, at least 1) and ``topic`` unless it has one."""
    made = {"tokens": F.greatest(F.size(words_of(F.col("text"))), F.lit(1)).cast("double")}
    if "topic" not in docs.columns:
        made["topic"] = topic_of(F.col("text"))
    return docs.withColumns(made)


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def default_targets(cells: DataFrame, temper: Mapping[str, float]) -> dict[str, DataFrame]:
    """Tempered shares of each dimension's values: ``_<dimension>, target``."""
    out = {}
    for d, exponent in temper.items():
        sums = cells.groupBy(f"_{d}").agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("t"))
        out[d] = sums.select(f"_{d}", (F.col("t") / F.sum("t").over(Window.partitionBy())).alias("target"))
    return out


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    keep: float,
    sweeps: int = 60,
    tolerance: float = 5e-4,
    block: int = 4,
) -> DataFrame:
    """``cells`` with ``weight``, at most ``tokens`` and raked to the targets of every dimension, and ``unmet``.

    The weights' sum aims at ``keep`` of all tokens. A value without a target
    gets none. Sweeps end when no dimension's sum is off by more than
    ``tolerance`` of all weight, when a sweep moves no more than that, or after
    ``sweeps``; targets that the cells cannot meet are met as far as they can.
    ``unmet`` is the same in all rows: how far the worst sum is off then, as a share
    of all weight.
    """
    aim = F.sum("tokens").over(Window.partitionBy()) * keep
    held = cells.withColumn("_aim", aim)
    for d, wanted in targets.items():
        aims = wanted.select(f"_{d}", F.col("target").alias(f"_t_{d}"))
        held = held.join(aims, f"_{d}", "left")
    held = held.withColumns({f"_t_{d}": F.coalesce(f"_t_{d}", F.lit(0.0)) * F.col("_aim") for d in targets})
    held = materialize(held.withColumn("weight", F.col("tokens") * keep), "cells")
    # Cells are few: a shuffle needs a task for each 100,000 of them.
    tasks = 1 + held.count() // 100_000
    error = None
    for _ in range(0, sweeps, block):
        for _ in range(block):
            held = held.withColumn("_last", F.col("weight"))
            for d in targets:
                held = held.repartition(tasks, f"_{d}")
                sums = F.sum("weight").over(Window.partitionBy(f"_{d}"))
                scaled = F.when(sums > 0, F.col("weight") * F.col(f"_t_{d}") / sums).otherwise(0.0)
                held = held.withColumn("weight", F.least(scaled, F.col("tokens")))
        held = materialize(held, "cells")
        errors = [
            F.abs(F.sum("weight").over(Window.partitionBy(f"_{d}")) - F.col(f"_t_{d}")) / F.col("_aim")
            for d in targets
        ]
        moved = F.abs(F.col("weight") - F.col("_last")) / F.col("_aim")
        worst = held.select(F.greatest(*errors, F.lit(0.0)).alias("e"), moved.alias("m"))
        error, change = worst.agg(F.max("e"), F.sum("m")).first()
        if error is None or min(error, change) <= tolerance:
            break
    out = held.drop("_aim", "_last", *[f"_t_{d}" for d in targets])
    return out.withColumn("unmet", F.lit(error).cast("double"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    keep: float = 0.7,
    temper: Mapping[str, float] = TEMPER,
    seed: int = 11,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``tokens, topic, weight, probability, unmet, kept``; no row is dropped.

    ``targets`` gives a table ``_<dimension>, target`` of shares for each
    dimension, with values written "=value" and "-" for NULL; by default the
    shares found, tempered. ``weight`` is a document's calibrated token weight,
    its tokens times its probability. ``kept`` compares the probability with a
    hash of doc_id and text, so equal rows are kept or left together and a
    NULL doc_id needs no care. NULL categories are categories of their own. A
    blank text counts as one token. ``unmet`` tells how far the targets were missed, see
    :func:`rake`. Columns that clash with those made here are replaced, but for a topic,
    which counts. An empty table gives no rows.
    """
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    made = ("tokens", "weight", "probability", "unmet", "kept", "_draw", *[f"_{d}" for d in DIMENSIONS])
    rows = with_tokens(docs.select(*without(docs, *made))).withColumn("_draw", draw)
    rows = rows.withColumns({f"_{d}": _key(d) for d in DIMENSIONS})
    rows = materialize(rows if keep_text else rows.drop("text"), "mix-rows")
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = materialize(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "cells")
    weighed = rake(cells, targets or default_targets(cells, temper), keep)
    chance = weighed.select(*keys, (F.col("weight") / F.col("tokens")).alias("probability"), "unmet")
    # The cells were just written, so their size is known; Spark broadcasts them only while they are small.
    joined = rows.join(chance, keys)
    return joined.withColumns(
        {"weight": F.col("tokens") * F.col("probability"), "kept": F.col("_draw") < F.col("probability")}
    ).drop(*keys, "_draw")
