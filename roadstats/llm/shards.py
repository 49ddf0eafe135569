"""Shards of near equal size by sampled splitters.

Records are ordered by a hash of their text, so that copies lie next to each
other. A sample drawn with probability in proportion to a record's size gives
quantile boundaries; records fall into the ranges between them, and a range
that holds more than its share (one text's copies, or more bytes than a task
should hold) is subdivided by a hash of the doc_id. Exact prefix sums over the
ranges then turn each record's position into its shard, so the sizes do not
depend on the sample's luck. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.llm.common import materialize, without

OVERHEAD = 16


def _records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    made = ("size", "text_crc32", "key")
    return docs.select(
        *without(docs, "text", "shard", "slot", *made),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def splitters(records: DataFrame, n_ranges: int, sample: int) -> DataFrame:
    """One row with ``bounds``, the sorted inner boundaries of at most ``n_ranges`` ranges of ``key``.

    About ``sample`` records are drawn, each with probability size * sample /
    total (at most 1), by a hash of the record; the sample does not grow with
    the table.
    """
    whole = records.agg(F.sum("size")).scalar()
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.filter(draw < F.col("size") * F.lit(float(sample)) / whole)
    keys = drawn.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    step = F.sequence(F.lit(1), F.lit(n_ranges - 1))
    at = F.transform(step, lambda i: F.get("keys", (i * F.size("keys") / n_ranges).cast("int")))
    return keys.select(F.array_distinct(F.array_compact(at)).alias("bounds"))


def _range_of(key: Column, bounds: Column, n_ranges: int) -> Column:
    """Number of boundaries that are not above ``key``, by binary search."""
    rounds = F.sequence(F.lit(1), F.lit(n_ranges.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= key)
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(rounds, start, halve, lambda s: s["lo"])


def sampled_shards(
    docs: DataFrame,
    n_shards: int = 40,
    ranges_per_shard: int = 1,
    sample: int = 20_000,
    chunk_bytes: int = 256 << 20,
) -> DataFrame:
    """``docs`` without text, with ``size, text_crc32, shard, slot``.

    Shards 0 to ``n_shards`` - 1 hold near equal sums of ``size`` (UTF-8 bytes of
    the text plus 16; NULL counts as empty). A shard is a stretch of the order
    (range, chunk of an overfull range, place in the chunk). Within a chunk small
    records stand at both ends and large ones in the middle, so that a border
    between shards passes between small records. Copies of one text stay together
    unless they hold more than a twentieth of a shard. ``slot`` numbers a shard's records without gaps.
    Repeated rows and NULL ids are records like others; an empty table gives no rows.
    """
    records = materialize(_records(docs), "records")
    n_ranges = n_shards * ranges_per_shard
    ranged = records.withColumn("bounds", splitters(records, n_ranges, sample).scalar()).withColumn(
        "range", _range_of(F.col("key"), F.col("bounds"), n_ranges)
    )
    # Overfull: more than twice an equal share, or than a task should hold. There are at most n_ranges rows.
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy()) / n_ranges
    cuts = F.greatest(F.ceil(F.col("bytes") / share / 2), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    chunks = sums.select("range", cuts.alias("chunks"))
    # A text with more than a range's share is a boundary itself; only its copies part.
    spread = F.when(F.array_contains("bounds", F.col("key")), F.xxhash64("doc_id", "size")).otherwise(
        F.xxhash64("key", F.lit(3))
    )
    dealt = materialize(
        ranged.join(F.broadcast(chunks), "range")
        .withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
        .drop("chunks", "bounds"),
        "dealt",
    )
    cell = ["range", "chunk"]
    # Small, large, small: odd places ascend, even places descend.
    by_size = Window.partitionBy(*cell).orderBy("size", "key")
    nth = F.dense_rank().over(by_size)
    hill = dealt.withColumn("_nth", nth).withColumn(
        "_place", F.when(F.col("_nth") % 2 == 1, F.col("_nth")).otherwise(-F.col("_nth"))
    )
    up_first = [F.when(F.col("_place") > 0, 0).otherwise(1), "_place", "doc_id", "text_crc32"]
    so_far = Window.partitionBy(*cell).orderBy(*up_first).rowsBetween(Window.unboundedPreceding, -1)
    placed = hill.withColumns(
        {
            "_bytes": F.coalesce(F.sum("size").over(so_far), F.lit(0)),
            "_row": F.coalesce(F.count(F.lit(1)).over(so_far), F.lit(0)),
        }
    )
    # Prefix sums over the cells, first within each range and then over the ranges.
    sizes = dealt.groupBy(*cell).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("range").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = sizes.groupBy("range").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    starts = per_range.select(
        "range",
        F.coalesce(F.sum("b").over(outer), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n0"),
        F.sum("b").over(Window.partitionBy()).alias("all_bytes"),
    )
    offsets = sizes.select(
        *cell,
        F.coalesce(F.sum("b").over(inner), F.lit(0)).alias("b1"),
        F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("n1"),
    ).join(starts, "range")
    # A record belongs to the shard that holds its middle byte, or that of its copies if these are
    # less than a twentieth of a shard; so the order's stretches stay whole.
    copies = Window.partitionBy(*cell, "size", "key")
    placed = placed.withColumns(
        {"_copies": F.sum("size").over(copies), "_from": F.min("_bytes").over(copies)}
    )
    few = F.col("_copies") * 20 * n_shards <= F.col("all_bytes")
    inside = F.when(few, F.col("_from") + F.col("_copies") / 2).otherwise(F.col("_bytes") + F.col("size") / 2)
    middle = F.col("b0") + F.col("b1") + inside
    shard = F.least(F.floor(middle * n_shards / F.col("all_bytes")), F.lit(n_shards - 1)).cast("int")
    rows = placed.join(offsets, cell).select(
        *without(records, "key"),
        *cell,
        shard.alias("shard"),
        (F.col("n0") + F.col("n1") + F.col("_row")).alias("_at"),
    )
    rows = materialize(rows, "placed")
    first = rows.groupBy("shard").agg(F.min("_at").alias("_first"))
    # One row per shard.
    return rows.join(F.broadcast(first), "shard").select(
        *without(records, "key"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), *cell
    )
