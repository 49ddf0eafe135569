"""A Merkle manifest of a table: a digest for each row, a tree for each group, one root.

Rows of a group are the leaves of a tree in which every ``fan`` consecutive nodes
have one parent; the groups' own roots are the leaves of a tree above. A level is
computed with lag and lead columns of fixed offsets: a node's slot within its run
and the run's length mask which neighbours are its siblings, and the first child
hashes the parent. A block of the fan's largest power up to ``BLOCK`` leaves is one window,
so one shuffle and one sort serve that many levels, and no group, however large,
meets in one task. What a block ends in is a node of the next, much smaller, round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.llm.common import materialize, parts

#: Leaves that a block has at most, so that it stays in a window's memory buffer (3**7 are 2,187).
BLOCK = 4096
#: A siblings' step: the digests left and right of a node, joined.
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value without ambiguity: ``-`` for NULL, else its UTF-8 length, ``:`` and the value."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256, in lowercase hex, of the values one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``_pos``, the place from 0 within ``group`` by ``order``, and ``_size``, the group's rows.

    The rows are dealt to ranges by group and order and written; a row's number
    within its range comes from the sorted file. Only the ranges' counts, a row
    for each range and group in it, meet in a window. Equal rows get any of their places.
    """
    n = parts(rows.sparkSession, 200 * rows.count(), 32 << 20)
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    cells = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(
        F.col(group).alias("_of"),
        F.col("_range").alias("_in"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_size"),
    )
    placed = dealt.join(cells, (F.col(group) == F.col("_of")) & (F.col("_range") == F.col("_in")))
    return placed.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_of", "_in", "_shift")


def levels(fan: int) -> int:
    """Levels that one round of windows climbs."""
    n = 1
    while fan ** (n + 1) <= BLOCK:
        n += 1
    return n


def _round(nodes: DataFrame, fan: int) -> DataFrame:
    """Climb :func:`levels` levels: ``steps`` of every node, ``apex`` at the first node of each block.

    ``nodes`` have ``_group, _pos, _size, _digest``. Windows hold blocks, so that no
    run is cut: a block's size is a power of the fan.
    """
    block = f"_pos div {fan ** levels(fan)} AS _block"
    rows = nodes.selectExpr("_group", "_pos", "_size", block, "_digest AS apex", f"cast(array() AS {STEPS}) AS steps")
    kept = ("_group", "_pos", "_size", "_block")
    window = "PARTITION BY _group, _block ORDER BY _pos"
    for level in range(levels(fan)):
        # Nodes of this level stand on the rows of their first leaf and have ``apex``; other rows have none.
        width = fan**level
        slot, count = f"(_pos div {width} % {fan})", f"((_size + {width - 1}) div {width})"
        run = f"least({fan}, {count} - _pos div {width} + {slot})"
        left = [f"if({slot} >= {k}, lag(apex, {k * width}) OVER ({window}), NULL)" for k in range(fan - 1, 0, -1)]
        right = [f"if({slot} + {k} < {run}, lead(apex, {k * width}) OVER ({window}), NULL)" for k in range(1, fan)]
        rows = rows.selectExpr(
            *kept,
            "apex",
            "steps",
            f"concat_ws('', {', '.join(left)}) AS _left",
            f"concat_ws('', {', '.join(right)}) AS _right",
        )
        # The first child hashes the parent; every leaf takes the step of its ancestor, the last node at or before it.
        first = f"apex IS NOT NULL AND _pos % {width * fan} = 0"
        step = "last(if(apex IS NOT NULL, named_struct('left', _left, 'right', _right), NULL), true)"
        rows = rows.selectExpr(
            *kept,
            f"if({first}, if({count} > 1, sha2(concat(apex, _right), 256), apex), NULL) AS apex",
            f"if({count} > 1, concat(steps, array({step} OVER ({window}))), steps) AS steps",
        )
    return rows


def climb(nodes: DataFrame, fan: int, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds from the leaves up, and ``_group, _digest`` of each group's root.

    ``most`` is the largest group's number of leaves; it sets the number of rounds.
    """
    rounds = []
    while most > 1:
        rounds.append(materialize(_round(nodes, fan), name))
        up = F.col("_pos") / fan ** levels(fan)
        nodes = rounds[-1].filter(F.col("_pos") % fan ** levels(fan) == 0).select(
            "_group",
            F.floor(up).alias("_pos"),
            F.ceil(F.col("_size") / fan ** levels(fan)).alias("_size"),
            F.col("apex").alias("_digest"),
        )
        most = -(-most // fan ** levels(fan))
    return rounds, nodes.select("_group", "_digest")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``_group, _pos, steps``: every leaf's steps to the root.

    ``above`` has ``_group, _pos`` (0) and the ``steps`` and other columns of each
    group's root, which its leaves get too. A block is joined to the one node above
    it, so a join's key never has more rows than a block.
    """
    own = [c for c in above.columns if c not in ("_group", "_pos", "steps")]
    for rows in reversed(rounds):
        up = above.select(
            F.col("_group").alias("_of"), F.col("_pos").alias("_up"), F.col("steps").alias("_rest"), *own
        )
        joined = rows.join(up, (F.col("_group") == F.col("_of")) & (F.col("_block") == F.col("_up")))
        above = joined.select("_group", "_pos", F.concat("steps", "_rest").alias("steps"), *own)
    return above


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("_size")).first()[0] or 0


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def merkle_manifest(rows: DataFrame, group: str, order: str, fan: int = 3) -> DataFrame:
    """A tree over each group's leaves and one over the groups' roots, with every leaf's way up.

    ``rows`` have ``group``, ``order``, ``leaf`` (a hex digest) and any other
    columns, which are kept (those named ``subroot``, ``root`` and ``steps`` are
    replaced). Leaves ascend by ``order``, NULL first, ties by leaf; equal rows
    get any of their places. Groups ascend by their UTF-8 bytes, NULL first and a
    group of its own. Every ``fan`` consecutive nodes, also a last single one, have
    one parent until one is left; a lone leaf is the root of its group. ``steps``
    lists, from the leaf to the root, the siblings left and right of the way. An
    empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("subroot", "root", "steps")]
    # NULL is a group before all others; names keep their order of bytes.
    label = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    order_of = [F.col(order).isNotNull().alias("_some"), F.col(order).alias("_order")]
    leaves = rows.select(*kept, label.alias("_group"), *order_of, F.col("leaf").alias("_digest"))
    # Written first, so that texts are hashed once and ranges are drawn from digests.
    leaves = materialize(leaves, "digests")
    leaves = materialize(ranked(leaves, "_group", ["_some", "_order", "_digest"], "leaves"), "leaves")
    lower, tops = climb(leaves, fan, _most(leaves), "tree")
    groups = tops.select(F.lit("").alias("_all"), F.col("_group").alias("_name"), "_digest")
    groups = materialize(ranked(groups, "_all", ["_name"], "groups").withColumnRenamed("_all", "_group"), "groups")
    upper, top = climb(groups, fan, _most(groups), "top")
    root = top.select("_group", F.lit(0).cast("long").alias("_pos"), F.col("_digest").alias("root"))
    ways = descend(upper, root.withColumn("steps", F.array().cast(STEPS)))
    named = groups.select(F.col("_pos").alias("_at"), "_name", F.col("_digest").alias("subroot"))
    heads = ways.join(named, F.col("_pos") == F.col("_at")).select(
        F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_pos"), "steps", "subroot", "root"
    )
    found = descend(lower, heads).withColumnsRenamed({"_group": "_of", "_pos": "_place"})
    placed = leaves.withColumn("_in", F.floor(F.col("_pos") / fan ** levels(fan)))
    same = (F.col("_group") == F.col("_of")) & (F.col("_pos") == F.col("_place"))
    return placed.join(found, same).select(*kept, "subroot", "root", "steps")


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings on the way, level by level and left to right."""
    joined = F.transform(steps, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(joined, ""), 256)


def document_manifest(docs: DataFrame, fan: int = 3) -> DataFrame:
    """The manifest of a table of documents, checked against a tampered copy.

    A leaf covers ``doc_id, source, lang, n_chars, text``, each with its length, so
    NULL and empty differ. In the copy, texts of documents whose CRC-32 of the
    decimal doc_id is even have lost their line feeds; NULL texts, and documents
    without an id, are left as they are. Returns ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified``: the root that the copy's leaf leads to
    with the siblings on record, and whether it is the root. Other columns don't
    count. Repeated rows are leaves of their own.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    plain = [F.col(c) for c in names]
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    lost = even & F.contains("text", F.lit("\n"))
    tampered = F.when(lost, leaf_digest(*plain[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", leaf_digest(*plain).alias("leaf"), tampered.alias("tampered"))
    found = merkle_manifest(rows, "source", "doc_id", fan)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    made = found.withColumns({"proof_sha256": proof_digest(F.col("steps")), "folded_root": folded})
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
