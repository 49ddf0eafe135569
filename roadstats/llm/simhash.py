"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distance, components.

Equal fingerprints are collapsed first, so copies cost one fingerprint whatever
their number. Fingerprints at most ``max_bits`` apart agree in all but
``max_bits`` of m blocks of bits; each is therefore listed once for every choice
of m - ``max_bits`` blocks, under those blocks' bits. m grows with the number
of fingerprints, so that a list stays short by chance; every m finds all pairs.
Lists are swept in sorted order and a task returns, of the links it verifies,
a spanning forest and not all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import materialize, without
from roadstats.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of ``words`` words; 0 if there is no word.

    Only A-Z are lowered. A bit is 1 if more than half of the shingles' hashes,
    repeats included, have it.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)),
        np.uint64,
        n,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without its text and with ``fp`` (the 64 bits as a signed long)."""
    rest = without(docs, "text", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), words, seed) for t in batch.column("text")), np.uint64, batch.num_rows
            )
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*rest, "fp"])

    schema = docs.select(*rest).schema.add("fp", "long")
    return docs.select(*rest, "text").mapInArrow(run, schema)


def _blocks(n: int, max_bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Borders of the blocks of bits, and the choices of blocks that are compared.

    The fewest blocks whose chosen bits outnumber log2(n) by three.
    """
    for m in range(max_bits + 1, BITS + 1):
        kept = m - max_bits
        if kept * (BITS // m) >= math.log2(max(2, n)) + 3 or math.comb(m + 1, max_bits) > 200:
            break
    borders = [round(i * BITS / m) for i in range(m + 1)]
    return borders, list(itertools.combinations(range(m), kept))


def _masks(borders: list[int], choices: list[tuple[int, ...]]) -> list[int]:
    width = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(borders)]
    return [sum(width[i] for i in choice) for choice in choices]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i] for all i; labels point at the smallest member."""
    while len(a):
        ra, rb = label[a], label[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label[:] = label[label]


def link_lists(table: np.ndarray, key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) that span the classes of near fingerprints in each list.

    Short lists are swept: every entry is compared with the one k places on, for
    growing k. In a list longer than its number of neighbours within
    ``max_bits`` of the bits outside the key, neighbours are looked up instead,
    which takes time in proportion to the list.
    """
    order = np.lexsort((fp, key, table))
    table, key, fp = table[order], key[order], fp[order]
    new = np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])] if len(fp) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(fp)])
    label = np.arange(len(fp))
    # A list that shares w bits has sum C(64 - w, <= max_bits) neighbours a member; 2**13 is
    # that number for about 37 free bits.
    long_ = length > 1 << 13
    for a, n in zip(start[long_], length[long_], strict=True):
        own = fp[a : a + n]
        free = [i for i in range(BITS) if len(np.unique((own >> np.uint64(i)) & np.uint64(1))) > 1]
        for size in range(1, max_bits + 1):
            for bits in itertools.combinations(free, size):
                other = own ^ np.uint64(sum(1 << i for i in bits))
                at = np.minimum(np.searchsorted(own, other), n - 1)
                hit = np.flatnonzero(own[at] == other)
                _merge(label, a + hit, a + at[hit])
    end = np.repeat(start + length, length)
    alive = np.flatnonzero(np.repeat(~long_, length))
    step = 1
    while len(alive := alive[alive + step < end[alive]]):
        near = np.bitwise_count(fp[alive] ^ fp[alive + step]) <= max_bits
        _merge(label, alive[near], alive[near] + step)
        step += 1
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[moved]], fp[moved]


def near_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``) that span all near classes."""
    n = prints.count()
    borders, choices = _blocks(n, max_bits)
    masks = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in _masks(borders, choices)]
    lists = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
            for i, m in enumerate(masks)
        ]
    )
    listed = prints.select("fp", F.inline(lists))
    pieces = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # About 2**18 entries meet in one call, whole lists at a time.
    pieces = max(pieces, -(-n * len(masks) // (1 << 18)))
    piece = F.pmod(F.xxhash64("choice", "key"), F.lit(pieces)).alias("piece")

    def link(group: pa.Table) -> pa.Table:
        found = [group.column(c).to_numpy() for c in ("choice", "key", "fp")]
        a, b = link_lists(found[0], found[1], found[2].view(np.uint64), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return listed.select(piece, "choice", "key", "fp").groupBy("piece").applyInArrow(link, "a long, b long")


def simhash_components(
    docs: DataFrame, words: int = 3, max_bits: int = 3, seed: int = 42
) -> DataFrame:
    """``docs`` without text, with ``fingerprint`` and ``root`` (16 hex digits) and ``component_id``.

    The component is the smallest doc_id that can be reached over links of at
    most ``max_bits`` differing bits; ``root`` is the same for all rows of a
    component and for no others. NULL and empty texts have fingerprint zero
    and link like any other; a NULL doc_id never names a component unless all of
    it are NULL. Repeated rows and equal doc_ids stay separate rows. An empty
    table gives an empty result. Other columns pass through.
    """
    rows = materialize(fingerprints(docs, words, seed), "fingerprints")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    classes = connected_components(near_links(own.select("fp"), max_bits))
    rooted = own.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    clash = without(rows, "fp", "fingerprint", "root", "component_id")

    def digits(c: str) -> Column:
        return F.lower(F.lpad(F.hex(c), 16, "0")).alias("fingerprint" if c == "fp" else c)

    kept = rows.select("fp", *clash)
    return kept.join(named, "fp").select(*clash, digits("fp"), digits("root"), "component_id")
