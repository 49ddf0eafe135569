"""Removal of repeated passages with a difference-cover suffix sort.

A byte is removed if it lies in a string of ``min_bytes`` bytes that also starts
in a document with a smaller doc_id. Four distributed steps find these strings:

1. Documents are dealt to blocks. Each window of ``min_bytes`` bytes has an
   anchor, the smallest hash among its ``gram``-byte strings, so equal windows
   have equal anchors wherever they stand. Blocks send their distinct anchors,
   each at most twice.
2. Anchors that occur in one document only cannot belong to a repeated window
   and are left out. The rest go back to the blocks they came from.
3. A run of windows with one such anchor is a region. A block sends each
   distinct region once, with the smallest doc_id that has it, to the part its
   anchor is dealt to: all suffixes that could share ``min_bytes`` bytes meet
   there. Regions of an anchor that very many documents have are cut into single
   windows, which are dealt by their own bytes, so that no anchor fills a task.
4. Each part leaves out the windows whose hash no other of its windows has, sorts
   the suffixes of the rest by the difference-cover algorithm (sort sampled
   triples, recurse on their names, merge the other suffixes) as far as
   ``min_bytes`` bytes, compares adjacent prefixes, and takes the smallest
   doc_id of every run of equal ones. The covered stretches go back to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import parts, text_bytes

WORD = 8
_NULL_ID = np.iinfo(np.int64).max
#: More documents than this (as counted over blocks) make an anchor's regions single windows.
HOT = 2000


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of every row among the distinct rows, from 1, in lexicographic order.

    Columns of small numbers are packed into one integer, so that one sort does
    for several of them.
    """
    key, room = None, 0
    for c in columns:
        bits = max(1, int(c.max()).bit_length()) if len(c) else 1
        if key is not None and room + bits > 64:
            key = _dense(key).astype(np.uint64)
            room = max(1, int(key.max()).bit_length())
            if room + bits > 64:
                c = _dense(c)
                bits = max(1, int(c.max()).bit_length())
        key = c.astype(np.uint64) if key is None else key << np.uint64(bits) | c.astype(np.uint64)
        room += bits
    return _dense(key)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    held = key[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def difference_cover_ranks(symbol: np.ndarray, need: np.ndarray, stride: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the positions marked in ``need``; other positions have 0.

    ``symbol[i]`` is an order-preserving name of the ``stride`` units from i on.
    The order of suffixes that differ within the first ``depth`` units is that of
    the suffixes; others stand next to each other. Positions i with
    (i // stride) % 3 of 1 or 2 form the cover. Only cover positions that a
    wanted suffix is compared by are sorted.
    """
    n = len(symbol)
    rank = np.zeros(n + 2 * stride, np.int64)  # zero beyond the end
    if not need.any():
        return rank[:n]
    turn = np.resize(np.repeat(np.arange(3, dtype=np.uint8), stride), n)

    def ahead(mask: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, bool)
        if by < n:
            out[by:] = mask[: n - by]
        return out

    zero, one, two = (np.flatnonzero(need & (turn == t)) for t in range(3))
    cover = need & (turn > 0)
    if len(zero):
        # Class 0 is compared with class 1 by one stride, and with class 2 by two.
        cover |= ahead(need & (turn < 2), stride)
        if len(two):
            cover |= ahead(need & (turn != 1), 2 * stride)
    # Positions whose triples are named: the cover and, if the names recur, their successors.
    span = 3 * stride
    named = cover
    for far in range(span, depth, span):
        named = named | ahead(cover, far)
    at = np.flatnonzero(named & (turn > 0))
    wide = np.concatenate([symbol, np.zeros(2 * stride, symbol.dtype)])
    name = np.zeros(n, np.int64)
    name[at] = _names([wide[at], wide[at + stride], wide[at + 2 * stride]])
    if span < depth:
        name = difference_cover_ranks(name, cover, span, depth)
    held = np.flatnonzero(cover)
    rank[held] = name[held]
    if not len(zero):
        return rank[:n]
    # The suffixes outside the cover are sorted by their symbol and the rank one stride on.
    own = _names([wide[zero], rank[zero + stride]])
    out = np.zeros(n, np.int64)
    if not len(one) and not len(two):
        out[zero] = own
        return out
    # Merge: how many wanted cover suffixes of each class precede each of the others.
    before = np.zeros(len(zero), np.int64)
    for other, columns in (
        (one, lambda i: (wide[i], rank[i + stride])),
        (two, lambda i: (wide[i], wide[i + stride], rank[i + 2 * stride])),
    ):
        if len(other):
            both = _names([np.concatenate(c) for c in zip(columns(zero), columns(other), strict=True)])
            before += np.searchsorted(np.sort(both[len(zero) :]), both[: len(zero)])
    # A suffix outside the cover comes behind as many cover suffixes, these in their own order.
    inside = np.concatenate([one, two])
    inside = inside[np.argsort(rank[inside], kind="stable")]
    level = np.concatenate([2 * before, 2 * np.arange(len(inside)) + 1])
    order = np.lexsort((np.concatenate([own, np.zeros(len(inside), np.int64)]), level))
    out[np.concatenate([zero, inside])[order]] = np.arange(1, len(order) + 1)
    return out


def window_order(text: np.ndarray, starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and whether each shares ``min_bytes`` bytes with the one before.

    ``text`` must reach ``min_bytes`` beyond every start.
    """
    n = len(text)
    word = np.concatenate([text, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):  # the eight bytes from each position on, the first one highest
        word = word << np.uint64(8 * size) | np.concatenate([word[size:], np.zeros(size, np.uint64)])
    word = word[:n]
    need = np.zeros(n, bool)
    need[starts] = True
    rank = difference_cover_ranks(word, need, WORD, min_bytes)
    order = starts[np.argsort(rank[starts])]
    same = np.ones(len(order), bool)
    same[:1] = False
    a, b = order[1:], order[:-1]
    whole, over = divmod(min_bytes, WORD)
    for k in range(whole):
        same[1:] &= word[a + k * WORD] == word[b + k * WORD]
    if over:
        last = min_bytes - WORD if whole else 0
        mask = ~np.uint64(0) if whole else ~np.uint64(0) << np.uint64(8 * (WORD - over))
        same[1:] &= (word[a + last] ^ word[b + last]) & mask == 0
    return order, same


def _repeats(values: np.ndarray) -> np.ndarray:
    """Which of ``values`` occur more than once."""
    order = np.argsort(values)
    held = values[order]
    like = held[1:] == held[:-1]
    out = np.zeros(len(values), bool)
    out[order[1:]] = like
    out[order[:-1]] |= like
    return out


#: Positions hashed at a time, so that the passes over them stay in a core's cache.
_STEP = 1 << 16


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on, by doubling."""
    h = text.astype(np.uint64)
    h += np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    size, base = 1, 0xD6E8FEB86659FD93
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * np.uint64(base) + h[step:] if step < len(h) else h[:0]
        h ^= h >> np.uint64(29)
        size, base = size + step, (base * base + 2) & ((1 << 64) - 1)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    return h


def _least_hashes(text: np.ndarray, gram: int, window: int) -> np.ndarray:
    """The smallest gram hash inside each window of ``window`` bytes."""
    n = len(text) - window + 1
    out = np.empty(max(n, 0), np.uint64)
    for at in range(0, n, _STEP):
        least = _gram_hashes(text[at : at + _STEP + window - 1], gram)
        width, size = window - gram + 1, 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        out[at : at + _STEP] = least[: n - at]
    return out


class Block:
    """The documents of one block as one text, and the windows that lie inside a document."""

    def __init__(self, ids: list, texts: list, min_bytes: int, gram: int):
        rows = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.rows = rows
        raw = [(texts[i] or "").encode() for i in rows]
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(self.lengths)
        self.ids = np.array([_NULL_ID if ids[i] is None else ids[i] for i in rows], np.int64)
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        self.min_bytes, self.gram = min_bytes, gram

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor in one document: anchor, first, last + 1, row."""
        n = len(self.text) - self.min_bytes + 1
        if n <= 0:
            empty = np.zeros(0, np.int64)
            return empty.astype(np.uint64), empty, empty, empty
        least = _least_hashes(self.text, self.gram, self.min_bytes)
        doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        inside = doc[:n] == doc[self.min_bytes - 1 :]
        new = np.ones(n, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[1:] |= doc[1:n] != doc[: n - 1]
        new[1:] |= ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.r_[new[1:] | ~inside[1:], True] & inside) + 1
        # A run that goes on and on, in a text that repeats itself, is cut; its windows keep their anchor.
        most = 4 * self.min_bytes
        pieces = -(-(stop - first) // most)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(first, pieces) + nth * most
        return least[start], start, np.minimum(start + most, np.repeat(stop, pieces)), doc[start]


def _block(table: pa.Table, min_bytes: int, gram: int) -> Block:
    return Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), min_bytes, gram)


def _sliced(kind: np.dtype, raw: pa.ChunkedArray | list) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in (raw.to_pylist() if not isinstance(raw, list) else raw)]


def _by_part(anchor: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each anchor, and the rows' order by part."""
    part = (anchor >> np.uint64(32)) % np.uint64(n_parts)
    return part, np.argsort(part, kind="stable")


def covered_stretches(docs: DataFrame, n_parts: int, min_bytes: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` dealt to blocks (``block``), and per block the covered ``spans`` of its text."""
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int"))

    def send_anchors(table: pa.Table) -> pa.Table:
        block = _block(table, min_bytes, gram)
        anchor, _, _, row = block.anchors()
        # How many documents of this block have each anchor.
        order = np.lexsort((row, anchor))
        anchor, row = anchor[order], row[order]
        other = np.ones(len(anchor), bool)
        other[1:] = anchor[1:] != anchor[:-1]
        heads = np.flatnonzero(other)
        other[1:] |= row[1:] != row[:-1]
        found = anchor[heads]
        count = np.add.reduceat(other.astype(np.int64), heads) if len(heads) else heads
        part, order = _by_part(found, n_parts)
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=np.uint64))
        short, many = found.astype(np.uint32)[order], np.minimum(count, 65535).astype(np.uint16)[order]
        full = [p for p in range(n_parts) if cuts[p + 1] > cuts[p]]
        me = table.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array(full, pa.int32()),
                "block": pa.array([me] * len(full), pa.int32()),
                "anchors": pa.array([short[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
                "counts": pa.array([many[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()),
            }
        )

    def repeated(table: pa.Table) -> pa.Table:
        anchors, counts = _sliced(np.uint32, table.column("anchors")), _sliced(np.uint16, table.column("counts"))
        every = np.concatenate(anchors)
        value, where = np.unique(every, return_inverse=True)
        docs_with = np.bincount(where, weights=np.concatenate(counts))
        shared, hot = docs_with > 1, docs_with > HOT
        at = np.cumsum([0, *map(len, anchors)])
        kept = [where[a:b] for a, b in zip(at, at[1:], strict=False)]
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "anchors": pa.array([value[k[shared[k]]].tobytes() for k in kept], pa.binary()),
                "hot": pa.array([np.packbits(hot[k[shared[k]]]).tobytes() for k in kept], pa.binary()),
            }
        )

    def send_regions(docs_: pa.Table, anchors_: pa.Table) -> pa.Table:
        names = ("part", "block", "text", "sizes", "least", "uses", "starts", "ids")
        if not docs_.num_rows or not anchors_.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n in names[:2] else pa.binary()) for n in names})
        block = _block(docs_, min_bytes, gram)
        anchor, first, stop, row = block.anchors()
        part, _ = _by_part(anchor, n_parts)
        key = part << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))
        parts_ = anchors_.column("part").to_pylist()
        lists = _sliced(np.uint32, anchors_.column("anchors"))
        known = np.concatenate([x.astype(np.uint64) | np.uint64(p) << np.uint64(32) for p, x in zip(parts_, lists, strict=True)])
        hot = np.concatenate(
            [np.unpackbits(h, count=len(x)).astype(bool) for h, x in zip(_sliced(np.uint8, anchors_.column("hot")), lists, strict=True)]
        )
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1) if len(known) else np.zeros(len(key), int)
        keep = known[at] == key if len(known) else np.zeros(len(key), bool)
        first, stop, row, part, is_hot = first[keep], stop[keep], row[keep], part[keep], hot[at[keep]]
        # Hot regions become single windows, dealt by a hash of all their bytes.
        n = (stop - first)[is_hot]
        begin = np.repeat(first[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(begin):
            windows = _gram_hashes(block.text, min_bytes)
            first = np.r_[first[~is_hot], begin]
            stop = np.r_[stop[~is_hot], begin + 1]
            row = np.r_[row[~is_hot], np.repeat(row[is_hot], n)]
            part = np.r_[part[~is_hot], _by_part(windows[begin], n_parts)[0]]
        # Equal regions are sent once, with all the places where they stand in this block.
        raw = block.text.tobytes()
        groups: dict[tuple[int, bytes], list[int]] = {}
        tail = min_bytes - 1
        for i, (p, a, b) in enumerate(zip(part.tolist(), first.tolist(), stop.tolist(), strict=True)):
            groups.setdefault((p, raw[a : b + tail]), []).append(i)
        by_part: dict[int, list[tuple[bytes, list[int]]]] = {}
        for (p, region), found in groups.items():
            by_part.setdefault(p, []).append((region, found))
        me = docs_.column("block")[0].as_py()
        out: dict[str, list] = {name: [] for name in names}
        ids = block.ids[row]
        for p, held in by_part.items():
            every = np.array([i for _, found in held for i in found], np.int64)
            uses = np.array([len(found) for _, found in held], np.uint32)
            heads = np.r_[0, np.cumsum(uses[:-1], dtype=np.int64)]
            out["part"].append(p)
            out["block"].append(me)
            # Text is most of what is shuffled here; this halves what Spark's own codec leaves.
            out["text"].append(pa.compress(b"".join(region for region, _ in held), "zstd", asbytes=True))
            out["sizes"].append(np.array([len(region) for region, _ in held], np.uint32).tobytes())
            out["least"].append(np.minimum.reduceat(ids[every], heads).tobytes())
            out["uses"].append(uses.tobytes())
            out["starts"].append(first[every].astype(np.uint32).tobytes())
            out["ids"].append(ids[every].tobytes())
        return pa.table({n: pa.array(out[n], pa.int32() if n in names[:2] else pa.binary()) for n in names})

    def sort_part(table: pa.Table) -> pa.Table:
        texts, sizes = table.column("text").to_pylist(), _sliced(np.uint32, table.column("sizes"))
        least, uses = _sliced(np.int64, table.column("least")), _sliced(np.uint32, table.column("uses"))
        # Regions that several blocks sent are sorted once.
        index: dict[bytes, int] = {}
        distinct: list[bytes] = []
        which = []
        for packed, size in zip(texts, sizes, strict=True):
            ends = np.cumsum(size, dtype=np.int64).tolist()
            text = pa.decompress(packed, ends[-1], "zstd", asbytes=True)
            own = np.empty(len(ends), np.int64)
            for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                region = text[a:b]
                found = index.setdefault(region, len(distinct))
                if found == len(distinct):
                    distinct.append(region)
                own[i] = found
            which.append(own)
        smallest = np.full(len(distinct), _NULL_ID)
        np.minimum.at(smallest, np.concatenate(which), np.concatenate(least))
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ends = np.cumsum(length)
        windows = length - min_bytes + 1
        region = np.repeat(np.arange(len(distinct)), windows)
        nth = np.arange(len(region)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = (ends - length)[region] + nth
        text = np.frombuffer(b"".join(distinct), np.uint8)
        # A window whose hash no other has is like none; only the others are sorted.
        again = np.flatnonzero(_repeats(_gram_hashes(text, min_bytes)[begin]))
        owner = smallest[region]
        if len(again):
            order, same = window_order(text, begin[again], min_bytes)
            at = again[np.searchsorted(begin[again], order)]
            heads = np.flatnonzero(~same)
            owner[at] = np.repeat(np.minimum.reduceat(owner[at], heads), np.diff(np.r_[heads, len(at)]))
        # Stretches of windows of a region that have one owner: region, first, last + 1, owner.
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (nth[1:] == 0)
        head = np.flatnonzero(cut)
        tail = np.r_[head[1:], len(owner)]
        s_first, s_last, s_owner = nth[head], nth[tail - 1] + 1, owner[head]
        per = np.bincount(region[head], minlength=len(distinct))
        s_at = np.cumsum(per) - per
        spans = []
        starts, ids = _sliced(np.uint32, table.column("starts")), _sliced(np.int64, table.column("ids"))
        for own, use, start, doc in zip(which, uses, starts, ids, strict=True):
            place = np.repeat(own, use)
            n = per[place]
            use_row = np.repeat(np.arange(len(place)), n)
            s = np.repeat(s_at[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = s_owner[s] < doc[use_row]
            base = start[use_row[hit]].astype(np.int64)
            spans.append(np.stack([base + s_first[s[hit]], base + s_last[s[hit]] + min_bytes - 1], 1))
        return pa.table(
            {
                "block": table.column("block"),
                "spans": pa.array([x.astype(np.uint32).tobytes() for x in spans], pa.binary()),
            }
        )

    by_block = blocked.groupBy("block")
    anchors = by_block.applyInArrow(send_anchors, "part int, block int, anchors binary, counts binary")
    shared = anchors.groupBy("part").applyInArrow(repeated, "block int, part int, anchors binary, hot binary")
    region_schema = (
        "part int, block int, text binary, sizes binary, least binary, uses binary,"
        " starts binary, ids binary"
    )
    regions = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_regions, region_schema)
    return blocked, regions.groupBy("part").applyInArrow(sort_part, "block int, spans binary")


def suffix_dedup(
    docs: DataFrame,
    min_bytes: int = 50,
    gram: int = 24,
    block_bytes: int = 4 << 20,
    with_text: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    ``with_text`` adds ``kept_text``: the remaining bytes, without characters
    that a cut left incomplete. Other columns are passed on if named in ``keep``.
    A NULL text counts as empty. A NULL doc_id counts as larger than all others.
    Rows with equal doc_ids remove nothing from each other. Texts shorter than
    ``min_bytes`` are left as they are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n_parts = parts(spark, text_bytes(docs), block_bytes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    blocked, spans = covered_stretches(plain, n_parts, min_bytes, gram)
    counts = ("n_bytes", "n_removed", "n_spans")

    def cut(docs_: pa.Table, spans_: pa.Table) -> pa.Table:
        block = _block(docs_, min_bytes, gram)
        sent = spans_.column("spans").to_pylist() if spans_.num_rows else []
        a, b = np.frombuffer(b"".join(sent), np.uint32).reshape(-1, 2).T
        edge = np.bincount(a, minlength=len(block.text) + 1) - np.bincount(b, minlength=len(block.text) + 1)
        gone = np.cumsum(edge[:-1]) > 0
        numbers, kept = {c: [] for c in counts}, []
        for end, n in zip(block.ends.tolist(), block.lengths.tolist(), strict=True):
            mask, text = gone[end - n : end], block.text[end - n : end]
            kept.append(text[~mask].tobytes())
            numbers["n_bytes"].append(n)
            numbers["n_removed"].append(n - len(kept[-1]))
            numbers["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
        rows = pa.array(block.rows, pa.int64())
        out = {"doc_id": docs_.column("doc_id").take(rows)}
        out |= {c: pa.array(numbers[c], pa.int64()) for c in counts}
        out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        if with_text:
            out["kept_text"] = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
        return pa.table(out | {c: docs_.column(c).take(rows) for c in keep})

    schema = plain.select("doc_id").schema
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    for c in keep:
        schema = schema.add(plain.schema[c])
    return blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)
