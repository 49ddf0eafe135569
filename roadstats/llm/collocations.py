"""Collocations: phrases whose words come together more often than apart, for each language.

Level by level, as in Apriori: a phrase of k words can only be frequent if the two
phrases of k - 1 words in it are. The frequent phrases of a level form a
double-array trie over their bytes, which is broadcast. In a task, numpy holds a
trie state for every word of its texts and moves all of them on by one byte at a
time; accepting states are counted by ``bincount``, and Spark sums the tasks'
counts. Two accepted neighbours, one word apart, are a candidate of the next level;
tasks return only the numbers of the two phrases and how often they met.

A trie has at most ``trie_bytes`` bytes of phrases. Where a level has more, its
phrases in order make several tries, each a stretch of them. A task takes some texts
and opens the tries one after the other, so that one is in memory at a time, each
level reads the texts once and nothing is written between the tries. A word leaves a
trie at the first byte that no phrase of that stretch has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadstats.llm.common import materialize

_BLANK, _BREAK = 32, 10
#: Lower-cases A-Z; what ends a piece becomes a line feed, a tab a blank.
_TABLE = bytes(
    _BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else _BLANK if b == 9 else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
#: Bytes of text that numpy works on at a time; entries that a task holds before it returns them.
_SLICE, _HELD = 2 << 20, 1 << 20
#: Bytes of text that are moved through all tries of a level before the next ones are read.
_TAKEN = 16 << 20


@dataclass
class Trie:
    """A double array: the child of state s for byte b is at ``base[s] + b`` if ``check`` there is s.

    ``accept`` is a phrase's number at its last byte, else -1; ``roots`` the state
    after a language's name, where its phrases begin.
    """

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    roots: dict[str, int]
    n: int


def _packed(t: Trie) -> tuple:
    """A trie as a tuple, which needs no code to be read, with compressed arrays."""
    arrays = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (t.base, t.check, t.accept)]
    return len(t.base), *arrays, t.roots, t.n


def _opened(held: Broadcast) -> Trie:
    """A trie from its broadcast, which does not keep a copy in the worker."""
    size, *arrays, roots, n = held.value
    if getattr(held, "_path", None):
        del held._value
    return Trie(*(np.frombuffer(pa.decompress(x, 4 * size, "zstd", asbytes=True), np.int32) for x in arrays), roots, n)


def _place(byte: np.ndarray, first: np.ndarray, fan: np.ndarray, size: int, draw) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of all nodes and slots of all children, or None if ``size`` slots were too few.

    Nodes with many children go first; those with as many are placed together, at
    random, and drawn again where a slot was taken. A single child takes any free slot.
    """
    base, slot = np.zeros(len(fan), np.int64), np.zeros(len(byte), np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    for f in np.unique(fan)[::-1]:
        nodes = np.flatnonzero(fan == f)
        if f == 0:
            continue
        if f == 1:
            free = np.flatnonzero(~used)[: len(nodes)]
            if len(free) < len(nodes):
                return None
            slot[first[nodes]] = free
            base[nodes] = (free - byte[first[nodes]]) & (size - 1)
            continue
        for _ in range(200):
            if not len(nodes):
                break
            at = draw.integers(0, size, len(nodes))
            child = first[nodes][:, None] + np.arange(f)
            slots = (at[:, None] + byte[child]) & (size - 1)
            claims, owner = np.unique(slots, return_index=True)
            mine = np.zeros(slots.size, bool)
            mine[owner] = True
            fits = (mine.reshape(slots.shape) & ~used[slots]).all(1)
            used[slots[fits]] = True
            slot[child[fits]], base[nodes[fits]] = slots[fits], at[fits]
            nodes = nodes[~fits]
        if len(nodes):
            return None
    return base, slot


def build_trie(langs: list[str], phrases: list[str]) -> Trie:
    """A trie of ``phrases[i]`` of ``langs[i]``, accepted as i. No phrase holds a line feed."""
    keys = [f"{lang}\n{phrase}".encode() for lang, phrase in zip(langs, phrases, strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    flat = np.frombuffer(b"".join(keys[i] for i in order) + b"\0", np.uint8)
    lengths = np.array([len(keys[i]) for i in order], np.int64)
    starts = np.cumsum(lengths) - lengths
    # Nodes in order of depth, then of key: the children of a node are neighbours.
    parents, labels = [np.array([-1])], [np.array([0])]
    node, active, made = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    for depth in range(int(lengths.max(initial=0))):
        active = active[lengths[active] > depth]
        label = flat[starts[active] + depth].astype(np.int64)
        above = node[active]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (above[1:] != above[:-1]) | (label[1:] != label[:-1])
        parents.append(above[fresh])
        labels.append(label[fresh])
        node[active] = made + np.cumsum(fresh) - 1
        made += int(fresh.sum())
    parent, byte = np.concatenate(parents), np.concatenate(labels)
    fan = np.bincount(parent[1:], minlength=made)
    first = 1 + np.cumsum(fan) - fan
    draw, size, placed = np.random.default_rng(0), 1 << max(9, int(made * 1.6).bit_length()), None
    while (placed := _place(byte, first, fan, size, draw)) is None:
        size *= 2
    at, slot = placed
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = at
    check[slot[1:]] = slot[parent[1:]]
    accept[slot[node]] = order
    trie = Trie(base, check, accept, {}, len(keys))
    for lang in set(langs):
        state = 0
        for b in f"{lang}\n".encode():
            state = (int(base[state]) + b) & (size - 1)
        trie.roots[lang] = state
    return trie


def word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of bytes, the places where words start, and the text of each.

    Letters are lowered, a run of blanks is one blank, none follows a break, and a
    break ends every text.
    """
    none, line = (pa.scalar(x, pa.large_binary()) for x in (b"", b"\n"))
    joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_binary()), none, line)
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_TABLE), np.uint8)
    ends = (raw == _BLANK) | (raw == _BREAK)
    before = np.concatenate([[True], ends[:-1]])
    kept = ~((raw == _BLANK) & before)
    starts = np.flatnonzero(~ends & before)
    text = np.searchsorted(offsets[1:] - offsets[0], starts, "right")
    return raw[kept], (np.cumsum(kept) - 1)[starts], text


def accepted(stream: np.ndarray, starts: np.ndarray, state: np.ndarray, trie: Trie) -> np.ndarray:
    """The number of the phrase that starts at each word and ends with a word, or -1.

    ``state`` is where each word begins in the trie, -1 for nowhere. The phrases of
    a trie have as many words each, so that one at most is accepted.
    """
    found = np.full(len(starts), -1, np.int64)
    last = len(trie.base) - 1
    alive = np.flatnonzero(state >= 0)
    at, state = starts[alive], state[alive]
    while len(alive):
        child = (trie.base[state] + stream[at]) & last
        on = trie.check[child] == state
        alive, at, state = alive[on], at[on] + 1, child[on]
        number, follows = trie.accept[state], stream[at]
        ended = (number >= 0) & ((follows == _BLANK) | (follows == _BREAK))
        found[alive[ended]] = number[ended]
    return found


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about ``_SLICE`` bytes of text; a longer text is one of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    step = np.concatenate([[0], (np.cumsum(sizes, dtype=np.int64) - sizes) // _SLICE])[1:]
    bounds = [*np.flatnonzero(np.diff(step, prepend=-1)), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(a, b - a)


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, phrase, n``: how often each word occurs (``texts``: ``lang, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: dict[str, Counter]) -> pa.RecordBatch:
            langs = [lang for lang, c in held.items() for _ in c]
            words = [w.decode() for c in held.values() for w in c]
            n = [n for c in held.values() for n in c.values()]
            names = ["lang", "phrase", "n"]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=names)

        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(text.encode().translate(_TABLE).split())
                if sum(map(len, held.values())) > _HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    counted = texts.mapInArrow(run, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def pass_texts(texts: DataFrame, tries: list[Broadcast], firsts: list[int], pairs: bool) -> DataFrame:
    """Move all words of ``texts`` through ``tries`` (:func:`_packed`), whose phrases have the numbers from ``firsts`` on.

    ``firsts`` ends with the number of all phrases. Returns ``a, b, n``, how often phrase
    ``a`` occurs (``b`` is -1) and, with ``pairs``, how often ``b`` starts at the second word
    of ``a``.
    """
    total = firsts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _opened(tries[0]) if len(tries) == 1 else None
        most = 1 if only else _TAKEN
        whole = np.zeros(only.n if only else 0, np.int64)
        keys, sums = [], []

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # A key is a * (total + 1) + b + 1.
            a, b = np.divmod(key, total + 1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b - 1), pa.array(n)], names=["a", "b", "n"])

        def taken() -> Iterator[list]:
            """Some texts: bytes, places of words, language of each word, the phrase found at it."""
            parts, size = [], 0
            for batch in batches:
                for part in _slices(batch):
                    stream, starts, text = word_starts(part.column("text"))
                    lang = part.column("lang").dictionary_encode()
                    names = lang.dictionary.to_pylist()
                    parts.append((stream, starts, names, lang.indices.to_numpy()[text], np.full(len(starts), -1, np.int64)))
                    size += len(stream)
                    if size >= most:
                        yield parts
                        parts, size = [], 0
            if parts:
                yield parts

        for parts in taken():
            for trie, first in zip(tries, firsts, strict=False):
                now = only or _opened(trie)
                counts = whole if only else np.zeros(now.n, np.int64)
                for stream, starts, names, lang, found in parts:
                    root = np.array([now.roots.get(x, -1) for x in names], np.int64)
                    here = accepted(stream, starts, root[lang], now)
                    hit = here >= 0
                    counts += np.bincount(here[hit], minlength=now.n)
                    found[hit] = here[hit] + first
                if not only:
                    own = np.flatnonzero(counts)
                    keys.append((own + first) * (total + 1))
                    sums.append(counts[own])
            for stream, starts, _, _, found in parts:
                if pairs and len(starts) > 1:
                    near = (found[:-1] >= 0) & (found[1:] >= 0) & (stream[starts[1:] - 1] == _BLANK)
                    key, n = np.unique(found[:-1][near] * (total + 1) + found[1:][near] + 1, return_counts=True)
                    keys.append(key)
                    sums.append(n)
            if sum(map(len, keys)) > _HELD:
                key, n = _merged(keys, sums)
                keys, sums = [key], [n]
                if len(key) > _HELD // 2:
                    yield rows(key, n)
                    keys, sums = [], []
        own = np.flatnonzero(whole)
        yield rows(own * (total + 1), whole[own])
        if keys:
            yield rows(*_merged(keys, sums))

    return texts.mapInArrow(run, "a long, b long, n long")


def _numbered(phrases: DataFrame, trie_bytes: int, name: str) -> tuple[DataFrame, list[int]]:
    """``phrases`` (``lang, phrase``) written with ``number`` in their order, and the first number of each trie and the end.

    A trie holds ``trie_bytes`` or less, or one phrase more.
    """
    order = Window.partitionBy("range").orderBy("lang", "phrase")
    dealt = phrases.select("lang", "phrase").orderBy("lang", "phrase").withColumn("range", F.spark_partition_id())
    size = F.sum(F.octet_length("lang") + F.octet_length("phrase"))
    dealt = dealt.withColumns({"place": F.row_number().over(order).cast("long") - 1, "upto": size.over(order)})
    dealt = materialize(dealt, name)
    # One row for each range of the sort.
    sums = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("size")).orderBy("range").collect()
    sums = {r["range"]: (r["n"], r["size"]) for r in sums}
    rows, sizes = [0], [0]
    for i in range(max(sums, default=-1) + 1):
        n, size = sums.get(i, (0, 0))
        rows.append(rows[-1] + n)
        sizes.append(sizes[-1] + size)

    def at(values: list[int]) -> Column:
        return F.element_at(F.split(F.lit(" ".join(map(str, values))), " "), F.col("range") + 1).cast("long")

    ends = at(sizes) + F.col("upto")
    numbered = dealt.select("lang", "phrase", (F.col("place") + at(rows)).alias("number"), ends.alias("upto"))
    # One row for each trie.
    trie = F.floor((F.col("upto") - 1) / trie_bytes)
    firsts = numbered.groupBy(trie.alias("t")).agg(F.min("number").alias("first")).orderBy("first").collect()
    return numbered.select("lang", "phrase", "number"), [*(r["first"] for r in firsts), rows[-1]]


def _level(texts: DataFrame, phrases: DataFrame, least: int, pairs: bool, trie_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Counts (``lang, phrase, n``) of ``phrases``, and the candidates (``lang, phrase``) one word longer."""
    numbered, firsts = _numbered(phrases, trie_bytes, "phrases")

    def held(first: int, end: int) -> Broadcast:
        # A trie's phrases are bounded by ``trie_bytes``; the driver holds those of one.
        own = numbered.filter((F.col("number") >= first) & (F.col("number") < end)).orderBy("number").toPandas()
        return texts.sparkSession.sparkContext.broadcast(_packed(build_trie(list(own["lang"]), list(own["phrase"]))))

    tries = [held(first, end) for first, end in zip(firsts, firsts[1:], strict=False)]
    if not tries:
        met = texts.sparkSession.createDataFrame([], "a long, b long, n long")
    else:
        met = pass_texts(texts, tries, firsts, pairs).groupBy("a", "b").agg(F.sum("n").alias("n"))
    met = materialize(met.filter(F.col("n") >= least), "met")
    for trie in tries:
        trie.destroy()
    counted = met.filter("b < 0").join(numbered, F.col("a") == F.col("number")).select("lang", "phrase", "n")
    if not pairs:
        return counted, None
    start = numbered.select(F.col("number").alias("_a"), "lang", F.col("phrase").alias("_start"))
    end = numbered.select(F.col("number").alias("_b"), F.substring_index("phrase", " ", -1).alias("_end"))
    longer = met.filter("b >= 0").join(start, F.col("a") == F.col("_a")).join(end, F.col("b") == F.col("_b"))
    return counted, longer.select("lang", F.concat_ws(" ", "_start", "_end").alias("phrase"))


def phrase_counts(texts: DataFrame, least: int = 30, longest: int = 4, trie_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """All words (``lang, phrase, n``), and all phrases up to ``longest`` words that occur ``least`` times (``lang, words, phrase, n``)."""
    words = materialize(count_words(texts), "words")
    phrases, levels = words.filter(F.col("n") >= least).select("lang", "phrase"), []
    for k in range(1, longest + 1):
        counted, longer = _level(texts, phrases, least, k < longest, trie_bytes)
        levels.append(counted.select("lang", F.lit(k).alias("words"), "phrase", "n"))
        if longer is None:
            break
        phrases = materialize(longer, "longer")
    found = levels[0]
    for counted in levels[1:]:
        found = found.unionByName(counted)
    return words, materialize(found, "counts")


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, trie_bytes: int = 4 << 20) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` have ``lang`` (NULL: ``und``) and ``text`` (NULL: empty); other columns
    don't count, repeated rows do. A-Z are lowered; ``.,;:!?`` and line ends cut a text
    into pieces, blanks and tabs a piece into words. ``n`` counts all words of the
    language, ``a`` the phrase within pieces, overlaps included. Of all cuts into two
    parts, which occur ``l`` and ``r`` times, the one with the lowest score
    ``floor(2000000 a / (l + r))`` counts, the first of equal ones. A phrase inside a
    longer candidate that occurs at least 0.8 times as often is dropped. Ranks go by
    score, then by ``a``, both descending, then by phrase in order of bytes. Tables
    without a frequent phrase give no rows.
    """
    lang = F.coalesce(F.col("lang"), F.lit("und")).alias("lang")
    words, found = phrase_counts(docs.select(lang, "text"), least, longest, trie_bytes)
    total = words.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("total"))
    found = found.withColumn("w", F.split("phrase", " "))
    candidates = found.filter("words > 1")
    cuts = candidates.select("lang", "phrase", "w", "words", "n", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns(
        {
            "first": _joined(F.col("w"), F.lit(1), F.col("k")),
            "rest": _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")),
        }
    )
    one = found.select(F.col("lang").alias("_1"), F.col("phrase").alias("first"), F.col("n").alias("l"))
    two = found.select(F.col("lang").alias("_2"), F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(one, (F.col("lang") == F.col("_1")) & (cuts["first"] == one["first"]))
    cuts = cuts.join(two, (F.col("lang") == F.col("_2")) & (cuts["rest"] == two["rest"]))
    # Decimals, since the product may pass 64 bits; ``div`` of decimals is exact.
    score = F.expr("cast(n AS decimal(25,0)) * cast(2000000 AS decimal(7,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", F.col("n").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    inner = candidates.filter("words > 2").select(
        F.col("lang").alias("_l"),
        "n",
        F.explode(
            F.expr(
                "array_distinct(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' ')))))"
            )
        ).alias("_p"),
    )
    inside = inner.groupBy("_l", "_p").agg(F.max("n").alias("_most"))
    covered = (F.col("_l") == F.col("lang")) & (F.col("_p") == F.col("phrase"))
    covered = covered & F.expr("cast(_most AS decimal(25,0)) * 100 >= cast(a AS decimal(25,0)) * 80")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    kept = best.join(inside, covered, "left_anti").select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    # The first of each of 256 parts of a language, then the first of those: no task gets a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    first = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    kept = kept.withColumn("_first", first).filter(F.col("_first") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = kept.withColumn("rank", place).filter(F.col("rank") <= top)
    ranked = ranked.join(total, F.col("lang") == F.col("_l"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
