"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents become pieces of at most ``length`` tokens. Piece sizes are whole
numbers up to ``length``, so the range-sorted pieces and the range-sorted gaps
are two tables of at most ``length`` counted classes each, however many
documents there are. The bulk-synchronous rounds run on these counts: every gap
class proposes to its best fit, the largest piece class that is not larger than
it (its predecessor in the sorted order); gaps that want the same class are
served by rank, tightest first; the filled gaps shrink, and the next round
begins. A round in which no gap finds a piece opens sequences for the largest
class. The rounds yield intervals "ranks r..s of size x go to sequences q.. at
offset o"; each piece then finds its place by its rank among pieces of its size,
which is computed by distributed prefix sums.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadstats.llm.common import materialize, process_cache, without

#: White space at either end of a word, or no word.
_EDGE = (
    "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
_UNFIT = f"^{_EDGE}|{_EDGE}$|^$"
#: Bytes of text that are tokenized at a time.
_BATCH = 16 << 20
#: Pieces of one size that are ranked in one window, about.
_WINDOW_ROWS = 200_000


class Ids:
    """Token ids of texts as little-endian 32-bit integers.

    ``path`` is a file of the ``tokenizers`` library, or of ``tiktoken`` ranks
    with the ``pattern`` that cuts texts. Both give the same ids for the same
    vocabulary; the second is several times as fast. With ranks, texts are cut
    at blanks: no token crosses a blank between two characters that are no white
    space, so each distinct "blank and word" of a batch is tokenized once. Texts
    in which white space meets a blank are tokenized as a whole.
    """

    def __init__(self, path: str, pattern: str | None):
        self.exact = None
        if pattern is None:
            self.exact = Tokenizer.from_file(path)
            self.exact.encode_special_tokens = True
            return
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and each word, one after the other, and how many each has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        found = np.array(self.encoding.encode_ordinary(joined), "<u4")
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        token_ends = np.cumsum(self.sizes[found])
        last = np.searchsorted(token_ends, ends) + 1
        if (token_ends[last - 1] != ends).any():
            raise ValueError("the pattern does not cut texts at blanks")
        return found, np.diff(np.r_[0, last])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; there are no NULLs."""
        if self.exact:
            found = self.exact.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, unit = coded.dictionary, coded.indices.to_numpy()
        fit = pc.invert(pc.match_substring_regex(words, _UNFIT))
        store, sizes = self._of_words(words.filter(fit))
        fit = fit.to_numpy(zero_copy_only=False)
        size = np.zeros(len(words), np.int32)
        size[fit] = sizes
        # The ids of all words but each text's first, one text after the other.
        many = size[unit]
        first = offsets[:-1]
        many[first] = 0
        at = np.cumsum(many)
        begin = (np.cumsum(size) - size)[unit]
        take = np.repeat((begin - at + many).astype(np.int32), many)
        take += np.arange(len(take), dtype=np.int32)
        tail = store[take]
        ends = np.r_[0, at][offsets].tolist()
        odd = np.add.reduceat(~fit[unit], first) > 0 if len(first) else first
        heads = words.take(pa.array(unit[first])).to_pylist()
        out = []
        for i, (head, bad) in enumerate(zip(heads, odd.tolist(), strict=True)):
            out.append(self._whole(texts[i].as_py()) if bad else self._whole(head) + tail[ends[i] : ends[i + 1]].tobytes())
        return out


def _ids(path: str, pattern: str | None) -> Ids:
    """The tokenizer of a worker process, kept from task to task."""
    held = process_cache()
    if ("ids", path) not in held:
        held["ids", path] = Ids(path, pattern)
    return held["ids", path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about ``_BATCH`` bytes of text each, at least one row."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        reach = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BATCH, side="right"))
        stop = max(at + 1, reach)
        yield batch.slice(at, stop - at)
        at = stop


def pieces_of(docs: DataFrame, path: str, pattern: str | None, length: int, end: int) -> DataFrame:
    """``docs`` without text, one row per piece: ``piece, start, length, ids_crc32``.

    The first piece of a document takes what does not fill a whole sequence.
    """
    rest = without(docs, "text", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = _ids(path, pattern), int(end).to_bytes(4, "little")
        for batch in batches:
            for part in _slices(batch):
                ids = [x + last for x in ids_of(part.column("text"))]
                rows, piece, start, size, crc = [], [], [], [], []
                for row, raw in enumerate(ids):
                    n = len(raw) // 4
                    cuts = [0, *range(n % length or length, n + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                take = pa.array(rows, pa.int32())
                made = [
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in rest), *made],
                    names=[*rest, "piece", "start", "length", "ids_crc32"],
                )

    schema = docs.select(*rest).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    texts = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(*rest, texts).mapInArrow(run, schema)


def plan_rounds(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit over counted classes: ``(size, first_rank, n, first_sequence, offset)``.

    The i-th piece of an interval goes to sequence ``first_sequence + i``. Gaps
    are held as intervals of sequences with equal room.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    served = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(size: int, n: int, first: int, room: int) -> None:
        out.append((size, served[size], n, first, length - room))
        served[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]
        if room > size:
            gaps.setdefault(room - size, []).append((first, n))

    while left:
        sizes = np.array(sorted(left))
        rooms = np.array(sorted(gaps), dtype=np.int64)
        # The sweep: each gap class meets the largest piece class that fits.
        fit = np.searchsorted(sizes, rooms, side="right") - 1
        wants = {int(r): int(sizes[i]) for r, i in zip(rooms, fit, strict=True) if i >= 0}
        for room, size in wants.items():  # by rank: the tightest gap first
            held = gaps[room]
            while held and left.get(size):
                first, n = held.pop()
                took = min(n, left[size])
                if took < n:
                    held.append((first + took, n - took))
                place(size, took, first, room)
            if not held:
                del gaps[room]
        if not wants:
            # No gap can take anything: the largest class opens sequences. Copies
            # of it that fit together are found by the next rounds.
            size = max(left)
            n = left[size] if 2 * size > length else -(-left[size] // (length // size))
            place(size, n, sequences, length)
            sequences += n
    return out


def ranked(pieces: DataFrame, by: str, order: list[str], spread: int) -> DataFrame:
    """``pieces`` with ``rank``: gapless from 0 among rows of equal ``by``.

    Rows of one value are dealt to ``spread`` windows by a hash of ``order``, so
    a value that holds a third of all rows is still ranked in parallel; the
    windows' sizes are added up over one small row each.
    """
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    inner = Window.partitionBy(by, "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inner) - 1)
    sizes = dealt.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(offsets, [by, "_part"])
    return joined.withColumn("rank", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def best_fit_packing(
    docs: DataFrame, path: str, pattern: str | None = None, length: int = 1024, end: int = 2
) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, and ``piece, start, length,
    ids_crc32, sequence_id, offset``.

    ``path`` and ``pattern`` are a tokenizer's, see :class:`Ids`; ``end`` follows every document. A NULL or empty
    text is a piece with the end alone. Only documents longer than ``length``
    are cut. Rows with a NULL or repeated doc_id are packed like others. Columns
    that clash with those made here are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, path, pattern, length, end), "pieces")
    # At most ``length`` rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = plan_rounds(counts, length)
    # A window's rows must not grow with the corpus, also where one size has a third of all pieces.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(least, -(-max(counts.values(), default=0) // _WINDOW_ROWS))
    rows = ranked(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], spread)
    schema = "length long, first long, n long, sequence long, offset long"
    table = spark.createDataFrame(pa.table(
        dict(zip(("length", "first", "n", "sequence", "offset"), map(list, zip(*placed, strict=True)), strict=True))
        if placed
        else {k: pa.array([], pa.int64()) for k in ("length", "first", "n", "sequence", "offset")}
    ), schema)
    # A few thousand intervals at most; a size's own come as one short array.
    spans = table.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("_spans")
    )
    found = F.get(
        F.filter("_spans", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["first"] + s["n"])), F.lit(0)
    )
    out = rows.join(spans, "length").withColumn("_at", found)
    return out.select(
        *without(pieces, "sequence_id", "offset"),
        (F.col("_at.sequence") + F.col("rank") - F.col("_at.first")).alias("sequence_id"),
        F.col("_at.offset").alias("offset"),
    )
