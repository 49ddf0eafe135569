"""Language identification by unigrams over a public vocabulary, all segmentations summed.

Each language has a probability for every piece of a fixed vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of
its pieces' probabilities, which the forward algorithm gives in one pass. The
probabilities are learned by expectation maximisation with the same sums: every
step is a Spark job over the distinct words of a bounded sample, and returns one
number for each piece and language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import process_cache, without, words_of

START = "▁"
#: Characters of words whose scores a worker process keeps.
CACHE = 2_000_000
UNKNOWN = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``chance[piece, language]``; pieces by the sorted hash of their characters."""

    languages: list[str]
    hashes: np.ndarray
    longest: int
    chance: np.ndarray


def _plain(model: Model) -> tuple:
    """A model as a tuple, which needs no code to be read."""
    return model.languages, model.hashes, model.longest, model.chance


def piece_hashes(pieces: list[str]) -> tuple[np.ndarray, int]:
    """Sorted hashes of the pieces, and the length of the longest."""
    found = {p for p in pieces if p and len(p) <= 16}
    hashes = set()
    for p in found:
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        hashes.add(h)
    return np.array(sorted(hashes), np.uint64), max(map(len, found))


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def _lattice(words: list[str], hashes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
    """Words of one length at a time: their rows, the length, and for each size of a piece the one that
    begins at each place, or -1.

    A piece's hash is a polynomial of its characters, so that those of all
    substrings of a size come from the hashes of the prefixes at once.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        rows, step = np.flatnonzero(lengths == n), max(1, 640_000 // n)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            codes = np.array([words[i] for i in part], f"<U{n}").view("<u4").reshape(len(part), n).astype(np.uint64)
            prefix = np.zeros((len(part), n + 1), np.uint64)
            for end in range(n):
                prefix[:, end + 1] = prefix[:, end] * _BASE + codes[:, end] + np.uint64(1)
            found, power = [], np.uint64(1)
            for size in range(1, min(longest, n) + 1):
                power = np.uint64((int(power) * int(_BASE)) & ((1 << 64) - 1))
                h = prefix[:, size:] - prefix[:, : n + 1 - size] * power
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found.append(np.where(hashes[where] == h, where, -1))
            yield part, n, found


def _seen(found: list[np.ndarray], n: int) -> list[list[int]]:
    """For each end, the sizes of which any word has a piece there; always 1."""
    sizes: list[list[int]] = [[] for _ in range(n + 1)]
    for size, at in enumerate(found, 1):
        there = np.arange(at.shape[1]) if size == 1 else np.flatnonzero((at >= 0).any(0))
        for begin in there.tolist():
            sizes[begin + size].append(size)
    return sizes


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations, whatever its length.

    The sums over the segmentations of the last prefixes, as many as a piece is
    long, are all that is held; every few steps they are divided by the newest, whose
    logarithm is carried along.
    """
    out = np.empty((len(words), len(model.languages)))
    chance = np.vstack([model.chance, np.zeros((1, len(model.languages)))])
    for rows, n, found in _lattice(words, model.hashes, model.longest):
        sums, carried = {0: np.ones((len(rows), chance.shape[1]))}, np.zeros((len(rows), chance.shape[1]))
        for end, sizes in enumerate(_seen(found, n)[1:], 1):
            total = np.zeros_like(carried)
            for size in sizes:
                p = chance[found[size - 1][:, end - size]]
                total += sums[end - size] * (np.maximum(p, UNKNOWN) if size == 1 else p)
            sums[end] = total
            sums.pop(end - model.longest, None)
            if end % 8 == 0:
                carried += np.log(total)
                sums = {k: v / total for k, v in sums.items()}
        out[rows] = np.log(sums[n]) + carried
    return out


def expected_counts(words: list[str], weight: np.ndarray, model: Model, language: int) -> np.ndarray:
    """Expected uses of each piece when the words are cut by the model of one language."""
    out = np.zeros(len(model.hashes) + 1)
    chance = np.append(model.chance[:, language], 0.0)
    for rows, n, found in _lattice(words, model.hashes, model.longest):
        with np.errstate(divide="ignore"):
            logs = [np.log(np.maximum(chance[f], UNKNOWN) if size == 1 else chance[f]) for size, f in enumerate(found, 1)]
        sizes = _seen(found, n)
        ahead, back = np.full((n + 1, len(rows)), -np.inf), np.full((n + 1, len(rows)), -np.inf)
        ahead[0] = back[n] = 0
        for end in range(1, n + 1):
            for size in sizes[end]:
                ahead[end] = np.logaddexp(ahead[end], ahead[end - size] + logs[size - 1][:, end - size])
        for end in range(n, 0, -1):
            for size in sizes[end]:
                back[end - size] = np.logaddexp(back[end - size], back[end] + logs[size - 1][:, end - size])
        for size, f in enumerate(found, 1):
            share = np.exp(ahead[: n + 1 - size].T + logs[size - 1] + back[size:].T - ahead[n][:, None])
            out += np.bincount(f.ravel() % len(out), (share * weight[rows][:, None]).ravel(), len(out))
    return out[:-1]


def units(text: str) -> list[str]:
    """Words of a text with their start mark."""
    return [START + word for word in text.split()]


def learn(
    labelled: DataFrame,
    pieces: list[str],
    docs_a_language: int = 400,
    rounds: int = 2,
    smooth: float = 0.5,
    most_languages: int = 500,
) -> Model:
    """Piece probabilities per language from ``labelled`` (``doc_id, text, lang``).

    About ``docs_a_language`` documents of each language are drawn by a hash of
    doc_id; the bound is a parameter, and everything that reaches the driver has
    one number for each piece and language. Words of any length are learned from.
    Rows with a NULL language teach nothing, nor do NULL and empty texts; without a
    labelled row the model has no language. More than ``most_languages`` languages
    raise: the broadcast model has one number for each piece and language.
    """
    hashes, longest = piece_hashes(pieces)
    labelled = labelled.filter(F.col("lang").isNotNull())
    # One row for each language, of which there may be so many.
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The sizes are part of the filter, so no text is shuffled for the draw.
    size = F.lit(0)
    for lang, n in sizes.items():
        size = F.when(F.col("lang") == lang, n).otherwise(size)
    drawn = labelled.filter(draw * size < docs_a_language)
    words = drawn.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    model = Model(languages, hashes, longest, np.full((len(hashes), len(languages)), 1 / len(hashes)))
    for _ in range(rounds):
        held = labelled.sparkSession.sparkContext.broadcast(_plain(model))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = Model(*held.value)  # noqa: B023
            sums = np.zeros_like(now.chance)
            for batch in batches:
                lang = np.array(batch.column("lang").to_pylist(), object)
                word, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for k, name in enumerate(now.languages):
                    rows = np.flatnonzero(lang == name)
                    cut = [(u, n[i]) for i in rows for u in units(word[i])]
                    if cut:
                        sums[:, k] += expected_counts([u for u, _ in cut], np.array([w for _, w in cut], float), now, k)
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[piece, k])], names=["piece", "k", "n"]
            )

        uses = counted.mapInArrow(expect, "piece int, k int, n double")
        total = uses.groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        chance = np.full_like(model.chance, smooth)
        chance[total["piece"], total["k"]] += total["n"]
        model = Model(languages, hashes, longest, chance / chance.sum(0))
    counted.unpersist()
    return model


def _scores(texts: list[str | None], model: Model, mark: str) -> list[tuple[str, float]]:
    cache = process_cache()
    if cache.get("langid") != mark:
        cache["langid"], cache["langid-words"] = mark, ({}, np.zeros((0, len(model.languages))), 0)
    index, table, size = cache["langid-words"]
    cut = [units(t) if t is not None and any(c.isalpha() for c in t) else [] for t in texts]
    if size > CACHE:
        index, table, size = {}, table[:0], 0
    fresh = list({u for held in cut for u in held if u not in index})
    if fresh:
        index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
        table = np.vstack([table, word_scores(fresh, model)])
        size += sum(map(len, fresh))
    cache["langid-words"] = (index, table, size)
    out = []
    for held in cut:
        if not held or not model.languages:
            out.append(("und", 0.0))
            continue
        sums = table[np.fromiter(map(index.__getitem__, held), np.int64, len(held))].sum(0)
        best = int(sums.argmax())
        out.append((model.languages[best], float(1 / np.exp(sums - sums[best]).sum())))
    return out


def model_mark(model: Model) -> str:
    """A name of the model's contents, by which a worker process knows whose scores it keeps."""
    mark = hashlib.blake2b(repr(model.languages).encode())
    for part in (model.hashes, model.chance):
        mark.update(part.tobytes())
    return mark.hexdigest()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with ``lang_pred`` and ``score``, the probability of that language.

    The whole text counts. A NULL text, one without a letter, or a model without
    languages gives ``und`` and 0. Languages are equally likely beforehand; ties
    go to the first by name. Clashing columns are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(_plain(model))
    mark = model_mark(model)
    rest = without(docs, "text", "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = _scores(part.column("text").to_pylist(), now, mark)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in rest),
                        pa.array([name for name, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    names=[*rest, "lang_pred", "score"],
                )

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*rest, "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of learning; a NULL doc_id is not."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2
