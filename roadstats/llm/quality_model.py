"""A quality classifier on document statistics: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a row of statistics. Random Fourier features of the
standardised row approximate a Gaussian kernel; a linear model on them is fitted
by ridge regression, whose normal equations are sums over rows: every partition
adds up its own and Spark sums the partitions'. The raw scores of labelled rows
that the fit did not see are then mapped to probabilities by isotonic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from roadstats.llm.common import materialize, without

STATISTICS = (
    "log_chars",
    "log_words",
    "word_chars",
    "capitals",
    "digits",
    "symbols",
    "bars",
    "stops",
    "exclamations",
    "other_letters",
    "line_words",
    "distinct_words",
    "top_word",
    "echoes",
    "repeated_pairs",
    "repeated_lines",
    "open_lines",
    "marked_words",
    "tags",
)
_SYMBOLS = re.compile(r"[#*$%&<>{}\[\]\\^~=_+@/]")
_DIGITS = re.compile(r"[0-9]")
_MARKED = re.compile(r"[^\w\s.,;:'\"()-](?=\s|$)")
_TAGS = re.compile(r"https?:|www\.|</?[a-z]+")


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; NULL counts as empty, whose shares are 0."""
    text = text or ""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, chars, held = max(len(words), 1), max(len(text), 1), Counter(words)
    plain = text.encode("ascii", "ignore").decode()
    pairs = len(words) - 1
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        (len(text) - text.count(" ")) / n,
        sum(map(plain.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / chars,
        len(_DIGITS.findall(text)) / chars,
        len(_SYMBOLS.findall(text)) / chars,
        text.count("|") / n,
        (text.count(".") + text.count(",")) / n,
        (text.count("!") + text.count("?")) / n,
        (len(text) - len(plain)) / chars,
        float(np.log1p(len(words) / max(len(lines), 1))),
        float(np.log1p(len(held)) / np.log1p(n)),
        max(held.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(not line.rstrip().endswith((".", "!", "?")) for line in lines) / max(len(lines), 1),
        len(_MARKED.findall(text)) / n,
        len(_TAGS.findall(text)) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``statistics`` as an array."""
    rest = without(docs, "text", "statistics")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(found, pa.list_(pa.float64()))],
                    names=[*rest, "statistics"],
                )

    schema = docs.select(*rest).schema.add("statistics", ArrayType(DoubleType()))
    return docs.select(*rest, "text").mapInArrow(run, schema)


@dataclass
class Model:
    """``weights`` of the features (the last is the intercept); ``at`` and ``to`` map raw scores to probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    to: np.ndarray


def _plain(m: Model) -> tuple:
    """A model as a tuple, which needs no code to be read."""
    return m.mean, m.scale, m.waves, m.phases, m.weights, m.at, m.to


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def fourier(x: np.ndarray, model: Model) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a last column of ones."""
    plain = np.clip((x - model.mean) / model.scale, -6, 6)
    waves = np.cos(plain @ model.waves + model.phases) * np.sqrt(2 / len(model.phases))
    return np.hstack([waves, np.ones((len(x), 1))])


def _raw(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``raw``, the ridge score."""
    held = rows.sparkSession.sparkContext.broadcast(_plain(model))
    rest = without(rows, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(*held.value)
        for batch in batches:
            raw = fourier(_matrix(batch.column("statistics")), now) @ now.weights
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(raw)], names=[*rest, "raw"])

    return rows.select(*rest).mapInArrow(run, rows.select(*rest).schema.add("raw", "double"))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of products of the features with each other and with the label.

    A partition returns one number for each pair of features; their number is
    fixed by the model, so the driver gets a table of a fixed size.
    """
    held = rows.sparkSession.sparkContext.broadcast(_plain(model))
    n = len(model.phases) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = Model(*held.value), np.zeros((n, n + 1))
        for batch in batches:
            z = fourier(_matrix(batch.column("statistics")), now)
            weight, label = batch.column("weight").to_numpy(), batch.column("label").to_numpy()
            weighted = z * weight[:, None]
            sums += np.hstack([weighted.T @ z, (weighted.T @ label)[:, None]])
        i, j = np.triu_indices(n, 0, n + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["i", "j", "v"])

    parts = rows.select("statistics", "weight", "label").mapInArrow(run, "i long, j long, v double")
    total = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((n, n + 1))
    sums[total["i"], total["j"]] = total["v"]
    square = np.triu(sums[:, :n])
    return square + square.T - np.diag(np.diag(square)), sums[:, n]


def learn(
    labelled: DataFrame, features: int = 256, ridge: float = 1e-3, seed: int = 12, step: float = 1e-4
) -> Model | None:
    """A model from ``doc_id, statistics, label, weight``; ``None`` without a row.

    All rows count. A fifth of them, by a hash of doc_id, is kept from the fit and
    used for the calibration alone; raw scores are counted to ``step`` before it.
    """
    # Fixed numbers of moments, one pass.
    k = len(STATISTICS)
    moments = [f(F.col("statistics")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = labelled.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not found["n"]:
        return None
    mean = np.array([found[f"m{i}"] for i in range(k)])
    scale = np.maximum([found[f"s{i}"] for i in range(k)], 1e-6)
    draw = np.random.default_rng(seed)
    waves, phases = draw.normal(0, 1 / np.sqrt(k), (k, features)), draw.uniform(0, 2 * np.pi, features)
    model = Model(mean, scale, waves, phases, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    square, right = _normal_equations(labelled.filter(~apart), model)
    penalty = ridge * max(square[-1, -1], 1) * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(square + penalty, right)
    scored = _raw(labelled.filter(apart).select("statistics", "label", "weight"), model)
    binned = scored.groupBy((F.round(F.col("raw") / step) * step).alias("raw")).agg(
        (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight")
    )
    # Bounded: raw scores of cosine features lie within a fixed range, counted to ``step``.
    binned = materialize(binned, "calibration")
    if binned.isEmpty():
        return model
    fitted = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(binned)
    model.at, model.to = fitted.boundaries.toArray(), fitted.predictions.toArray()
    return model


def _share_of(raw: np.ndarray, model: Model) -> np.ndarray:
    mapped = np.interp(raw, model.at, model.to) if len(model.at) else raw
    return np.clip(mapped, 0, 1)


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (with ``statistics``) with ``score`` and ``predicted``; 0.5 and 1 without a model."""
    rest = without(rows, "statistics", "score", "predicted")
    if model is None:
        return rows.select(*rest, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    held = rows.sparkSession.sparkContext.broadcast(_plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(*held.value)
        for batch in batches:
            score = np.round(_share_of(fourier(_matrix(batch.column("statistics")), now) @ now.weights, now), 9)
            made = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), *made], names=[*rest, "score", "predicted"]
            )

    schema = rows.select(*rest).schema.add("score", "double").add("predicted", "integer")
    return rows.select(*rest, "statistics").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is left out of learning; a NULL doc_id is not."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = 256) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``docs`` have ``doc_id, text`` (other columns are dropped), ``labels`` have
    ``doc_id, quality``. Labels other than 0 and 1, or of held-out documents, or
    without an id teach nothing; several of one document count as their mean, with
    their number as weight, once for each of its rows. NULL texts count as empty
    ones, which have a score like all others. Without any label all scores are 0.5.
    An empty table gives no rows.
    """
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    # Written, so that texts are read once for the fit and the scores.
    rows = materialize(with_statistics(marked), "statistics")
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id"))
    known = known.agg(F.avg("quality").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    labelled = rows.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id")).drop("_id", "held_out")
    model = learn(materialize(labelled, "labelled"), features)
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")
