"""Quality rules with thresholds that follow each language and source.

Every metric gets a mergeable quantile sketch (KLL) per language and source. A
document is rejected where a metric lies outside its group's fence: the median
plus (or minus) a multiple of the distance from the 5 % quantile to the median,
the half that junk above does not reach. A source's fence is never wider than its
language's, so that a source full of junk cannot lift its own. Sketches
of groups with few documents are merged with those of their language and, if
that has few as well, of all documents, so that small groups borrow a fence.

Only DataFrame functions are used. The sketches are built by partial
aggregation, so a source that holds most documents costs each task one sketch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import SPACES, let, materialize, without, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Fence:
    """``times`` the lower spread, ``spread`` at least, is the distance of a fence from the median.

    Where over half of the documents have none of what a metric counts, the sketch
    has no lower spread and ``spread`` alone is the distance.
    """

    metric: str
    spread: float
    low: bool = False
    times: float = 4.0


FENCES = (
    Fence("mean_word_chars", 0.5, low=True),
    Fence("symbol_share", 0.05),
    Fence("dup_line_share", 0.4),
    Fence("echo_share", 0.08, times=16.0),
    Fence("capital_share", 0.05, times=12.0),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. The sort runs
    only for texts where two windows are equal.
    """
    last = F.size(words) - WINDOW

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            def same(j: Column, x: Column) -> Column:
                return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

            hit = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
            starts = F.sort_array(F.transform(hit, lambda x: x["i"]))
            return let(
                starts,
                lambda p: F.aggregate(
                    F.transform(
                        p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
                    ),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(last < 0, 0).otherwise(let(hashed, lambda w: let(windows(w), marked)))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and shares that the rules look at.

    A NULL text counts as empty. Columns of ``docs`` that clash with a feature
    are replaced by it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w)))
            .cast("long")
            .alias("n_echoes"),
            (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        )

    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_echoes", "n_capitals"]
    # An array of one, so that each text is taken apart once for all counts.
    counted = docs.select(*without(docs, *made), F.inline(F.array(let(words_of(F.col("text")), counts))))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "echo_share": share("n_echoes", "n_words"),
            "capital_share": share("n_capitals", "word_chars"),
            "base_failed": (F.col("n_words") < 20)
            | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def _key(name: str) -> Column:
    """A group key that is never NULL and keeps NULL apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))


def thresholds(featured: DataFrame, fences: tuple[Fence, ...] = FENCES, least: int = 200, k: int = 2048) -> DataFrame:
    """``lang_key, source_key`` and a ``low_``/``high_`` fence for each metric.

    Sketches cover all documents that pass the base rules. A group with fewer
    than ``least`` of them uses the sketch of its language, and a language with
    fewer the sketch of all. A group's own fence is capped by the one it would
    use otherwise.
    """
    names = [f.metric for f in fences]
    sketches = [F.kll_sketch_agg_double(F.col(m), F.lit(k)).alias(m) for m in names]
    keyed = featured.filter(~F.col("base_failed")).select(
        _key("lang").alias("lang_key"), _key("source").alias("source_key"), *names
    )
    own = keyed.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"), *sketches)
    own = materialize(own, "sketches")

    def merged(keys: list[str], tag: str) -> DataFrame:
        return own.groupBy(*keys).agg(
            F.sum("n").alias(f"n_{tag}"), *[F.kll_merge_agg_double(m).alias(f"{m}_{tag}") for m in names]
        )

    whole = merged([], "all")
    every = whole.select(F.struct(*whole.columns)).scalar()
    wide = own.join(merged(["lang_key"], "lang"), "lang_key").withColumn("every", every)

    def limits(sketch: Column, f: Fence) -> tuple[Column, Column]:
        few, mid = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.05, 0.5))
        reach = F.greatest(f.times * (mid - few), F.lit(f.spread))
        return mid + reach, mid - reach

    out = [F.col("lang_key"), F.col("source_key")]
    for f in fences:
        above = F.when(F.col("n_lang") >= least, F.col(f"{f.metric}_lang")).otherwise(F.col(f"every.{f.metric}_all"))
        own_high, own_low = limits(F.when(F.col("n") >= least, F.col(f.metric)).otherwise(above), f)
        high, low = limits(above, f)
        out.append(F.least(own_high, high).alias(f"high_{f.metric}"))
        if f.low:
            out.append(F.greatest(own_low, low).alias(f"low_{f.metric}"))
    return wide.select(*out)


def quality_rules(
    docs: DataFrame, fences: tuple[Fence, ...] = FENCES, least: int = 200, keep_text: bool = True
) -> DataFrame:
    """``docs`` with features, ``base_failed`` and ``kept``; no row is dropped.

    ``kept`` is false if the base rules fail (fewer than 20 words, or over 30 %
    of the words in repeated windows) or a metric lies outside its fence. NULL
    language or source forms a group of its own; a group all of whose documents
    fail the base rules needs no fence. Repeated rows are judged alike, and an
    empty table gives an empty result.
    """
    # The features are written once; the sketches and the verdict both read them.
    counted = features(docs)
    featured = materialize(counted if keep_text else counted.drop("text"), "features")
    limits = materialize(thresholds(featured, fences, least), "thresholds")
    keyed = featured.withColumns({"_lang": _key("lang"), "_source": _key("source")})
    bad = F.col("base_failed")
    for f in fences:
        bad = bad | F.coalesce(F.col(f.metric) > F.col(f"high_{f.metric}"), F.lit(False))
        if f.low:
            bad = bad | F.coalesce(F.col(f.metric) < F.col(f"low_{f.metric}"), F.lit(False))
    # The table of limits has one row per language and source and was just
    # written, so its size is known; Spark broadcasts it only while it is small.
    joined = keyed.join(
        limits, (F.col("_lang") == F.col("lang_key")) & (F.col("_source") == F.col("source_key")), "left"
    )
    return joined.withColumn("kept", ~bad).select(*featured.columns, "kept")
