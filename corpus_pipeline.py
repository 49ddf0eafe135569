"""A corpus pipeline of five operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadstats.llm.common import materialize, read
from roadstats.llm.mixing import mix
from roadstats.llm.packing import best_fit_packing
from roadstats.llm.quality import quality_rules
from roadstats.llm.queries import byte_bpe
from roadstats.llm.simhash import simhash_components
from roadstats.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's fences accept."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id.

    A document without an id stays only where its whole component has none, the
    one with the smallest hash of its text; rows that repeat the one kept go.
    """
    # A row's identity without NULLs: the join and the removal of repeated rows share one shuffle.
    key = ["_none", "_id", "_mark"]
    made = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")]
    rows = docs.select(*COLUMNS, *[c.alias(n) for c, n in zip(made, key, strict=True)])
    classes = simhash_components(rows.select("doc_id", "text", *key), words=3, max_bits=3, seed=42)
    first = classes.groupBy("root").agg(F.min(F.struct(*key)).alias("f"))
    return rows.join(first.select("f.*"), key, "left_semi").dropDuplicates(key).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has; a text left blank goes."""
    cut = suffix_dedup(docs, min_bytes=50, with_text=True, keep=("lang", "source"))
    texts = cut.withColumnRenamed("kept_text", "text").filter(F.trim("text") != "")
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered shares of sources, languages and topics."""
    return mix(docs.select(*COLUMNS), keep=0.7).filter("kept").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1,024 tokens."""
    packed = best_fit_packing(docs.select("doc_id", "text"), **byte_bpe(), length=1024, end=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL has neither XXH64, nor quantile sketches, nor the tokenizer.
ORACLE_SQL = None
