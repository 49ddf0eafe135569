"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text as an array; NULL and blank texts have none."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return let(plain, lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE_RUN)))


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` other than ``names``, in order."""
    return [c for c in df.columns if c not in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has no such setting (local runs and tests), a folder is
    made once per session, which only a local master can use.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="roadstats-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage so that a lost executor costs no more than the files'
    next read, and gives the planner the table's real size.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, n_bytes: int, part_bytes: int) -> int:
    """Number of pieces of about ``part_bytes`` each, never fewer than the shuffle's partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_bytes // part_bytes))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, a single number."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def process_cache() -> dict:
    """A dictionary that lives as long as the worker process.

    Module variables do not: functions sent with a task bring their own copies.
    """
    name = "roadstats_process_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("held", {})
