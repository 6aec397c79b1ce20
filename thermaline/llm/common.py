"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators: it sorts after every other id.
NO_ID = 2**63 - 1

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all of Spark runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="thermaline-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, *sort: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lost executors never recompute what lies before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most `rows` rows of `df`, those of smallest key hash. Only hashes travel to find the bound, never the rows."""
    order = F.xxhash64(*key)
    last = df.select(order.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(F.lit(False) if last is None else order <= last).limit(rows)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.filter(F.split(text, SPACES), lambda w: w != F.lit(""))


def ident(id_col: str, text_col: str) -> list[Column]:
    """The inner key of a document: `did` (null ids last) and `th`, 64 bits that keep different texts under one id apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("th")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
