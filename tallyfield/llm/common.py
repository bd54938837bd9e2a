"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import configure, stage_root

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime options of the library, and Arrow batches that stay small with long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes with A-Z lower-cased; none for null.

    Bytes are lower-cased and split by ASCII alone, at the characters that ``WORD_SQL`` leaves out.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(key: Column, divisor: int) -> Column:
    """CRC-32 of an id written as text, modulo ``divisor`` (null id: null)."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


@dataclass(frozen=True)
class Stored:
    """A table in the shared folder; ``df`` reads it, ``drop`` deletes it."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh place in the folder named by ``spark.checkpoint.dir``, which ``release_stages`` deletes."""
    return f"{stage_root(spark)}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str = "stage") -> Stored:
    """Write a table to the shared folder and read it back.

    The files outlive lost executors, later readers see the same rows (and the same
    partition numbers, where a column holds them), and the lineage ends here.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)
