"""Clean, deduplicate, mix and tokenise the documents table, stage by stage.

Each stage takes the documents that its predecessor kept and returns them with the columns
of the documents table; the last one returns token ids. Models are fitted on the labels
table next to the documents and, as in the single queries, never on the held-out folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import mixing, pieces, quality, simhash, toxicity
from tallyfield.llm.common import prepare, store
from tallyfield.llm.queries import PIECE_FILE, labels, tokenizer_file

#: The classifiers have no SQL form; the tests compare run() with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay with all their columns.

    Null and empty texts stay, repeated rows and null ids are judged like any other.
    """
    prepare(spark)
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; all others stay with all their columns.

    Null and empty texts get the score of an empty text; repeated rows and null ids are judged
    like any other.
    """
    prepare(spark)
    return quality.keep_good(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id, with all its columns.

    Null and wordless texts are near-duplicates of each other; of repeated rows one stays; rows
    of one id whose texts differ all stay; a row without an id stays only where its group has none.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Texts without words are not taken; a null source is a source of its own.
    """
    prepare(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``ids`` and the digest of the decoded text.

    A null text counts as empty and has no ids; repeated rows and null ids come out as they are;
    further columns, also those named ``ids`` or ``n_tokens``, are ignored.
    """
    prepare(spark)
    model = pieces.load_model(tokenizer_file(PIECE_FILE))
    coded = docs.select("doc_id", "source", pieces.encode_column(spark, F.col("text"), model).alias("ids"))
    decoded = pieces.decode_column(spark, F.col("ids"), model)
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("simhash", near_duplicates),
    ("mixing", mixed_sources),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; the result of each is written and read again."""
    prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
