"""The registered queries of this subpackage: name -> callable(spark, table directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import (
    ann,
    decontaminate,
    embedding,
    lexical,
    mixing,
    pieces,
    ppm,
    prefix_trie,
    quality,
    sharding,
    simhash,
    token_store,
    toxicity,
)
from tallyfield.llm.common import prepare

PIECE_FILE = "piece_bpe_32k.model"
WORD_FILE = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(prepare(spark), directory)

    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def embeddings(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/embeddings.parquet")


def labels(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/labels.parquet")


def benchmark(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/benchmark.parquet")


def conversations(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/conversations.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_sentencepiece(spark, sf):
    """Encode and decode all documents; counts and digests of the results."""
    return pieces.digests(pieces.encode_decode(documents(spark, sf), tokenizer_file(PIECE_FILE)))


@query
def op2_embedding_dedup(spark, sf):
    """Near-duplicate groups of all vectors of a label."""
    return embedding.near_duplicates(embeddings(spark, sf))


@query
def op3_toxicity(spark, sf):
    """Toxicity score of all documents."""
    return toxicity.score_documents(documents(spark, sf), labels(spark, sf))


@query
def op4_ppm(spark, sf):
    """Log10 probability of all documents under the tries of words and of running text and under smoothed unigrams."""
    return ppm.score_documents(documents(spark, sf), both=True)


@query
def op5_sharding(spark, sf):
    """Eight contiguous shards of nearly equal bytes."""
    return sharding.byte_shards(documents(spark, sf))


@query
def op6_nearest(spark, sf):
    """Five nearest vectors of every fiftieth."""
    return ann.nearest(embeddings(spark, sf))


@query
def op7_quality(spark, sf):
    """Quality score of all documents."""
    return quality.score_documents(documents(spark, sf), labels(spark, sf))


@query
def op8_token_store(spark, sf):
    """Write all documents as compressed token ids, read the store back and digest it."""
    path = token_store.write_tokens(documents(spark, sf), tokenizer_file(WORD_FILE))
    return token_store.digests(token_store.read_tokens(spark, path))


@query
def op9_simhash(spark, sf):
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(documents(spark, sf))


@query
def op10_mixing(spark, sf):
    """Words that the mix takes of every document."""
    return mixing.taken_words(documents(spark, sf))


@query
def op11_lexical(spark, sf):
    """Ten highest-ranked documents of every benchmark item."""
    return lexical.rank_documents(documents(spark, sf), benchmark(spark, sf))


@query
def op12_decontaminate(spark, sf):
    """Words of all documents that lie in passages of benchmark items."""
    return decontaminate.contamination(documents(spark, sf), benchmark(spark, sf))


@query
def op13_prefix_trie(spark, sf):
    """All nodes of the prefix trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(conversations(spark, sf))
