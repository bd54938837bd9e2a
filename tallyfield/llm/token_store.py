"""Token ids on disk: one shared zstandard dictionary, every document compressed by itself.

A store is a folder with two tables. ``dictionary`` has one row: the trained dictionary and
its SHA-256. ``blocks`` has the documents in ascending order, a few megabytes to a row:
``part`` (range partition), ``block``, ``doc_ids``, ``n_tokens``, ``starts`` (ids before each
document within the part), ``offsets`` (of each document's frame in ``payload``),
``payload`` and the dictionary's hash. A short document is read by cutting one frame out
of one row. Spark writes the files, so a lost task is written anew and nothing is left half
done. ``parts`` (one row per part) holds the ids before each part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfield.llm.common import new_path

#: Id that ends every document.
END_ID = 1
#: The dictionary is trained on at most so many documents, the first by hash, none longer than this.
DICTIONARY_DOCS = 1000
DICTIONARY_TEXT = 20_000
DICTIONARY_BYTES = 65_536
#: Compressed bytes after which a block is closed.
BLOCK_BYTES = 4_000_000
LEVEL = 3
CACHED_CHUNKS = 700_000

BLOCK_SCHEMA = (
    "part int, block int, doc_ids array<bigint>, n_tokens array<bigint>, starts array<bigint>,"
    " offsets array<bigint>, payload binary, dictionary_sha256 string"
)
_ARROW_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()), ("dictionary_sha256", pa.string()),
    ]
)
#: Signs that end a chunk; after a letter the tokenizer always cuts before them.
_SIGNS = ".,;:!?"


def _one_word(chunk: str) -> bool:
    """Letters alone, which stay so when normalized and lower-cased: the tokenizer sees one word."""
    return chunk.isalpha() and (chunk.isascii() or is_normalized("NFC", chunk) and chunk.lower().isalpha())


class ChunkEncoder:
    """Texts to little-endian 32-bit ids; chunks between blanks are encoded once and remembered.

    The vocabulary marks the last token of a word, so many chunks whose number of words is
    known (letters: one, letters and sentence signs: two) go to the library as one text.
    """

    def __init__(self, definition: str):
        self.library = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, missing: list[str]) -> None:
        """Remember the ids of new chunks."""
        words, signed, rest = [], [], []
        for chunk in missing:
            if _one_word(chunk):
                words.append(chunk)
            elif chunk[-1:] in _SIGNS and _one_word(chunk.rstrip(_SIGNS)):
                signed.append(chunk)
            else:
                rest.append(chunk)
        for chunks, each in ((words, 1), (signed, 2)):
            groups = [chunks[at : at + 200] for at in range(0, len(chunks), 200)]
            coded = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
            for group, result in zip(groups, coded, strict=True):
                ids = np.array(result.ids, dtype="<u4")
                ends = (4 * (np.flatnonzero(self.closes[ids])[each - 1 :: each] + 1)).tolist()
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        coded = self.library.encode_batch_fast(rest, add_special_tokens=False)
        self.known.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(rest, coded, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id; null counts as empty.

        Arrow cuts the texts at blanks and numbers the different chunks; only these are
        looked up one by one, and numpy lays their ids out text by text.
        """
        cut = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_CHUNKS:  # the chunks met first are the frequent ones
            self.known = dict(islice(self.known.items(), CACHED_CHUNKS // 2))
        known = self.known
        self._learn([w for w in chunks if w not in known])
        own = [known[w] for w in chunks]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(own), dtype="<u4")
        place = coded.indices.to_numpy()
        each = sizes[place]
        ends = np.cumsum(each)
        ids = pool[np.arange(int(each.sum())) + np.repeat(starts[place] - (ends - each), each)].tobytes()
        ends = (4 * np.concatenate([[0], ends])[bounds]).tolist()
        end = np.uint32(END_ID).tobytes()
        return [ids[a:b] + end for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=1)
def _encoder(definition: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker, which has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(definition)


def train_dictionary(docs: DataFrame, definition: str) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty where the sample is too small."""
    # Ids alone are ranked, of about twice as many rows as wanted, so little goes to the driver.
    share = 2 * DICTIONARY_DOCS / max(1, docs.count())
    place = F.xxhash64("doc_id")
    few = docs.filter(F.pmod(place, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select("doc_id", place.alias("place"))
    picked = few.distinct().orderBy("place", "doc_id").limit(DICTIONARY_DOCS)
    # DICTIONARY_DOCS rows at most.
    sample = (
        docs.join(F.broadcast(picked), "doc_id")
        .filter(F.length("text") <= DICTIONARY_TEXT)
        .orderBy("place", "doc_id", "text")
        .select("text")
        .limit(2 * DICTIONARY_DOCS)
        .collect()
    )
    coded = ChunkEncoder(definition).encode([r.text for r in sample])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, coded).as_bytes()
    except zstandard.ZstdError:  # fewer samples than training needs
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 8_000_000) -> Iterator[tuple[int, list[int | None], list[str | None]]]:
    """Range partition, ids and texts of all batches of a task, in pieces of bounded size."""
    part, ids, texts, held = 0, [], [], 0
    for batch in batches:
        for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text or "")
            if held > limit:
                yield part, ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield part, ids, texts


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Encode ``text`` of every document and write a store in ascending ``doc_id`` order.

    Null ids come first, repeated rows are stored repeatedly, null and empty texts hold the
    end id alone, texts of any length are encoded whole, other columns are ignored; an empty
    table makes an empty store. Returns the folder, which lies in the shared folder unless
    ``path`` names one.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, definition)
    sha = hashlib.sha256(raw).hexdigest()
    # Both are of fixed size: the vocabulary's and the dictionary's.
    shared = spark.sparkContext.broadcast((definition, raw))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, raw = shared.value
        encoder = _encoder(definition)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
        part = block = start = held = 0
        ids, counts, starts, offsets, frames = [], [], [], [0], []

        def close() -> pa.RecordBatch:
            row = [[part], [block], [ids], [counts], [starts], [offsets], [b"".join(frames)], [sha]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW_BLOCK, strict=True)], schema=_ARROW_BLOCK)

        for part, doc_ids, texts in _texts(batches):  # noqa: B007  (read by close)
            for doc_id, coded in zip(doc_ids, encoder.encode(texts), strict=True):
                frames.append(compress(coded))
                held += len(frames[-1])
                ids.append(doc_id)
                counts.append(len(coded) // 4)
                starts.append(start)
                offsets.append(held)
                start += counts[-1]
                if held >= BLOCK_BYTES:
                    yield close()
                    block, held = block + 1, 0
                    ids, counts, starts, offsets, frames = [], [], [], [0], []
        if ids:
            yield close()

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The number breaks ties between rows of one id, so that many of them can be split.
    tied = docs.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranged = tied.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    rows = ranged.sortWithinPartitions(*order).select("doc_id", "text", "part")
    rows.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(sha, bytearray(raw))], "sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")
    # One row per block, then one per part.
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(_sum("n_tokens")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/parts")
    return path


def _sum(column: str) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda total, n: total + n)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (little-endian 32-bit)."""
    [(sha, raw)] = spark.read.parquet(f"{path}/dictionary").select("sha256", "dictionary").collect()
    raw = bytes(raw)
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    shared = spark.sparkContext.broadcast(raw)
    columns = ["before", "doc_ids", "n_tokens", "starts", "offsets", "payload", "dictionary_sha256"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value)).decompress
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for before, ids, counts, starts, offsets, payload, made_with in zip(*batch.columns, strict=True):
                if made_with.as_py() != sha:
                    raise ValueError("a block was written with another dictionary")
                view, cut = memoryview(payload.as_buffer()), offsets.as_py()
                first = before.as_py()
                ids, counts, starts = ids.as_py(), counts.as_py(), starts.as_py()
                for at in range(0, len(ids), 500):
                    upto = min(at + 500, len(ids))
                    coded = [expand(view[cut[i] : cut[i + 1]]) for i in range(at, upto)]
                    if any(len(c) != 4 * n for c, n in zip(coded, counts[at:upto], strict=True)):
                        raise ValueError("a document does not have the length in its index")
                    values = [ids[at:upto], [first + s for s in starts[at:upto]], counts[at:upto], coded]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    # One row per range partition.
    placed = blocks.join(F.broadcast(parts), "part").select(*columns)
    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """The store's index with a CRC-32 of each document's ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
