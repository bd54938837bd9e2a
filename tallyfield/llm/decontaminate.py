"""Passages of test items inside documents, found by one Aho-Corasick automaton.

Texts are sequences of folded words (``terms.py``). The patterns are all windows of ten
consecutive words of an item (an item of fewer words is one window); the automaton runs over
word numbers, so it has one state per different run of words, and every text is scanned once
from its first word to its last. Words outside the items' vocabulary are number zero, which is
in no pattern. Hits are runs of words; their offsets are mapped back to characters of the
original text.

The items travel in blocks of at most ``BLOCK_BYTES``, cut by prefix sums; an item longer than
a piece is cut into overlapping pieces with the same windows, and a word longer than
``LONG_WORD`` is held by its SHA-256, so an automaton's size has a bound whatever the items
are. With one block the documents are read once and never shuffled. With several, each block
scans them again and only texts with hits meet, by their digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm import terms
from tallyfield.llm.common import store
from tallyfield.llm.prefix import prefix_sums, range_parts

#: Words of a window.
WINDOW = 10
#: Bytes of item text behind one automaton.
BLOCK_BYTES = 1_000_000
#: Words of an item piece, without the overlap.
PIECE_WORDS = 2_000
#: Bytes above which a word is held by its digest.
LONG_WORD = 128

_SPANS = "spans array<struct<start:bigint,end:bigint>>"
_PASSAGES = f"doc_id bigint, n_words bigint, n_hit bigint, {_SPANS}, items array<string>"
_HITS = "digest binary, firsts array<int>, lasts array<int>, items array<string>"


def _held(word: bytes) -> bytes:
    """A word, or the digest of a very long one behind a byte that no word holds."""
    return word if len(word) <= LONG_WORD else b"\x00" + hashlib.sha256(word).hexdigest().encode()


@dataclass(frozen=True)
class Block:
    """Item pieces behind one automaton, sent to the workers."""

    pieces: list[tuple[str | None, bytes]]
    window: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scanner:
    """The automaton of a block over word numbers."""

    def __init__(self, block: Block):
        self.numbers: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        known: dict[tuple[int, ...], int] = {}
        widths: list[int] = []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for item, raw in block.pieces:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in raw.split()]
            width = min(block.window, len(words))
            for at in range(len(words) - width + 1):
                window = tuple(words[at : at + width])
                number = known.setdefault(window, len(known))
                if number == len(widths):
                    automaton.add_word(window, number)
                    widths.append(width)
                    self.items.append(set())
                if item is not None:
                    self.items[number].add(item)
        self.widths = np.array(widths, dtype=np.int64)
        if widths:
            automaton.make_automaton()
        self.automaton = automaton if widths else None

    def coded(self, cut: terms.Words) -> np.ndarray:
        """Number of every word; the different words of the texts are looked up once each."""
        coded = cut.words.dictionary_encode()
        numbers = self.numbers.get
        own = np.fromiter((numbers(_held(w), 0) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, dtype=np.int64)

    def scan(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """First and last words of the maximal hit runs of one text, and the items found in it."""
        found = list(self.automaton.iter(tuple(words.tolist()))) if self.automaton and len(words) else []
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        lasts, windows = np.array(found, dtype=np.int64).T
        firsts, lasts = runs(lasts - self.widths[windows] + 1, lasts, len(words))
        return firsts, lasts, sorted(set().union(*(self.items[w] for w in set(windows.tolist()))))


def runs(firsts: np.ndarray, lasts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that spans cover."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, lasts + 1, -1)
    hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    return edges[::2], edges[1::2] - 1


def _characters(text: str, starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Byte offsets of a text as character offsets."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": a, "end": b} for a, b in zip(before[starts].tolist(), before[ends].tolist(), strict=True)]


@lru_cache(maxsize=1)
def _scanner(name: str, block: Broadcast) -> Scanner:
    """One automaton for all tasks of a Python worker."""
    return Scanner(block.value)


def _row(cut: terms.Words, k: int, text: str | None, firsts: np.ndarray, lasts: np.ndarray) -> tuple[int, int, list]:
    """Number of words and hit words of text ``k`` and its hit runs in characters."""
    at = int(cut.bounds[k])
    spans = _characters(text, cut.starts[at + firsts], cut.ends[at + lasts]) if len(firsts) else []
    return int(cut.bounds[k + 1]) - at, int((lasts - firsts + 1).sum()), spans


def _passages(block: Broadcast, name: str):
    """Task that scans whole documents and returns the final rows."""
    types = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in terms.pieces(b, "text")):
            scanner, cut = _scanner(name, block), terms.cut(batch.column("text"))
            numbers, rows = scanner.coded(cut), []
            for k, text in enumerate(batch.column("text")):
                firsts, lasts, items = scanner.scan(numbers[cut.bounds[k] : cut.bounds[k + 1]])
                rows.append((*_row(cut, k, text.as_py() if len(firsts) else None, firsts, lasts), items))
            words, hits, spans, items = zip(*rows, strict=True)
            columns = [
                batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                pa.array(spans, pa.list_(types)), pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return scan


def _hits(block: Broadcast, name: str):
    """Task that returns digest, hit runs and items of the texts that hold windows of one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in terms.pieces(b, "text")):
            scanner, cut = _scanner(name, block), terms.cut(batch.column("text"))
            numbers, rows = scanner.coded(cut), []
            for k, text in enumerate(batch.column("text")):
                firsts, lasts, items = scanner.scan(numbers[cut.bounds[k] : cut.bounds[k + 1]])
                if len(firsts):
                    rows.append((hashlib.sha256(text.as_py().encode("utf-8", "surrogatepass")).digest(), firsts, lasts, items))
            if rows:
                types = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "firsts", "lasts", "items"])

    return scan


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit runs of several blocks to the final rows."""
    types = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    none = np.zeros(0, dtype=np.int64)
    for batch in (p for b in batches for p in terms.pieces(b, "text")):
        cut, rows = terms.cut(batch.column("text")), []
        for k in range(batch.num_rows):
            firsts, lasts = (batch.column(c)[k].as_py() for c in ("firsts", "lasts"))
            if not firsts:
                rows.append(_row(cut, k, None, none, none))
                continue
            n_words = int(cut.bounds[k + 1] - cut.bounds[k])
            merged = runs(np.array(firsts, dtype=np.int64), np.array(lasts, dtype=np.int64), n_words)
            rows.append(_row(cut, k, batch.column("text")[k].as_py(), *merged))
        words, hits, spans = zip(*rows, strict=True)
        columns = [
            batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
            pa.array(spans, pa.list_(types)), batch.column("items").fill_null([]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "spans", "items"])


def item_pieces(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item`` (its id as text) and ``words`` (space between) of overlapping pieces with the items' windows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in terms.pieces(b, "text")):
            cut, names, rows = terms.cut(batch.column("text")), [], []
            for k, item in enumerate(batch.column("item").to_pylist()):
                words = [_held(w) for w in cut.words[int(cut.bounds[k]) : int(cut.bounds[k + 1])].to_pylist()]
                for at in range(0, max(len(words) - window + 1, min(1, len(words))), PIECE_WORDS):
                    names.append(item)
                    rows.append(b" ".join(words[at : at + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.binary())], names=["item", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(split, "item string, words binary").distinct()


def item_blocks(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``block_bytes`` and one piece of item text, one at least; one at a time is on the driver."""
    pieces = item_pieces(items, window).withColumn("size", F.length("words").cast("long"))
    order = [F.col("item").asc_nulls_first(), F.col("words")]
    ranged = range_parts(pieces, order)
    placed = store(
        prefix_sums(ranged, order, "size")
        .select("item", "words", F.expr(f"(_end - size) div {block_bytes}").alias("block"))
        .repartition("block"),
        "items",
    )
    ranged.drop()
    last = placed.df.agg(F.max("block")).first()[0]
    for block in range((last or 0) + 1):
        rows = placed.df.filter(F.col("block") == block).select("item", "words").collect()
        yield Block([(r.item, bytes(r.words)) for r in rows], window)
    placed.drop()


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``spans`` and ``items`` of every document row.

    ``spans`` are the maximal runs of hit words as character offsets of the original text
    (end excluded); ``items`` are the sorted ids, as text, of the items with a window in it.
    Null and empty texts have no words; repeated rows and null ids of documents are kept as
    they are; other columns are ignored. An item without words has no window, a repeated item
    counts once, an item without an id hits words but is in no list. Texts are scanned whole.
    An empty table of items marks nothing, an empty table of documents gives no rows.
    """
    spark = docs.sparkSession
    docs, found = docs.select("doc_id", "text"), []
    blocks = item_blocks(items.select("item_id", "text"), window, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return docs.mapInArrow(_passages(spark.sparkContext.broadcast(block), block.name), _PASSAGES)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        hits = docs.select("text").mapInArrow(_hits(shared, block.name), _HITS)
        found.append(store(hits.dropDuplicates(["digest"]), "hits").df)
        block, following = following, next(blocks, None)
    # One row per text and block; the aggregate is stored, so a frequent text's rows can be split in the join.
    by_text = reduce(DataFrame.unionByName, found).groupBy("digest").agg(
        F.flatten(F.collect_list("firsts")).alias("firsts"),
        F.flatten(F.collect_list("lasts")).alias("lasts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    keyed = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    joined = keyed.join(store(by_text, "hits").df, "digest", "left")
    return joined.select("doc_id", "text", "firsts", "lasts", "items").mapInArrow(_resolve, _PASSAGES)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest of ``find_passages``: counts, a hash of the items' ids and the verdict of each document."""
    return find_passages(docs, items, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
