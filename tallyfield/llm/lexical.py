"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through the normaliser ``m``. The index groups
documents by equal ``m`` into strata (a large stratum into pieces of bounded size); a row of
the index is one such piece with its own lexicon, and a term's postings are runs of equal
``tf``, largest first, so an impact is computed once for each ``tf`` of a stratum. The largest
``tf`` of every query term bounds what a stratum can score. A search visits strata in falling
order of that bound and stops, query by query, below the tenth score it has already found:

1. every task visits only strata that are the best it has met for a query, which gives a
   global threshold per query;
2. every task visits its strata in order, from that threshold on, and returns its best ten.

Both read the index where it lies; only ten rows per query and task are shuffled. Texts are
cut into words once. The index holds all terms of all documents and does not depend on the
queries, which travel in blocks of bounded size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm import terms
from tallyfield.llm.common import Stored, store
from tallyfield.llm.prefix import prefix_sums, range_parts

#: Results per query.
TOP = 10
#: Postings and documents after which a piece of a stratum is closed.
PIECE_POSTINGS = 20_000
PIECE_DOCS = 4_096  # below 65,536, as ordinals take 16 bits
#: Strata that are open at a time, in the order of their bounds.
OPEN_STRATA = 16
#: Range partitions of an index to one of a shuffle; the last ones hold the longest documents.
FINER = 4
#: Bytes of distinct query terms that are searched for together.
BLOCK_BYTES = 1_000_000

_COUNTED = "doc_id bigint, n bigint, words binary, tfs binary"
_INDEX = (
    "m bigint, doc_ids array<bigint>, terms binary, term_runs binary, run_tfs binary, run_sizes binary, docs binary"
)
_INDEX_NAMES = ["m", "doc_ids", "terms", "term_runs", "run_tfs", "run_sizes", "docs"]
_INDEX_TYPES = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Consecutive parts of an integer array as binary values."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n``, the different words (space between) and their counts of every text with a word."""
    for batch in (p for b in batches for p in terms.pieces(b, "text")):
        cut = terms.cut(batch.column("text"))
        n = np.diff(cut.bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        coded = cut.words.dictionary_encode()
        size = len(coded.dictionary)
        both = np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy()
        both, tfs = np.unique(both, return_counts=True)
        bounds = np.searchsorted(both, np.append(some, len(n)) * size)
        words = coded.dictionary.cast(pa.binary()).take(pa.array(both % size))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)
        columns = [
            batch.column("doc_id").take(pa.array(some)), pa.array(n[some], pa.int64()),
            pc.binary_join(lists, b" "), _blobs(tfs.astype("<i4"), bounds),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "words", "tfs"])


def _stratum(m: int, ids: list, words: list[bytes], tfs: list[bytes]) -> pa.RecordBatch:
    """One row of the index from documents of equal ``m``."""
    each = np.array([len(t) // 4 for t in tfs])
    tf = np.frombuffer(b"".join(tfs), dtype="<i4")
    doc = np.repeat(np.arange(len(ids), dtype="<u2"), each)
    coded = pa.array(b" ".join(words).split(b" "), pa.binary()).dictionary_encode()
    term = coded.indices.to_numpy()
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    opens = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    # A term has a run for each of its tfs and a run a posting for each document: both fit 16 bits.
    run_sizes = np.diff(np.append(opens, len(term))).astype("<u2")
    term_runs = np.bincount(term[opens], minlength=len(coded.dictionary)).astype("<u2")
    lexicon = b" ".join(coded.dictionary.to_pylist())
    row = [[m], [ids], [lexicon], [term_runs.tobytes()], [tf[opens].tobytes()], [run_sizes.tobytes()], [doc.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)


def _strata(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in ascending ``m`` to strata, closed early where they grow large."""
    now, ids, words, tfs, held = None, [], [], [], 0
    for batch in batches:
        for m, doc_id, word, tf in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "words", "tfs")), strict=True):
            if ids and (m != now or held >= most or len(ids) >= PIECE_DOCS):
                yield _stratum(now, ids, words, tfs)
                ids, words, tfs, held = [], [], [], 0
            now = m
            ids.append(doc_id)
            words.append(word)
            tfs.append(tf)
            held += len(tf) // 4
    if ids:
        yield _stratum(now, ids, words, tfs)


@dataclass(frozen=True)
class Index:
    """A stored index; ``documents`` counts those with a term, ``length`` all their terms."""

    strata: Stored
    documents: int
    length: int

    def drop(self) -> None:
        self.strata.drop()


def build_index(docs: DataFrame, piece_postings: int = PIECE_POSTINGS) -> Index:
    """Index ``text`` of all documents.

    Texts are read whole; null and empty ones have no term and no place in the index.
    Repeated rows are documents of their own, null ids are kept, other columns are ignored.
    """
    spark = docs.sparkSession
    counted = store(docs.select("doc_id", "text").mapInArrow(count_terms, _COUNTED), "counted")
    documents, length = counted.df.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Decimals keep the product exact where it leaves 64 bits.
    m = F.expr(f"25 + cast((75 * cast(n as decimal(20,0)) * {documents}BD) div {max(length, 1)}BD as bigint)")
    parts = FINER * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = counted.df.select(m.alias("m"), "doc_id", "words", "tfs", F.monotonically_increasing_id().alias("_tie"))
    ranged = placed.repartitionByRange(parts, "m", "_tie").sortWithinPartitions("m", "_tie").drop("_tie")
    strata = store(ranged.mapInArrow(lambda rows: _strata(rows, piece_postings), _INDEX), "strata")
    counted.drop()
    return Index(strata, documents, length)


@dataclass(frozen=True)
class Block:
    """Queries that are searched for together: their terms as numbers of a shared vocabulary."""

    vocabulary: list[bytes]
    #: Terms of query ``q`` are ``places[bounds[q]:bounds[q + 1]]``, each ``counts`` times in it.
    places: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray
    #: Weights of the vocabulary, and the score that a document needs at least, by query.
    weights: np.ndarray | None = None
    least: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def with_weights(self, weights: np.ndarray, least: np.ndarray) -> Block:
        return Block(self.vocabulary, self.places, self.counts, self.bounds, weights, least)


def _block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    words = [[vocabulary.setdefault(w, len(vocabulary)) for w in bytes(r.words).split(b" ")] for r in rows]
    return Block(
        list(vocabulary),
        np.array([p for w in words for p in w], dtype=np.int64),
        np.frombuffer(b"".join(bytes(r.tfs) for r in rows), dtype="<i4").astype(np.int64),
        np.cumsum([0, *map(len, words)]),
    )


@lru_cache(maxsize=1)
def _shared(name: str, block: Broadcast) -> tuple[Block, pa.Array]:
    """Block and vocabulary of all tasks of a Python worker."""
    return block.value, pa.array(block.value.vocabulary, pa.binary())


def _ints(raw: pa.Scalar, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), dtype=kind).astype(np.int64)


def _ends(raw: pa.Scalar) -> np.ndarray:
    """Running sums of 16-bit sizes, from zero."""
    return np.concatenate([[0], np.cumsum(_ints(raw, "<u2"))])


def _lexicons(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every stratum the places of the block's terms in its lexicon, and their numbers."""
    lists = pc.split_pattern(batch.column("terms"), b" ")
    numbers = pc.index_in(lists.flatten(), value_set=vocabulary)
    known = pc.fill_null(numbers, -1).to_numpy()
    offsets = lists.offsets.to_numpy()
    for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
        here = np.flatnonzero(known[a:b] >= 0)
        yield here, known[a:b][here].astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OPEN_STRATA):
            yield batch.slice(at, OPEN_STRATA)


def _document_counts(block: Broadcast, name: str):
    """Task that counts the documents of each query term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vocabulary = _shared(name, block)
        total = np.zeros(len(held.vocabulary), dtype=np.int64)
        for batch in _slices(batches):
            columns = zip(batch.column("term_runs"), batch.column("run_sizes"), _lexicons(batch, vocabulary), strict=True)
            for runs, sizes, (here, terms_here) in columns:
                ends = _ends(sizes)[_ends(runs)]
                total[terms_here] += np.diff(ends)[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    return count


class _Stratum:
    """One row of the index, opened for a block of queries."""

    def __init__(self, row: dict, here: np.ndarray, numbers: np.ndarray, block: Block):
        runs, ends = _ends(row["term_runs"]), _ends(row["run_sizes"])
        self.row, self.runs, self.ends, self.m = row, runs, ends, row["m"].as_py()
        tfs = _ints(row["run_tfs"])
        # An impact is computed once for each tf of the stratum.
        different, which = np.unique(tfs, return_inverse=True)
        self.impacts = ((1_000_000_000 * different) // (1000 * different + 8 * self.m))[which]
        order = np.argsort(numbers)
        self.numbers, self.here = numbers[order], here[order]
        top = np.zeros(len(block.vocabulary), dtype=np.int64)
        top[numbers] = self.impacts[runs[here]] * block.weights[numbers]
        sums = np.concatenate([[0], np.cumsum(top[block.places] * block.counts)])
        #: What a document of this stratum can score at most, by query.
        self.most = sums[block.bounds[1:]] - sums[block.bounds[:-1]]
        self._docs = self._ids = None

    def scores(self, block: Block, q: int) -> np.ndarray:
        """Scores of all documents of the stratum for one query."""
        if self._docs is None:
            self._docs = _ints(self.row["docs"], "<u2")
            self._size = len(self.row["doc_ids"].values)
        part = slice(block.bounds[q], block.bounds[q + 1])
        numbers, counts = block.places[part], block.counts[part]
        at = np.minimum(np.searchsorted(self.numbers, numbers), max(0, len(self.numbers) - 1))
        there = self.numbers[at] == numbers
        slots, numbers, counts = self.here[at[there]], numbers[there], counts[there]
        first, last = self.runs[slots], self.runs[slots + 1]
        each = last - first
        run = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        values = self.impacts[run] * np.repeat(block.weights[numbers] * counts, each)
        a, b = self.ends[run], self.ends[run + 1]
        size = b - a
        posting = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        total = np.zeros(self._size, dtype=np.int64)
        np.add.at(total, self._docs[posting], np.repeat(values, size))
        return total

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and which of them are known."""
        if self._ids is None:
            values = self.row["doc_ids"].values
            self._ids = (pc.fill_null(values, 0).to_numpy().astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False))
        return self._ids


class _Best:
    """The best documents of one query so far, highest first, ties by ascending id (null first)."""

    def __init__(self, least: int):
        self.least = least
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.known = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, stratum: _Stratum) -> None:
        pick = np.flatnonzero(scores >= self.least)
        if not len(pick):
            return
        ids, known = stratum.ids()
        scores, ids, known = (
            np.concatenate(pair) for pair in ((self.scores, scores[pick]), (self.ids, ids[pick]), (self.known, known[pick]))
        )
        order = np.lexsort((ids, known, -scores))[:TOP]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == TOP:
            self.least = max(self.least, int(self.scores[-1]))


def _search(block: Broadcast, name: str, first_only: bool):
    """Task that visits strata for every query and returns its best documents.

    ``visits`` counts the strata whose postings were read for the query.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vocabulary = _shared(name, block)
        n = len(held.least)
        best = [_Best(int(x)) for x in held.least]
        visits, strata_read = np.zeros(n, dtype=np.int64), 0
        visited = np.zeros(n, dtype=np.int64)  # best bound of the strata that the first wave has visited
        for batch in _slices(batches):
            rows = [{c: batch.column(c)[i] for c in _INDEX_NAMES} for i in range(batch.num_rows)]
            strata = [
                _Stratum(row, here, numbers, held)
                for row, (here, numbers) in zip(rows, _lexicons(batch, vocabulary), strict=True)
            ]
            strata_read += len(strata)
            bounds = np.array([s.most for s in strata])
            for q in range(n):
                for s in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[s, q] < best[q].least or first_only and bounds[s, q] <= visited[q]:
                        break
                    visits[q] += 1
                    visited[q] = max(visited[q], bounds[s, q])
                    best[q].add(strata[s].scores(held, q), strata[s])
        size = [len(b.scores) for b in best]
        ids = np.concatenate([b.ids for b in best]) if n else np.zeros(0, dtype=np.int64)
        unknown = ~np.concatenate([b.known for b in best]) if n else np.zeros(0, dtype=bool)
        columns = [
            pa.array(np.repeat(np.arange(n), size), pa.int64()), pa.array(ids, pa.int64(), mask=unknown),
            pa.array(np.concatenate([b.scores for b in best]) if n else ids, pa.int64()),
            pa.array(np.repeat(visits, size), pa.int64()), pa.array(np.full(sum(size), strata_read), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score", "visits", "strata"])

    return search


_FOUND = "query bigint, doc_id bigint, score bigint, visits bigint, strata bigint"


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def _search_block(index: Index, rows: list) -> DataFrame:
    """Best documents of one block of queries: ``query`` (row of the block), ``rank``, ``doc_id``, ``score``."""
    spark, strata = index.strata.df.sparkSession, index.strata.df
    block = _block(rows)
    shared = spark.sparkContext.broadcast(block)
    counted = strata.select("terms", "term_runs", "run_sizes").mapInArrow(_document_counts(shared, block.name), "term bigint, df bigint")
    df = np.zeros(len(block.vocabulary), dtype=np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per term of the block
        df[row.term] = row.df
    n = index.documents
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    weights[df == 0] = 0  # no document holds the term
    least = np.ones(len(rows), dtype=np.int64)
    for first_only in (True, False):
        weighted = block.with_weights(weights, least)
        shared = spark.sparkContext.broadcast(weighted)
        ranked = _ranked(strata.mapInArrow(_search(shared, weighted.name, first_only), _FOUND))
        if first_only:
            for row in ranked.filter(F.col("rank") == TOP).collect():  # one row per query
                least[row.query] = row.score
    return ranked


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Different queries with a term, in blocks of at most ``block_bytes`` of terms (one query at least)."""
    counted = queries.select(F.col("item_id").alias("doc_id"), "text").distinct().mapInArrow(count_terms, _COUNTED)
    sized = counted.withColumn("size", F.length("words").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("words")]
    ranged = range_parts(sized, order)
    placed = store(
        prefix_sums(ranged, order, "size").withColumn("block", F.expr(f"(_end - size) div {block_bytes}")).repartition("block"),
        "queries",
    )
    ranged.drop()
    last = placed.df.agg(F.max("block")).first()[0]
    for block in range((last or 0) + 1):
        rows = placed.df.filter(F.col("block") == block).orderBy("_position").select("doc_id", "words", "tfs").collect()
        if rows:
            yield rows
    placed.drop()


def search(index: Index, queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``TOP`` documents with a positive score of every query: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``queries`` has ``item_id`` and ``text``; repeated rows count once, queries without a term
    or without a match give no row, a null id is kept. Equal scores go by ascending doc_id,
    null first. ``visits`` and ``strata`` tell how many strata the task that found a document
    read for the query, and how many it had.
    """
    spark = queries.sparkSession
    found = None
    for rows in query_blocks(queries, block_bytes):
        names = spark.createDataFrame([(q, r.doc_id) for q, r in enumerate(rows)], "query bigint, item_id bigint")
        # One row per query of the block.
        block = _search_block(index, rows).join(F.broadcast(names), "query")
        block = block.select("item_id", "rank", "doc_id", "score", "visits", "strata")
        found = block if found is None else found.unionByName(block)
    if found is None:
        schema = "item_id bigint, rank int, doc_id bigint, score bigint, visits bigint, strata bigint"
        return spark.createDataFrame([], schema)
    return found


def rank_documents(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Index all documents and answer every query."""
    return search(build_index(docs), queries).select("item_id", "rank", "doc_id", "score")
