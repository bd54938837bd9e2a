"""SimHash near-duplicates: positional-byte postings, count filter, exact check, components.

A fingerprint has eight bytes. Two fingerprints at four or fewer differing bits share at
least four bytes at the same positions, so the inverted index is over positional bytes, a
pair is retained when its tally of shared bytes reaches four, and the Hamming distance is
then checked. A posting of one byte would hold every 256th fingerprint and the tallies
would grow with the square of the corpus. Each posting here is therefore a triple of
positional bytes, from a family of 20 triples that leaves out no four-byte match: every
four positions of eight contain a triple of the family. Postings hold distinct
fingerprints (copies collapse first), long ones are cut into blocks that are compared pair
by pair, and a task hands on a spanning forest of the links that it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import Stored, lower_words, store
from tallyfield.llm.components import components

SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
SHARED_BYTES = 8 - MAX_DISTANCE
#: Members of a posting that one block holds; a task compares two blocks at a time.
BLOCK = 2048
_ROWS_AT_A_TIME = 200_000


def positional_triples() -> list[tuple[int, int, int]]:
    """Turan's family: classes 0-2, 3-5 and 6-7; a class, or two of one and one of the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    family = [three for group in classes for three in combinations(group, 3)]
    for here, after in zip(classes, classes[1:] + classes[:1], strict=True):
        family += [tuple(sorted((*two, one))) for two in combinations(here, 2) for one in after]
    return sorted(family)


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """64-bit majority of the shingles' XXH64, as a signed number; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[size - 1 :], strict=False) if len(words) >= size else [(0, len(text))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    """Signed 64-bit fingerprint of each text; null and wordless texts have 0."""

    @F.arrow_udf(T.LongType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(lower_words(t.as_py())) for t in batch], pa.int64())

    return of(text)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as ``a``-``b`` do: each value to its group's smallest."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(values))
    while True:
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        open_links = low != high
        if not open_links.any():
            break
        left, right = left[open_links], right[open_links]
        np.minimum.at(parent, high[open_links], low[open_links])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    own = np.flatnonzero(parent != np.arange(len(values)))
    return values[parent[own]], values[own]


def _links_of(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs in each run of equal keys that pass filter and check."""
    kept_a, kept_b, held = [], [], 0
    here = np.arange(len(keys))
    step = 1
    while len(here):
        here = here[here + step < len(keys)]
        here = here[keys[here] == keys[here + step]]
        differing = prints[here] ^ prints[here + step]
        shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        retained = here[shared >= SHARED_BYTES]
        near = np.bitwise_count(prints[retained] ^ prints[retained + step]) <= MAX_DISTANCE
        linked = retained[near]
        if len(linked):
            kept_a.append(prints[linked])
            kept_b.append(prints[linked + step])
            held += len(linked)
            if held > 500_000:
                a, b = forest(np.concatenate(kept_a), np.concatenate(kept_b))
                kept_a, kept_b, held = [a], [b], len(a)
        step += 1
    if not held:
        return prints[:0], prints[:0]
    return forest(np.concatenate(kept_a), np.concatenate(kept_b))


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of every posting block; rows come sorted by block."""

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of(keys, prints)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        rows += batch.num_rows
        if rows < _ROWS_AT_A_TIME:
            continue
        keys, prints = (np.concatenate(x) for x in zip(*waiting, strict=True))
        done = int(np.searchsorted(keys, keys[-1]))
        yield out(keys[:done], prints[:done])
        waiting, rows = [(keys[done:], prints[done:])], len(keys) - done
    if rows:
        yield out(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def link_fingerprints(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a``-``b`` that connect what four-bit links connect.

    ``distinct`` has one long column ``fingerprint`` without repeats. Every pair at four or
    fewer differing bits is joined by a path of returned links, and every returned link
    lies inside such a group.
    """
    value = F.col("fingerprint")
    byte = [F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [
        F.lit(n << 24) + F.shiftleft(byte[i], 16) + F.shiftleft(byte[j], 8) + byte[k]
        for n, (i, j, k) in enumerate(positional_triples())
    ]
    postings = distinct.select(value, F.explode(F.array(*keys)).alias("posting"))
    # Stored, so that the rows of a frequent posting can be split in the join.
    shared = store(postings.groupBy("posting").count().filter("count > 1"), "postings").df
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64(value), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    members = (
        postings.join(shared, "posting")
        .select("posting", value, blocks.alias("_blocks"), own.alias("_own"))
        .select("posting", value, "_own", other.alias("_other"))
        .select(
            # Posting numbers take 29 bits; two hashed block numbers share the rest of a group key.
            F.xxhash64("posting", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("pair"),
            value,
        )
    )
    return members.repartition(F.col("pair")).sortWithinPartitions("pair").mapInArrow(_link_runs, "a long, b long")


def component_of_fingerprints(prints: Stored | DataFrame) -> Stored:
    """``fingerprint``, ``component_id``, ``root`` of stored ``doc_id, fingerprint``.

    ``component_id`` is the smallest doc_id reachable, which several components share if they
    share an id; ``root`` is a fingerprint that a component has for itself.
    """
    rows = prints.df if isinstance(prints, Stored) else prints
    smallest = store(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    groups = components(link_fingerprints(smallest.df.select("fingerprint")))
    joined = smallest.df.join(groups.df, smallest.df["fingerprint"] == groups.df["node"], "left")
    with_root = store(joined.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")), "roots")
    # Both sides are stored, so a root of very many fingerprints can be split in the join.
    of_root = store(with_root.df.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = store(with_root.df.join(of_root.df, "root").select("fingerprint", "component_id", "root"), "print-groups")
    for table in (groups, with_root, of_root):
        table.drop()
    smallest.drop()
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and group of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per
    input row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest doc_id reachable over links of at most four differing bits. Null and wordless
    texts have fingerprint zero and link like any other; a short text is one shingle; very
    long texts are read whole; repeated rows come out repeatedly; a null doc_id stays null
    and is passed over for component_id, which is null only where a group has no id at all.
    An empty table gives an empty table.
    """
    prints = store(docs.select("doc_id", fingerprint_column(F.col("text")).alias("fingerprint")), "doc-prints")
    groups = component_of_fingerprints(prints)
    return prints.df.join(groups.df, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one (the smallest doc_id) for each near-duplicate group.

    Rows are told apart by a number of their own, not by doc_id: rows of one id whose texts
    are not near-duplicates all stay. A row without an id stays only where its group has no
    id; among rows of one id the smallest hash of the text decides, then the row's number.
    """
    numbered = docs.select(
        F.struct("*").alias("_row"),
        F.monotonically_increasing_id().alias("_number"),
        fingerprint_column(F.col("text")).alias("fingerprint"),
    )
    # Written once, so that every reader sees the same numbers.
    rows = store(numbered, "numbered").df
    prints = rows.select(F.col("_row.doc_id").alias("doc_id"), "fingerprint")
    groups = component_of_fingerprints(prints)
    rank = F.struct(
        F.col("_row.doc_id").isNull().alias("no_id"),
        F.col("_row.doc_id").alias("id"),
        F.xxhash64("_row.text").alias("hash"),
        F.col("_number").alias("number"),
    )
    # One row for each fingerprint first, so that many copies do not meet in the join.
    firsts = rows.groupBy("fingerprint").agg(F.min(rank).alias("first"))
    kept = firsts.join(groups.df, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    numbers = kept.select(F.col("first.number").alias("_number"))
    return rows.join(numbers, "_number", "left_semi").select("_row.*")
