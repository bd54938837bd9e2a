"""Near-duplicate vectors by random-hyperplane signs, exact cosine and connected components.

A vector's signs against seeded hyperplanes make one code per table; vectors of one label
whose codes agree in some table are compared by cosine in double precision. Equal vectors
collapse to one class first. A bucket that many classes share is cut into blocks that are
compared pair by pair, each pair is counted only in the first table where it meets, and a
task hands on link counts per class and a spanning forest of its links, so a dense bucket
does not turn into a row for each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.common import store
from tallyfield.llm.components import components
from tallyfield.llm.simhash import forest

THRESHOLD = 0.98
#: At cosine 0.98 a bit agrees with probability 0.936, so a table of 16 bits meets a pair with
#: probability 0.348 and 30 tables miss it with probability 3e-6; closer pairs are missed less.
TABLES, BITS = 30, 16
SEED = 19
#: Classes of a bucket that one block holds.
BLOCK = 512
_ROWS_AT_A_TIME = 8_000


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal length as doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


@lru_cache(maxsize=8)
def _planes(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).normal(size=(width, TABLES * BITS))


def codes_of(rows: np.ndarray) -> np.ndarray:
    """One code per table for each row."""
    signs = (rows @ _planes(rows.shape[1]) >= 0).reshape(len(rows), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(axis=2).astype(np.int32)


def code_column(vector: Column) -> Column:
    """``array<int>`` of table codes of a usable vector."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(vectors: pa.Array) -> pa.Array:
        widths = np.diff(vectors.offsets.to_numpy())
        codes = np.zeros((len(vectors), TABLES), dtype=np.int32)
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            codes[own] = codes_of(unit(matrix(vectors.take(pa.array(own)), int(width))))
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, codes.size + 1, TABLES, dtype=np.int32)), pa.array(codes.ravel(), pa.int32())
        )

    return of(vector)


def _compare(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Link weight per class, and spanning links, of the pairs inside each run of equal ``pair``."""
    key, table = rows["pair"].to_numpy(), rows["slot"].to_numpy()
    own, whole = rows["own"].to_numpy(), rows["whole"].to_numpy()
    class_id, copies = rows["class_id"].to_numpy(), rows["copies"].to_numpy()
    vectors = rows["vector"].combine_chunks()
    widths = np.diff(vectors.offsets.to_numpy())
    codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(len(key), TABLES)
    weight = np.zeros(len(key), dtype=np.int64)
    links_a, links_b, held = [class_id[:0]], [class_id[:0]], 0
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        x = unit(matrix(vectors.take(pa.array(mine)), int(width)))
        here, step = np.arange(len(mine)), 1
        while len(here):
            here = here[here + step < len(mine)]
            here = here[key[mine[here]] == key[mine[here + step]]]
            a, b = mine[here], mine[here + step]
            # Between two different blocks only the pairs across are new.
            new = np.flatnonzero(whole[a] | (own[a] != own[b]))
            near = new[np.einsum("ij,ij->i", x[here[new]], x[here[new] + step]) >= threshold]
            a, b = a[near], b[near]
            first = (codes[a] == codes[b]).argmax(axis=1) == table[a]
            a, b = a[first], b[first]
            np.add.at(weight, a, copies[b])
            np.add.at(weight, b, copies[a])
            links_a.append(class_id[a])
            links_b.append(class_id[b])
            held += len(a)
            if held > 500_000:
                tree = forest(np.concatenate(links_a), np.concatenate(links_b))
                links_a, links_b, held = [tree[0]], [tree[1]], len(tree[0])
            step += 1
    linked, place = np.unique(class_id[weight > 0], return_inverse=True)
    total = np.bincount(place, weights=weight[weight > 0], minlength=len(linked)).astype(np.int64)
    return linked, total, *forest(np.concatenate(links_a), np.concatenate(links_b))


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Link weights and spanning links of stored ``class_id, label, vector, copies, codes``.

    Rows with ``b`` null give ``n``, how many vectors class ``a`` links to; the others link the
    classes ``a`` and ``b``.
    """
    slots = classes.select(
        "class_id", F.size("vector").alias("width"), "label", F.posexplode("codes").alias("slot", "code")
    ).withColumn("bucket", F.xxhash64("label", "width", "slot", "code"))
    shared = slots.groupBy("bucket").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("int")
    met = (
        slots.select("class_id", "slot", "bucket")
        .join(shared, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class_id", "slot", "own", (F.col("own") == F.col("other")).alias("whole"),
            F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
        )
    )
    rows = met.join(classes.select("class_id", "copies", "vector", "codes"), "class_id")
    rows = rows.select("pair", "slot", "own", "whole", "class_id", "copies", "vector", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            linked, weight, a, b = _compare(table, threshold)
            nulls = pa.nulls(len(linked), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(linked), pa.array(a)]),
                    pa.concat_arrays([nulls, pa.array(b)]),
                    pa.concat_arrays([pa.array(weight), pa.nulls(len(a), pa.int64())]),
                ],
                names=["a", "b", "n"],
            )

        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < _ROWS_AT_A_TIME:
                continue
            table = pa.Table.from_batches(waiting)
            key = table["pair"].to_numpy()
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield out(table.slice(0, done))
            rest = table.slice(done)
            waiting, held = rest.to_batches(), rest.num_rows
        if held:
            yield out(pa.Table.from_batches(waiting))

    return rows.repartition(F.col("pair")).sortWithinPartitions("pair").mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; other columns are ignored. Only
    vectors of one label and one length are compared. Rows whose label, id or vector is null
    and vectors that are empty, zero or hold null or non-finite components link with nothing
    and stand alone (a null id has no component and is kept). Copies link with each other,
    repeated rows of one id as well. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    marked = store(rows.select("vec_id", "label", F.when(fit, F.col("vector")).alias("vector")), "vectors")
    grouped = marked.df.filter("vector is not null").groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies")
    )
    # Numbers are given as the table is written, so every later reader sees the same ones.
    numbered = grouped.withColumn("class_id", F.monotonically_increasing_id())
    classes = store(numbered.withColumn("codes", code_column(F.col("vector"))), "classes")
    found = store(link_classes(classes.df, threshold), "links")
    groups = components(found.df.filter("b is not null").select("a", "b"))
    weights = found.df.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = classes.df.select("label", "vector", "copies", F.col("class_id").alias("number"), "least")
    own = own.join(weights, own["number"] == weights["node"], "left").drop("node")
    own = own.join(groups.df, own["number"] == groups.df["node"], "left").select(
        "label", "vector", "copies", "n", "least", F.coalesce("component", "number").alias("root")
    )
    # Both sides are stored, so a root of very many vectors can be split in the join.
    own = store(own, "rooted")
    least = store(own.df.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    result = store(
        own.df.join(least.df, "root").select(
            "label", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        ),
        "vector-groups",
    )
    joined = marked.df.join(result.df, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
