"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import remainder

#: Characters of text that the sample of one class holds at most, so that very long texts cannot
#: fill the driver; a text that would exceed it is passed over and the next ones are tried.
SAMPLE_CHARACTERS = 15_000_000


def held_out(divisor: int, value: int):
    """Whether the row's id falls into the part that no label is learned from (null id: no)."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == value, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: dict[int, int]
) -> tuple[list[str | None], list[int]]:
    """Whole texts and labels of at most ``per_class`` documents of each class.

    Rows of the held-out fold, without an id or without a label of 0 or 1 are left out; of
    the rest the first by hash of doc_id are taken. An id labelled twice counts by its larger
    label; of an id's rows one is kept, on the executors, by the smallest text. Each class has
    its own bound of ``SAMPLE_CHARACTERS``, so long texts of one class leave the other whole.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(*fold))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for value, most in per_class.items():
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # At most the sum of ``per_class`` rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    texts, marks, held = [], [], dict.fromkeys(per_class, 0)
    for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size = len(row.text or "")
        if held[row.label] + size > SAMPLE_CHARACTERS:
            continue
        texts.append(row.text)
        marks.append(row.label)
        held[row.label] += size
    return texts, marks
