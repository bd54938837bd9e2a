"""Content digests that do not depend on row order or partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMBS, _LIMB_DIGITS = 4, 15


def row_digest(columns: list[str], field: Callable[[str], Column] | None = None) -> Column:
    """SHA-256 of the row as compact JSON with sorted column names; ``field`` gives its columns."""
    field = field or (lambda c: F.col(f"`{c}`"))
    fields = F.struct(*[field(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _limbs(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + i * _LIMB_DIGITS, _LIMB_DIGITS), 16, 10).cast("decimal(20,0)") for i in range(_LIMBS)]


def _of_sums(rows: Column, sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(":", rows.cast("string"), *[s.cast("string") for s in sums]), 256)


def namespaced_digest(namespace: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(namespace + "\n"), text), 256)


def group_digest(rows: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Digest and row count of each group.

    The row digests are summed limb by limb and the sums are hashed: a multiset hash that
    combines map-side, so a huge group or many copies of a row never meet in one task.
    """
    parts = rows.select(*groups, row_digest(columns).alias("_d"))
    parts = parts.select(*groups, *[limb.alias(f"_l{i}") for i, limb in enumerate(_limbs(F.col("_d")))])
    sums = parts.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(f"_l{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"_l{i}") for i in range(_LIMBS)],
    )
    digest = _of_sums(F.col("rows"), [F.col(f"_l{i}") for i in range(_LIMBS)])
    return sums.select(*groups, digest.alias("digest"), "rows")


def array_digest(rows: Column, columns: list[str]) -> Column:
    """``group_digest`` of the structs of one array."""
    digests = F.transform(rows, lambda r: row_digest(columns, r.getField))
    zero = F.lit(0).cast("decimal(38,0)")
    start = F.struct(*[zero.alias(f"l{i}") for i in range(_LIMBS)])
    add = lambda total, d: F.struct(
        *[(total[f"l{i}"] + limb).cast("decimal(38,0)").alias(f"l{i}") for i, limb in enumerate(_limbs(d))]
    )
    return F.aggregate(digests, start, add, lambda t: _of_sums(F.size(rows), [t[f"l{i}"] for i in range(_LIMBS)]))


def table_digest(rows: DataFrame) -> DataFrame:
    """Digest of a whole table: its schema and its rows."""
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(rows.schema, key=lambda f: f.name))
    body = group_digest(rows, [], rows.columns)
    return body.select(F.sha2(F.concat(F.lit(schema + "\n"), "digest"), 256).alias("digest"), "rows")
