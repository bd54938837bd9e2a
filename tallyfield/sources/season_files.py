"""Season-partitioned dataset files: reading, caching, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.digests import table_digest
from tallyfield.operators.quality import ContractError, check_season
from tallyfield.sources.contracts import CONTRACTS, Contract

FIRST_SEASON, LAST_SEASON = 1920, 2100


def dataset_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{dataset}"


def _season_path(root: str, dataset: str, season: int) -> str:
    return f"{dataset_path(root, dataset)}/season={season}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union of drifted schemas: absent columns become null, types are promoted.

    Spark widens numeric types itself; where text meets another type, text wins.
    """
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for f in frame.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    text = [n for n, found in kinds.items() if "string" in found and len(found) > 1]
    aligned = [f.withColumns({c: F.col(c).cast("string") for c in text if c in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def read_seasons(spark: SparkSession, root: str, dataset: str, seasons) -> DataFrame | None:
    """All requested seasons, or None when one of them is not there."""
    if any(not _exists(spark, _season_path(root, dataset, s)) for s in seasons):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(dataset_path(root, dataset))
    wanted = rows.filter(F.col("season").isin(*[int(s) for s in seasons]))
    _validate(wanted, CONTRACTS[dataset], seasons)
    return wanted


def read_csv(spark: SparkSession, path: str, seasons=None, schema=None) -> DataFrame:
    """CSV with a given schema, or with inferred types and dates; optional season filter."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true").option("inferDate", "true")
    rows = reader.csv(path)
    return rows if seasons is None else rows.filter(F.col("season").isin(*[int(s) for s in seasons]))


def _validate(rows: DataFrame, contract: Contract, seasons) -> None:
    contract.check(rows)
    facts = check_season(rows, seasons).first()
    if not facts.valid:
        raise ContractError(f"{contract.name}: wanted seasons {sorted(seasons)}, found {facts.asDict()}")


def fetch(spark: SparkSession, root: str, dataset: str, seasons, loader, force: bool = False) -> DataFrame:
    """Cached seasons if complete; otherwise load, validate and replace just those partitions."""
    seasons = [int(s) for s in seasons]
    if any(not FIRST_SEASON <= s <= LAST_SEASON for s in seasons):
        raise ContractError(f"seasons must be in {FIRST_SEASON}..{LAST_SEASON}")
    contract = CONTRACTS[dataset]
    if not force:
        cached = read_seasons(spark, root, dataset, seasons)
        if cached is not None:
            return cached
    frames = []
    for season in seasons:
        loaded = loader(dataset, season)
        contract.check(loaded)
        frames.append(loaded if "season" in loaded.columns else loaded.withColumn("season", F.lit(season)))
    rows = union_by_name(frames)
    _validate(rows, contract, seasons)
    keys = [k for k in contract.sort_keys if k in rows.columns and k != "season"]
    sorted_rows = rows.repartitionByRange("season", *keys).sortWithinPartitions("season", *keys)
    (
        sorted_rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("season")
        .parquet(dataset_path(root, dataset))
    )
    return read_seasons(spark, root, dataset, seasons)


#: A file's digest is a polynomial in this base over the SHA-256 of its lines, modulo this prime.
_PRIME = (1 << 255) - 19
_BASE = int.from_bytes(hashlib.sha256(b"line polynomial").digest(), "big") % _PRIME


def _range_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per byte range: its lines, bytes and polynomial; a range is read as a stream."""
    now, lines, size, value = None, 0, 0, 0

    def row() -> pa.RecordBatch:
        columns = [*now, lines, size, value.to_bytes(32, "big")]
        return pa.RecordBatch.from_pylist([dict(zip(_RANGES.names, columns, strict=True))], schema=_RANGES)

    for batch in batches:
        for path, start, length, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "file_bytes", "line")), strict=True):
            if (path, start, length) != now:
                if now is not None:
                    yield row()
                now, lines, size, value = (path, start, length), 0, 0, 0
            value = (value * _BASE + int.from_bytes(hashlib.sha256(line).digest(), "big")) % _PRIME
            lines += 1
            size += len(line) + 1
    if now is not None:
        yield row()


_RANGES = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("file_bytes", pa.int64()), ("lines", pa.int64()), ("bytes", pa.int64()), ("value", pa.binary())]
)


def range_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest of every byte range of the Parquet files under ``path``, each read by a task of its own.

    Spark cuts the files; the lines between line feeds that begin in a range belong to it, so
    no task holds more than a line of a file, whatever the file's size and store.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("lineSep", "\n")
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("value").cast("binary").alias("line"),
    )
    return lines.mapInArrow(_range_digests, "file string, start long, file_bytes long, lines long, bytes long, value binary")


def file_digests(ranges: DataFrame) -> DataFrame:
    """``file``, ``bytes`` and ``digest`` of every file: the same wherever the file was cut.

    The polynomial of two neighbouring ranges is that of the first, shifted by the lines of the
    second, plus that of the second. A file has as many rows here as ranges.
    """

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows, value, lines = rows.sort_values("start"), 0, 0
        for part, n in zip(rows["value"], rows["lines"], strict=True):
            value = (value * pow(_BASE, int(n), _PRIME) + int.from_bytes(part, "big")) % _PRIME
            lines += int(n)
        size = int(rows["file_bytes"].iloc[0])
        digest = hashlib.sha256(f"{size}:{lines}:{value:x}".encode()).hexdigest()
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "bytes": [size], "digest": [digest]})

    return ranges.groupBy("file").applyInPandas(combine, "file string, bytes long, digest string")


def file_manifest(spark: SparkSession, root: str, datasets) -> DataFrame:
    """One row per file: dataset, season, relative path, content digest, bytes, rows and columns."""
    parts = []
    base = root.rstrip("/") + "/"
    for dataset in datasets:
        path = dataset_path(root, dataset)
        rows = spark.read.option("mergeSchema", "true").parquet(path)
        counts = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        joined = file_digests(range_digests(spark, path)).join(counts, "file", "left")
        parts.append(
            joined.select(
                F.lit(dataset).alias("dataset"),
                F.regexp_extract("file", r"season=(\d+)", 1).try_cast("int").alias("season"),
                F.substring_index(F.url_decode("file"), base.lstrip("/"), -1).alias("path"),
                "digest",
                "bytes",
                F.coalesce("rows", F.lit(0)).alias("rows"),
                F.array(*[F.lit(c) for c in rows.columns]).alias("columns"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


#: What a manifest's hash covers; the time of its capture is left out.
HASHED = ["dataset", "season", "path", "digest", "bytes", "rows", "columns"]


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One row: ``manifest_hash`` over all files, whatever their order, and their number."""
    return table_digest(manifest.select(*HASHED)).select(F.col("digest").alias("manifest_hash"), F.col("rows").alias("files"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Store the files' rows and, last, their hash; without the hash a manifest is not read."""
    manifest.select(*HASHED).write.parquet(f"{path}/files")
    stored = manifest.sparkSession.read.parquet(f"{path}/files")
    facts = manifest_hash(stored).withColumn("captured_at", F.current_timestamp())
    facts.coalesce(1).write.json(f"{path}/hash")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, or an error where they do not have the stored hash."""
    rows = spark.read.parquet(f"{path}/files")
    recorded = spark.read.schema("manifest_hash string, files long").json(f"{path}/hash").first()
    found = manifest_hash(rows).first()
    if recorded is None or tuple(recorded) != tuple(found):
        raise ContractError(f"{path}: the manifest does not have its hash")
    return rows


def verify_manifest(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Files that changed, appeared or went missing since the manifest was written."""
    key = ["dataset", "path"]
    a = recorded.select(*key, F.col("digest").alias("recorded_digest"))
    b = recomputed.select(*key, F.col("digest").alias("found_digest"))
    both = a.join(b, key, "full_outer")
    return both.filter(~F.col("recorded_digest").eqNullSafe(F.col("found_digest")))


def changed_ranges(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Byte ranges of two equally cut listings of ``range_digests`` that differ."""
    key = ["file", "start"]
    a = recorded.select(*key, F.col("value").alias("recorded"))
    both = a.join(recomputed.select(*key, F.col("value").alias("found")), key, "full_outer")
    return both.filter(~F.col("recorded").eqNullSafe(F.col("found"))).select(*key)
