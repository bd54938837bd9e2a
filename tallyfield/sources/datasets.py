"""Published tables: versioned Parquet with a manifest, verified on load; JSON scorecards."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.digests import table_digest
from tallyfield.operators import quality
from tallyfield.plans.registry import FEATURES, table_schema
from tallyfield.session import with_one_row

KEY_ORDER = ("kickoff", "game_id", "source_player_id")


def registry_digest(spark: SparkSession) -> str:
    rows = [(f.name, f.scope, f.kind, f.source, f.window, f.dtype, f.enabled) for f in FEATURES]
    frame = spark.createDataFrame(
        rows, "name string, scope string, kind string, source string, window int, dtype string, enabled boolean"
    )
    return table_digest(frame).first().digest


def write_dataset(rows: DataFrame, root: str, sources: dict[str, str], **facts: str) -> str:
    """Write a new version directory in canonical order and its manifest; returns its path.

    A version counts only once its manifest is there, so a broken write is never read.
    """
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    order = [c for c in KEY_ORDER if c in rows.columns]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/data")
    stored = rows.sparkSession.read.parquet(f"{path}/data")
    seasons = stored.agg(F.sort_array(F.collect_set("season")).alias("seasons"))  # a season list is short
    manifest = with_one_row(table_digest(stored), seasons)
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in sources]).cast("array<string>"),
        F.array(*[F.lit(v) for v in sources.values()]).cast("array<string>"),
    )
    manifest = manifest.withColumns({"source_digests": entries, **{k: F.lit(v) for k, v in facts.items()}})
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return path


def write_training_dataset(training: DataFrame, root: str, source_manifest: str) -> str:
    return write_dataset(training, root, {"manifest": source_manifest}, schema_version="wr-player-game-v1")


def write_feature_dataset(features: DataFrame, root: str, sources: dict[str, str]) -> str:
    differences = quality.schema_differences(features, table_schema())
    if differences:
        raise quality.ContractError(f"feature table: {differences}")
    quality.require(quality.unique_key_violations(features, ["source_player_id", "game_id"]), "feature table", "rows")
    registry = registry_digest(features.sparkSession)
    return write_dataset(
        features, root, sources, schema_version="wr-player-game-features-v1", registry_digest=registry
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifest")


def load_feature_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Read a version and check layout, registry and content against its manifest."""
    rows = spark.read.parquet(f"{path}/data")
    manifest = read_manifest(spark, path).first()
    problems = quality.schema_differences(rows, table_schema())
    if manifest.registry_digest != registry_digest(spark):
        problems.append("registry differs")
    if manifest.digest != table_digest(rows).first().digest:
        problems.append("content differs")
    if problems:
        raise quality.ContractError(f"{path}: {problems}")
    return rows


def check_input_identity(rows: DataFrame, expected_digest: str, expected_registry: str) -> None:
    if table_digest(rows).first().digest != expected_digest:
        raise quality.ContractError("the table differs from the recorded content")
    if registry_digest(rows.sparkSession) != expected_registry:
        raise quality.ContractError("the feature registry differs from the recorded one")


#: Name of the table that ends a version: which tables belong to it, their rows and digests.
MARKER = "_commit"


def write_scorecard(tables: dict[str, DataFrame], root: str) -> str:
    """Publish all result tables of an evaluation together, as JSON in a new version directory.

    The marker is written last, from what the tables read back as. Readers go by the marker, so
    they see all tables of a version or none of it, also when a writer is lost between two.
    """
    path = f"{root.rstrip('/')}/version={uuid.uuid4().hex}"
    facts = []
    for name, table in tables.items():
        table.select(*sorted(table.columns)).write.json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    for name in tables:
        stored = table_digest(spark.read.json(f"{path}/{name}"))
        facts.append(stored.select(F.lit(name).alias("table"), "rows", "digest"))
    marker = reduce(DataFrame.unionByName, facts).withColumn("written_at", F.current_timestamp())
    marker.coalesce(1).write.json(f"{path}/{MARKER}")
    return path


def published(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the markers of all versions under ``root`` that were published whole, with their path."""
    schema = "`table` string, rows long, digest string, written_at timestamp"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version=*/{MARKER}/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    paths = [s.getPath().getParent().toString() for s in found]
    if not paths:
        return spark.createDataFrame([], f"{schema}, path string")
    marked = spark.read.schema(schema).json(paths)
    return marked.withColumn("path", F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), f"^(.*)/{MARKER}/", 1))


def read_scorecard(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of one published version; an error without a marker or where a table differs from it."""
    try:
        marker = spark.read.json(f"{path}/{MARKER}").collect()  # one row per table
    except AnalysisException as error:
        raise quality.ContractError(f"{path} was not published") from error
    tables = {}
    for entry in marker:
        tables[entry["table"]] = spark.read.json(f"{path}/{entry['table']}")
        found = table_digest(tables[entry["table"]]).first()
        if (found.rows, found.digest) != (entry["rows"], entry["digest"]):
            raise quality.ContractError(f"{path}: table {entry['table']} differs from the marker")
    return tables
