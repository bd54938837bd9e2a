import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tallyfield.operators.quality import ContractError
from tallyfield.operators import quality
from tallyfield.sources import datasets, odds_json, season_files, tables
from tallyfield.plans import training
from tallyfield.operators import history

STATS = "season int, week int, player_id string, player_display_name string, position string, receptions double, team string"


def loader(spark, calls, extra=False):
    def load(dataset, season):
        calls.append(season)
        df = spark.createDataFrame([(season, w, f"P{w}", "N", "WR", 1.0, "T") for w in (2, 1)], STATS)
        return df.withColumn("yards", F.lit(3)) if extra and season == 2022 else df

    return load


def test_cache_first_fetch_and_manifest(spark, tmp_path):
    root, calls = str(tmp_path), []
    first = season_files.fetch(spark, root, "player_stats", [2021, 2022], loader(spark, calls, extra=True))
    assert calls == [2021, 2022] and first.count() == 4
    assert {r.season: r.n for r in first.groupBy("season").agg(F.count("yards").alias("n")).collect()} == {2021: 0, 2022: 2}
    season_files.fetch(spark, root, "player_stats", [2022], loader(spark, calls))
    assert calls == [2021, 2022]
    assert season_files.read_seasons(spark, root, "player_stats", [2021, 2023]) is None
    recorded = season_files.file_manifest(spark, root, ["player_stats"])
    kept = spark.createDataFrame(recorded.collect(), recorded.schema)
    assert kept.agg(F.sum("rows")).first()[0] == 4
    assert season_files.verify_manifest(kept, season_files.file_manifest(spark, root, ["player_stats"])).count() == 0
    season_files.fetch(spark, root, "player_stats", [2022], loader(spark, calls), force=True)
    assert season_files.verify_manifest(kept, season_files.file_manifest(spark, root, ["player_stats"])).count() >= 2
    assert season_files.read_seasons(spark, root, "player_stats", [2021]).count() == 2


def test_a_changed_byte_is_found_wherever_the_file_is_cut(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 2 + 2021).alias("season"), F.md5(F.col("id").cast("string")).alias("text"))
    rows.coalesce(1).write.partitionBy("season").parquet(str(tmp_path / "stats"))
    path, key = str(tmp_path / "stats"), "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(key), []
    file = sorted((tmp_path / "stats" / "season=2022").glob("*.parquet"))[0]
    try:
        for size in ("64m", "20k", "7001"):
            spark.conf.set(key, size)
            ranges = season_files.range_digests(spark, path)
            seen.append((ranges.count(), {r.file: r.digest for r in season_files.file_digests(ranges).collect()}))
        kept = spark.createDataFrame(ranges.collect(), ranges.schema)
        raw = bytearray(file.read_bytes())
        raw[300_000] ^= 1
        file.write_bytes(bytes(raw))
        (file.parent / f".{file.name}.crc").unlink()
        changed = season_files.changed_ranges(kept, season_files.range_digests(spark, path)).collect()
    finally:
        spark.conf.set(key, before)
    assert seen[0][1] == seen[1][1] == seen[2][1] and seen[0][0] < seen[1][0] < seen[2][0]
    assert len(changed) == 1 and 300_000 - 2 * 7001 < changed[0].start <= 300_000


def test_manifest_hash_guards_the_rows(spark, tmp_path):
    root = str(tmp_path / "root")
    season_files.fetch(spark, root, "player_stats", [2021, 2022], loader(spark, []))
    manifest = season_files.file_manifest(spark, root, ["player_stats"])
    season_files.write_manifest(manifest, str(tmp_path / "one"))
    season_files.write_manifest(season_files.file_manifest(spark, root, ["player_stats"]).repartition(3), str(tmp_path / "two"))
    hashes = [spark.read.json(str(tmp_path / k / "hash")).first().manifest_hash for k in ("one", "two")]
    assert hashes[0] == hashes[1]
    loaded = season_files.load_manifest(spark, str(tmp_path / "one"))
    assert {r.season: r.rows for r in loaded.groupBy("season").agg(F.sum("rows").alias("rows")).collect()} == {2021: 2, 2022: 2}
    assert all(r.path.startswith("player_stats/season=") and len(r.digest) == 64 and "yards" not in r.path for r in loaded.collect())
    loaded.withColumn("rows", F.col("rows") + 1).write.parquet(str(tmp_path / "forged"))
    import shutil

    shutil.copytree(tmp_path / "one" / "hash", tmp_path / "bad" / "hash")
    shutil.copytree(tmp_path / "forged", tmp_path / "bad" / "files")
    with pytest.raises(ContractError):
        season_files.load_manifest(spark, str(tmp_path / "bad"))


def test_fetch_rejects_bad_input(spark, tmp_path):
    with pytest.raises(ContractError):
        season_files.fetch(spark, str(tmp_path), "player_stats", [1900], loader(spark, []))
    with pytest.raises(ContractError):
        season_files.fetch(spark, str(tmp_path), "player_stats", [2021], lambda d, s: loader(spark, [])(d, s).drop("team"))
    with pytest.raises(ContractError):
        season_files.fetch(spark, str(tmp_path), "player_stats", [2021], lambda d, s: loader(spark, [])(d, 2020))


def test_drifted_schemas(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "z")], "x double, y string")
    c = spark.createDataFrame([(7,)], "w int")
    rows = season_files.union_by_name([a, b, c])
    assert [f.dataType.simpleString() for f in rows.schema] == ["double", "string", "int"]
    assert {tuple(r) for r in rows.collect()} == {(1.0, "2", None), (1.5, "z", None), (None, None, 7)}


def test_flatten_drops_unusable_outcomes(spark):
    doc = """{"id":"e","home_team":"H","away_team":"A","commence_time":"2024-01-01T18:00:00Z","bookmakers":[
      {"key":"k","title":"Book","markets":[{"key":"player_receptions","outcomes":[
        {"name":"Over","description":"P","point":4.5,"price":-110},{"name":"Under","description":"P","point":4.5,"price":1.91},
        {"name":"Push","description":"P","point":4.5,"price":100},{"name":"Over","point":4.5,"price":100}]},
        {"key":"h2h","outcomes":[{"name":"Over","description":"P","price":100}]}]},
      {"key":"k2","markets":[{"key":"player_anytime_td","outcomes":[{"name":"Yes","description":"Q","price":250}]}]}]}"""
    rows = odds_json.flatten_odds(spark.createDataFrame([(doc,)], "payload string")).orderBy("bookmaker").collect()
    assert [(r.bookmaker, r.market, r.side, r.line, r.american_odds) for r in rows] == [
        ("Book", "player_receptions", "over", 4.5, -110),
        ("k2", "player_anytime_td", "yes", None, 250),
    ]
    assert rows[0].event_name == "A at H" and rows[0].commence_time.hour == 18


def test_published_features_are_verified(spark, sf, tmp_path):
    games = tables.player_games(spark, sf)
    stats = tables.player_stats(games)
    table = training.build_training_table(stats, tables.schedules(games))
    features = history.build_feature_table(table, stats, strict=False)
    path = datasets.write_feature_dataset(features, str(tmp_path / "out"), {"stats": "abc"})
    assert datasets.load_feature_dataset(spark, path).count() == features.count()
    manifest = datasets.read_manifest(spark, path).first()
    datasets.check_input_identity(spark.read.parquet(f"{path}/data"), manifest.digest, manifest.registry_digest)
    with pytest.raises(ContractError):
        datasets.check_input_identity(spark.read.parquet(f"{path}/data").limit(3), manifest.digest, manifest.registry_digest)
    spark.read.parquet(f"{path}/data").limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ContractError):
        datasets.load_feature_dataset(spark, path)
    with pytest.raises(ContractError):
        datasets.write_feature_dataset(features.drop("rest_days"), str(tmp_path / "out"), {})


def test_float_and_key_checks(spark):
    df = spark.createDataFrame([("0.5", "a"), ("x", "a"), ("NaN", None), ("2", " "), (None, "c"), ("-1", "d")], "v string, k string")
    row = quality.nullable_float_violations(df, {"v": (0.0, 1.0)}).first()
    assert tuple(row) == ("v", 1, 1, 1, 1)
    reasons = {(r.k, r.reason) for r in quality.unique_key_violations(df, ["k"]).collect()}
    assert reasons == {("a", "duplicate_key"), (None, "blank_key"), (" ", "blank_key")}


def test_a_scorecard_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "cards")
    tables = {"one": spark.createDataFrame([(1, "a")], "x int, y string"), "two": spark.range(3)}
    path = datasets.write_scorecard(tables, root)
    tables["one"].write.json(f"{root}/version=lost/one")  # a writer that was lost before its marker
    listed = datasets.published(spark, root)
    assert {(r.table, r.rows) for r in listed.collect()} == {("one", 1), ("two", 3)}
    assert {r.path.removeprefix("file:").replace("//", "/") for r in listed.collect()} == {path}
    assert sorted(r.id for r in datasets.read_scorecard(spark, path)["two"].collect()) == [0, 1, 2]
    with pytest.raises(ContractError):
        datasets.read_scorecard(spark, f"{root}/version=lost")
    spark.range(1).write.mode("append").json(f"{path}/two")
    with pytest.raises(ContractError):
        datasets.read_scorecard(spark, path)
    assert datasets.published(spark, str(tmp_path / "nothing")).count() == 0


def test_snapshots_are_parsed_once(spark, sf, monkeypatch):
    """Both appends read the stored offers; neither parses the payloads again."""
    from tallyfield.plans import catalog_market

    appended, append = [], odds_json.append_snapshot
    monkeypatch.setattr(odds_json, "append_snapshot", lambda offers, path: (appended.append(offers), append(offers, path)))
    rows = catalog_market.append_snapshot_jsonl(spark, sf).count()
    assert len(appended) == 2 and sum(a.count() for a in appended) == rows > 0
    assert not any("from_json" in a._jdf.queryExecution().optimizedPlan().toString() for a in appended)


def test_snapshots_take_little_disk(spark, sf, tmp_path):
    """The appended lines are read back whole and take less than half of their plain size."""
    offers = odds_json.flatten_odds(tables.payloads(spark, sf)).cache()
    for side in ("over", "under"):
        odds_json.append_snapshot(offers.filter(F.col("side") == side), str(tmp_path / "lines"))
    offers.write.json(str(tmp_path / "plain"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert size("lines") < size("plain") / 2
    same_rows(spark.read.schema(offers.schema).json(str(tmp_path / "lines")), offers)
    offers.unpersist()
