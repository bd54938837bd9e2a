import json
import os
from datetime import datetime, timedelta

from conftest import same_rows
from pyspark.sql import functions as F

from pyspark.sql import Window

from tallyfield.functions.digests import array_digest
from tallyfield.operators import feeds, market, quality
from tallyfield.sources import tables
from tallyfield.streaming import ingest, keyed

NOW = datetime(2024, 1, 10, 12)


def offer(player="A. B. Smith", **over):
    row = dict(
        event_id="e1",
        event_name="X at Y",
        commence_time="2024-01-10T20:00:00",
        bookmaker="Book One",
        market="player_receptions",
        player=player,
        side="over",
        line=4.5,
        american_odds=-110,
    )
    return row | over


def test_ingest_polls_end_to_end(spark, tmp_path):
    polls = [
        dict(provider="p", poll_id="1", captured_at="2024-01-10T10:00:00", latency_ms=10.0, attempts=1, offers=[offer(), offer(line=5.5)]),
        dict(provider="p", poll_id="2", captured_at="2024-01-10T10:15:00", latency_ms=20.0, attempts=1, offers=[offer(line=5.5), offer()]),
        dict(
            provider="p",
            poll_id="3",
            captured_at="2024-01-10T10:30:00",
            latency_ms=30.0,
            attempts=1,
            offers=[offer(), offer("AB Smith"), offer(american_odds=50), offer(market="rushing"), offer(line=-1.0), offer("  ")],
        ),
        dict(provider="p", poll_id="4", captured_at="2024-01-10T10:45:00", latency_ms=5.0, attempts=3, error_category="TIMEOUT", error_message="GET ?apikey=abc&x=1"),
        dict(provider="q", poll_id="5", captured_at="2024-01-10T10:45:00", latency_ms=5.0, attempts=1, offers=[offer(american_odds=0)]),
    ]
    for i, poll in enumerate(polls):
        (tmp_path / "landing").mkdir(exist_ok=True)
        target = tmp_path / "landing" / f"{i}.json"
        target.write_text(json.dumps(poll))
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    out = str(tmp_path / "out")
    stream = ingest.read_polls(spark, str(tmp_path / "landing"), files_per_batch=1)
    ingest.stream_offers(stream, out, str(tmp_path / "ckpt"), NOW)
    trail = ingest.audit_of(spark.read.parquet(f"{out}/decisions"))
    audit = {r.poll_id: r for r in trail.collect()}
    assert [audit[str(i)].status for i in range(1, 6)] == ["SUCCESS", "DUPLICATE_SUPPRESSED", "SUCCESS", "FAILED", "FAILED"]
    assert audit["2"].row_count == 0 and audit["3"].row_count == 1
    assert audit["4"].error_message == "GET ?apikey=[REDACTED]&x=1" and audit["5"].error_category == "DATA_QUALITY"
    flags = {(r.poll_id, r.record_index, r.category) for r in spark.read.parquet(f"{out}/flags").collect()}
    assert flags == {
        ("3", 1, "PLAYER_ALIAS_VARIATION"),
        ("3", 1, "DUPLICATE_CONTRACT"),
        ("3", 2, "INVALID_ODDS"),
        ("3", 3, "UNSUPPORTED_MARKET"),
        ("3", 4, "IMPOSSIBLE_LINE"),
        ("3", 5, "MISSING_PLAYER_NAME"),
        ("5", 0, "INVALID_ODDS"),
    }
    assert ingest.accepted_offers(spark.read.parquet(f"{out}/valid"), trail).count() == 3
    health = {r.provider: r for r in keyed.newest_health(spark.read.parquet(f"{out}/health")).collect()}
    assert (health["p"].status, health["p"].successful_fetches, health["p"].average_latency_ms) == ("DEGRADED", 3, 20.0)
    assert (health["q"].status, health["q"].average_latency_ms) == ("DEGRADED", 5.0)


def test_array_checks_equal_the_row_checks(spark):
    """Validity and hash of a payload's array are those of its exploded rows."""
    offers = [
        offer(), offer("AB Smith"), offer(line=None), offer(line=None), offer("Mike Doe", bookmaker="book ONE"), offer("michael doe"),
        offer(american_odds=50), offer(market="x"), offer(" "), offer(side=None), offer(player=None), offer(line=float("nan")), offer(event_id="e2"),
    ]
    schema = "poll_id string, offers array<struct<event_id:string,event_name:string,commence_time:string,bookmaker:string,market:string,player:string,side:string,line:double,american_odds:int>>"
    rows = [(str(k), [tuple(o[c] for c in offer()) for o in offers[k:] + offers[:k]]) for k in range(len(offers))] + [("none", [])]
    polls = spark.createDataFrame(rows, schema)
    valid = quality.valid_offers(F.col("offers"))
    got = polls.select("poll_id", F.size(valid).cast("long").alias("n"), array_digest(valid, ingest.PAYLOAD_FIELDS).alias("hash"))
    exploded = polls.select("poll_id", F.posexplode("offers").alias("record_index", "o")).select("poll_id", "record_index", "o.*")
    flagged = quality.flag_offers(exploded, NOW, payload="poll_id").filter("reject_category is null")
    want = ingest.payload_hash(flagged, ["poll_id"]).select("poll_id", F.col("rows").alias("n"), F.col("payload_hash").alias("hash"))
    same_rows(got.filter("n > 0"), want)
    assert got.filter("poll_id = 'none'").first().n == 0


def in_arrivals(spark, df, folder, arrivals, run):
    """Land the rows of each arrival and run the stream after it, from its checkpoint."""
    for condition in arrivals:
        df.filter(condition).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).awaitTermination()


def test_movement_stream_equals_batch(spark, sf, tmp_path):
    """Several micro-batches and restarts, a quarter of the rows late: the result is that of one sort."""
    quotes = tables.quotes(spark, sf).withColumn("player_id", F.col("player_id") % 3).withColumn("event_id", F.lit(1))
    quotes = quotes.withColumn("_part", F.ntile(3).over(Window.orderBy(*market.ARRIVAL))).withColumn(
        "_part", F.col("_part") + (F.pmod(F.xxhash64("quote_id"), F.lit(4)) == 0).cast("int")
    )
    out = str(tmp_path / "out")
    go = lambda s: ingest.stream_movement(s, out, str(tmp_path / "ckpt"), "3000 days", 10_000)
    in_arrivals(spark, quotes, str(tmp_path), [f"_part = {k}" for k in (1, 2, 3, 4)], go)
    moves = spark.read.parquet(out)
    assert moves.count() > quotes.count()  # some quotes were placed again
    same_rows(ingest.directions(moves).select("quote_id", "direction"), market.movement_direction(quotes).select("quote_id", "direction"))


def test_watermark_drops_and_timer_forgets(spark, tmp_path):
    day = datetime(2031, 1, 1)
    rows = [("a", 0, 0.0), ("b", 10, 1.0), ("late", 9, 2.0), ("too late", 1, 9.0), ("c", 11, 3.0), ("other", 400, 0.0), ("d", 401, 4.0)]
    df = spark.createDataFrame(
        [(n, 1 if n != "other" else 2, day + timedelta(days=d), x) for n, d, x in rows], "quote_id string, k int, captured_at timestamp_ntz, line double"
    )
    placed = lambda s: keyed.with_predecessor(s, ["k"], "captured_at", "quote_id", ["line"], "2 days", 30)
    go = lambda s: ingest._to_table(placed(s), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    in_arrivals(spark, df, str(tmp_path), ["quote_id in ('a', 'b')", "quote_id in ('late', 'too late', 'c')", "quote_id = 'other'", "quote_id = 'd'"], go)
    got = {r.quote_id: r.prev_line for r in keyed.newest_placement(spark.read.parquet(str(tmp_path / "out")), ["quote_id"], "quote_id").collect()}
    assert got == {"a": None, "late": 0.0, "b": 2.0, "c": 1.0, "other": None, "d": None}


def health_by_hand(rows):
    state = {}
    for provider, _, at, good, latency, records in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state.setdefault(provider, dict(n=0, avg=0.0, fails=0, status=None))
        if good:
            s["avg"] = (s["avg"] * s["n"] + latency) / (s["n"] + 1)
            s["n"], s["fails"], s["status"] = s["n"] + 1, 0, "HEALTHY"
        else:
            s["fails"] += 1
            s["status"] = "DOWN" if s["fails"] >= 3 else "DEGRADED"
            if s["n"] == 0:
                s["avg"] = latency
    return {p: (s["status"], s["n"], s["fails"], round(s["avg"], 6)) for p, s in state.items()}


def test_provider_health_batch_and_stream(spark, tmp_path):
    rows = [
        (f"p{i % 4}", i, NOW + timedelta(minutes=i), (i * 7919) % 10 > 5 and i % 4 != 3, float(i % 13), i % 5) for i in range(120)
    ]
    schema = "provider string, attempt_id int, ended_at timestamp_ntz, succeeded boolean, latency_ms double, records long"
    df = spark.createDataFrame(rows, schema)
    as_map = lambda d: {
        r.provider: (r.status, r.successful_fetches, r.consecutive_failures, round(r.average_latency_ms, 6)) for r in d.collect()
    }
    want = health_by_hand(rows)
    assert as_map(feeds.provider_health(df)) == want
    out = str(tmp_path / "out")
    go = lambda s: ingest.stream_provider_health(s, out, str(tmp_path / "ckpt"), "1 day")
    parts = ["attempt_id % 5 <> 0 and attempt_id < 60", "attempt_id % 5 = 0", "attempt_id % 5 <> 0 and attempt_id >= 60"]
    in_arrivals(spark, df, str(tmp_path), parts, go)
    assert as_map(keyed.newest_health(spark.read.parquet(out))) == want


def test_health_folds_failures_behind_the_watermark(spark, tmp_path):
    rows = [("p", i, NOW + timedelta(hours=i), False, 1.0, 0) for i in range(5)] + [("p", 9, NOW + timedelta(hours=9), True, 3.0, 7)]
    rows += [("p", 8, NOW + timedelta(hours=8, minutes=30), False, 1.0, 0), ("p", 10, NOW + timedelta(hours=10), False, 1.0, 0)]
    df = spark.createDataFrame(rows, "provider string, attempt_id int, ended_at timestamp_ntz, succeeded boolean, latency_ms double, records long")
    out = str(tmp_path / "out")
    go = lambda s: ingest.stream_provider_health(s, out, str(tmp_path / "ckpt"), "1 hour")
    in_arrivals(spark, df, str(tmp_path), ["attempt_id < 3", "attempt_id between 3 and 4", "attempt_id = 9", "attempt_id = 8", "attempt_id = 10"], go)
    fails = [r.consecutive_failures for r in spark.read.parquet(out).orderBy("attempts").collect()]
    assert max(fails) == 5 and fails[-3:] == [0, 0, 1]


def test_three_failures_are_down(spark):
    df = spark.createDataFrame(
        [("p", i, NOW + timedelta(minutes=i), False, 1.0, 0) for i in range(3)],
        "provider string, attempt_id int, ended_at timestamp_ntz, succeeded boolean, latency_ms double, records long",
    )
    assert feeds.provider_health(df).first().status == "DOWN"


def test_suppress_stream_equals_batch(spark, tmp_path):
    rows = [(f"p{i % 2}", f"b{i:03d}", NOW + timedelta(minutes=i), f"h{(i // 4) % 3}") for i in range(40)]
    schema = "provider string, batch_id string, captured_at timestamp_ntz, payload_hash string"
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "out")
    go = lambda s: ingest.stream_suppress_unchanged(s, out, str(tmp_path / "ckpt"), "1 day")
    number = F.substring("batch_id", 2, 3).cast("int")
    in_arrivals(spark, df, str(tmp_path), [(number % 3 != 0) & (number < 25), number % 3 == 0, (number % 3 != 0) & (number >= 25)], go)
    got = ingest.suppressed(spark.read.parquet(out))
    same_rows(got, feeds.duplicate_batches(df))
    assert got.filter("duplicate_suppressed").count() > 0


def test_snapshot_unique_stream(spark, tmp_path):
    quotes = spark.createDataFrame(
        [(1, 1, 1, "m", "over", 4.5, -110, NOW, "a"), (1, 1, 1, "m", "over", 4.5, -110, NOW, "b"), (1, 1, 1, "m", "over", None, -110, NOW, "c")],
        "event_id int, player_id int, book_id int, market string, side string, line double, american_odds int, captured_at timestamp_ntz, quote_id string",
    )
    quotes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(quotes.schema).parquet(str(tmp_path / "in"))
    query = (
        ingest.stream_snapshot_unique(stream)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_of_a_table_of_several_files(spark, sf, tmp_path):
    from tallyfield.plans import catalog_market

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog_market.stream_suppress_unchanged(spark, str(tmp_path))
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_keys_share_states(spark, tmp_path):
    """Very many keys cost a bounded number of calls of the engine's state, and do not mix."""
    rows = [(f"q{i:03d}", i % 40, NOW + timedelta(minutes=i), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "quote_id string, k int, captured_at timestamp_ntz, line double")
    progress = []

    def go(stream):
        placed = keyed.with_predecessor(stream, ["k"], "captured_at", "quote_id", ["line"], "1 day", 30, buckets=2)
        query = ingest._to_table(placed, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        progress.append(query)
        return query

    number = F.substring("quote_id", 2, 3).cast("int")
    in_arrivals(spark, df, str(tmp_path), [number % 3 != 1, number % 3 == 1], go)
    got = keyed.newest_placement(spark.read.parquet(str(tmp_path / "out")), ["quote_id"], "quote_id").collect()
    assert {r.quote_id: r.prev_line for r in got} == {q: None if i < 40 else float(i - 40) for i, (q, *_) in enumerate(rows)}
    assert progress[-1].lastProgress.stateOperators[0].numRowsTotal < 40


def test_rows_of_a_bucket_travel_together():
    """A task hands the state one row per bucket, whatever the number of its rows."""
    import pyarrow as pa

    fields = [("k", pa.int64()), ("name", pa.string()), (keyed.AT, pa.int64())]
    schema = pa.schema(fields)
    rows = pa.table({"k": [i % 40 for i in range(900)], "name": [str(i) for i in range(900)], keyed.AT: list(range(899)) + [None]}, schema=schema)
    given = rows.append_column(keyed._BUCKET, pa.array([i % 3 for i in range(900)], pa.int32()))
    packs = list(keyed._packing(schema)(iter(given.to_batches(max_chunksize=100))))
    packed = pa.Table.from_batches(packs)
    assert packed.column(keyed._BUCKET).to_pylist() == [0, 1, 2]
    assert [t.microsecond for t in packed.column(keyed._EVENT).to_pylist()] == [897, 898, 896]
    out = pa.Table.from_batches(keyed._unpacking(schema)(packed.select([keyed._ROWS]).to_batches()))
    assert out.sort_by([("k", "ascending"), (keyed.AT, "ascending")]) == rows.sort_by([("k", "ascending"), (keyed.AT, "ascending")])


def test_last_placement_whether_few_or_many_came_again(spark, monkeypatch):
    rows = [("a", 1.0, None, None, False), ("b", 2.0, 1, "a", False), ("c", 3.0, 1, "a", False), ("c", 3.0, 2, "b", True), ("c", 3.0, 5, "x", True)]
    placed = spark.createDataFrame(rows, f"id string, line double, {keyed.PREV_AT} long, prev_id string, {keyed.AGAIN} boolean")
    for few in (500_000, 1):
        monkeypatch.setattr(keyed, "_FEW_IDS", few)
        got = {r.id: r.prev_id for r in keyed.newest_placement(placed, ["id"], "id").collect()}
        assert got == {"a": None, "b": "a", "c": "x"}


def test_a_single_record_is_not_normalised(spark):
    """Only records that may meet another are normalised and sorted."""
    text = quality.valid_offers(F.col("offers"))._jc.toString()
    assert text.startswith("CASE WHEN <=(size(offers), 1) THEN filter(offers") and "to_json" not in text
