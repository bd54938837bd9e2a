"""Registered queries of the market half: sources, quality, paper bets, logs, streams."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import digests, names, poisson, policy
from tallyfield.functions.odds import expected_return, rating
from tallyfield.operators import feeds, logs, market, paper, projections, quality
from tallyfield.plans.catalog import query, rounded
from tallyfield.session import materialize, shared_dir
from tallyfield.sources import odds_json, season_files, tables
from tallyfield.streaming import ingest, keyed

NOW = datetime(1998, 1, 1)


def fresh_dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def joined(column: str):
    return F.array_join(column, ";")


# --- sources --------------------------------------------------------------------------


def _landed(spark, sf) -> tuple[str, DataFrame]:
    root = fresh_dir(spark, "seasons")
    stats = materialize(tables.player_stats(tables.player_games(spark, sf)))
    seasons = [r.season for r in stats.select("season").distinct().collect()]  # a season list
    loader = lambda dataset, season: stats.filter(F.col("season") == season)
    return root, season_files.fetch(spark, root, "player_stats", seasons, loader)


STATS = ["player_id", "season", "week", "recent_team", "receptions", "targets"]


@query
def fetch_or_cache(spark, sf):
    root, first = _landed(spark, sf)
    seasons = [r.season for r in first.select("season").distinct().collect()]  # a season list

    def never(dataset, season):
        raise AssertionError("the cache was complete")

    return season_files.fetch(spark, root, "player_stats", seasons, never).select(*STATS)


@query
def read_season_parquet(spark, sf):
    root, _ = _landed(spark, sf)
    return season_files.read_seasons(spark, root, "player_stats", [1973, 1974]).select(*STATS)


@query
def read_csv_inferred(spark, sf):
    path = fresh_dir(spark, "csv")
    tables.schedules(tables.player_games(spark, sf)).write.option("header", "true").csv(path)
    return season_files.read_csv(spark, path, [1973, 1974]).select(
        "season", "week", "game_id", F.col("gameday").cast("date").alias("gameday"), "home_team", "away_team"
    )


@query
def union_schema_drift(spark, sf):
    stats = tables.player_stats(tables.player_games(spark, sf))
    old = stats.filter("season <= 1973").select(*STATS[:4], F.col("receptions").cast("int").alias("receptions"))
    new = stats.filter("season > 1973").select(*STATS)
    return season_files.union_by_name([old, new])


@query
def build_file_manifest(spark, sf):
    """Files of a season dataset, written as a manifest and loaded by its hash; a row per season.

    ``whole`` tells that the bytes read are those of the files, ``reproduced`` that a second
    reading in smaller ranges gives the same digests and hash.
    """
    root, _ = _landed(spark, sf)
    where = fresh_dir(spark, "manifest")
    season_files.write_manifest(season_files.file_manifest(spark, root, ["player_stats"]), where)
    manifest = season_files.load_manifest(spark, where)
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        ranges = materialize(season_files.range_digests(spark, root))
        again = season_files.file_digests(ranges).select(F.col("digest").alias("_again"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    read = ranges.groupBy("file").agg(F.sum("bytes").alias("_read"), F.max("file_bytes").alias("_size"))
    whole = read.select(F.regexp_extract("file", r"season=(\d+)", 1).cast("int").alias("season"), (F.col("_read") - F.col("_size")).alias("_off"))
    files = manifest.join(again.distinct(), F.col("digest") == F.col("_again"), "left")
    seasons = files.groupBy("dataset", "season").agg(
        F.sum("rows").alias("rows"), F.array_join(F.first("columns"), ";").alias("columns"), F.bool_and(F.col("_again").isNotNull()).alias("reproduced")
    )
    return seasons.join(whole.groupBy("season").agg(F.bool_and(F.col("_off").isin(0, 1)).alias("whole")), "season")


@query
def verify_manifest(spark, sf):
    root, rows = _landed(spark, sf)
    before = materialize(season_files.file_manifest(spark, root, ["player_stats"]))
    season_files.fetch(
        spark, root, "player_stats", [1974], lambda d, s: rows.filter("season = 1974").withColumn("week", F.col("week") + 1), force=True
    )
    changed = season_files.verify_manifest(before, season_files.file_manifest(spark, root, ["player_stats"]))
    return changed.select("dataset", F.regexp_extract("path", r"season=(\d+)", 1).cast("int").alias("season")).distinct()


@query
def flatten_odds_json(spark, sf):
    return odds_json.flatten_odds(tables.payloads(spark, sf))


@query
def append_snapshot_jsonl(spark, sf):
    path = fresh_dir(spark, "snapshots")
    offers = materialize(odds_json.flatten_odds(tables.payloads(spark, sf)))  # parsed once for both snapshots
    odds_json.append_snapshot(offers.filter("side = 'over'"), path)
    odds_json.append_snapshot(offers.filter("side = 'under'"), path)
    return spark.read.schema(offers.schema).json(path)


def _offers(spark, sf) -> DataFrame:
    q = tables.quotes(spark, sf)
    return q.select(
        F.col("quote_id").alias("offer_id"),
        F.col("batch").alias("batch_id"),
        F.lit("feed").alias("provider"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("game").alias("event_name"),
        F.col("captured_at").alias("commence_time"),
        F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("bookmaker"),
        "market",
        F.concat(F.lit("Player "), F.col("player_id").cast("string"), F.lit(" Jr.")).alias("player"),
        "side",
        "line",
        "american_odds",
        "captured_at",
    )


def _players(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Known players and aliases: some by own alias, some by another feed's, some in conflict."""
    n = tables.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("n")).distinct()
    name = F.concat(F.lit("player "), F.col("n").cast("string"))
    players = n.filter("n % 2 = 0").select(F.col("n").alias("player_id"), name.alias("name"))
    alias = lambda rows, provider, offset: rows.select(
        F.lit(provider).alias("provider"), name.alias("normalized_alias"), (F.col("n") + offset).alias("player_id")
    )
    aliases = alias(n.filter("n % 3 = 0"), "feed", 1_000_000)
    aliases = aliases.unionByName(alias(n.filter("n % 5 = 0"), "other", 2_000_000))
    return players, aliases.unionByName(alias(n.filter("n % 35 = 0"), "third", 3_000_000))


@query
def resolve_alias(spark, sf):
    offers = _offers(spark, sf).withColumn("raw_name", F.col("player"))
    return feeds.resolve_alias(offers, *_players(spark, sf))


@query
def persist_offers(spark, sf):
    facts = feeds.persist_offers(_offers(spark, sf), *_players(spark, sf))["quotes"]
    rows = facts.select("quote_id", "player_id", "book_id", "market", "side", "line", "fair_market_probability")
    return rounded(rows, "fair_market_probability")


def _persisted(spark, sf, name: str) -> DataFrame:
    return feeds.persist_offers(_offers(spark, sf), *_players(spark, sf))[name]


@query
def persisted_players(spark, sf):
    return _persisted(spark, sf, "players")


@query
def persisted_aliases(spark, sf):
    return _persisted(spark, sf, "aliases")


@query
def persisted_books(spark, sf):
    return _persisted(spark, sf, "books")


@query
def persisted_events(spark, sf):
    return _persisted(spark, sf, "events")


@query
def refused_offers(spark, sf):
    return _persisted(spark, sf, "violations")


def _star(spark, sf) -> DataFrame:
    part = tables.table(spark, sf, "part")
    players = part.filter("p_partkey % 10 = 0").select(
        F.floor(F.col("p_partkey") / 10).alias("player_id"), F.col("p_name").alias("player_name")
    )
    events = part.filter("p_partkey % 40 = 0").select(
        F.floor(F.col("p_partkey") / 40).alias("event_id"), F.col("p_brand").alias("event_name")
    )
    books = tables.table(spark, sf, "supplier").filter("s_suppkey < 8").select(
        F.col("s_suppkey").alias("book_id"), F.col("s_name").alias("book_name")
    )
    return feeds.star_join(tables.quotes(spark, sf), events, players, books)


STAR = ["quote_id", "event_name", "player_name", "book_name", "market", "side", "line", "american_odds", "captured_at"]


@query
def star_join(spark, sf):
    return _star(spark, sf).select(*STAR)


@query
def list_quotes(spark, sf):
    return feeds.newest(_star(spark, sf), ["captured_at", "quote_id"], 100, side="under").select(*STAR)


@query
def quote_history(spark, sf):
    return feeds.newest(
        _star(spark, sf), ["captured_at", "quote_id"], 200, market="player_receptions", side="over"
    ).select(*STAR)


@query
def limit_page(spark, sf):
    return feeds.newest(tables.quotes(spark, sf), ["captured_at", "quote_id"], 500).select("quote_id", "captured_at")


@query
def list_jobs(spark, sf):
    rows = feeds.newest(tables.fetch_attempts(spark, sf), ["ended_at", "attempt_id"], 100, succeeded=False)
    return rows.select("provider", "attempt_id", "ended_at", "latency_ms")


@query
def list_recommendations(spark, sf):
    rows = feeds.newest(tables.bets(spark, sf), ["placed_at", "bet_id"], 100, rating="WATCH")
    return rows.select("bet_id", "player_id", "market", "expected_value", "placed_at")


@query
def list_bets(spark, sf):
    rows = feeds.newest(tables.bets(spark, sf), ["placed_at", "bet_id"], 100, status="CLOSED")
    return rows.select("bet_id", "player_id", "stake", "status", "placed_at")


@query
def provider_health(spark, sf):
    return rounded(feeds.provider_health(tables.fetch_attempts(spark, sf)), "average_latency_ms")


@query
def list_health(spark, sf):
    return provider_health(spark, sf).orderBy("provider")


# --- quality --------------------------------------------------------------------------


@query
def normalize_nullable_float(spark, sf):
    props = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 13 == 0, "n/a").when(F.col("event_id") % 17 == 0, "Infinity").otherwise(props)
    rows = tables.table(spark, sf, "events").select(text.alias("share"), F.col("value").cast("string").alias("value"))
    return quality.nullable_float_violations(rows, {"share": (5.0, 90.0), "value": (0.0, None)})


def _flagged(spark, sf) -> DataFrame:
    return quality.flag_offers(tables.raw_offers(spark, sf), NOW)


@query
def flag_offers(spark, sf):
    return _flagged(spark, sf).select(
        "payload_id", "record_index", "reject_category", joined("warnings").alias("warnings"), "normalized_name"
    )


@query
def quality_flags(spark, sf):
    return quality.quality_flags(_flagged(spark, sf))


@query
def dedupe_contracts(spark, sf):
    return _flagged(spark, sf).filter("reject_category is null").select("payload_id", "record_index")


@query
def alias_variation(spark, sf):
    rows = tables.raw_offers(spark, sf).withColumn("normalized_name", names.normalize_name(F.col("player")))
    flagged = quality.alias_variation(rows, ["payload_id", "normalized_name"], "player", "record_index")
    return flagged.select("payload_id", "record_index", "alias_changed")


@query
def snapshot_unique(spark, sf):
    key = ["event_id", "player_id", "book_id", "market", "side", "line", "american_odds", "captured_at"]
    quotes = tables.quotes(spark, sf).withColumn("player_id", F.col("player_id") % 5).withColumn("event_id", F.lit(1))
    return quality.snapshot_unique(quotes).select(*key)


@query
def normalize_entities(spark, sf):
    words = tables.table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    # Copies collapse before names are normalised.
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    rows = counted.withColumn("normalized", names.normalize_name(F.col("word")))
    return rows.groupBy("normalized").agg(F.sum("n").alias("occurrences"))


@query
def normalize_names(spark, sf):
    raw = F.concat(F.lit("J. R. "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " Jr.").otherwise(" III"))
    rows = tables.table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", names.normalize_name(F.col("raw")).alias("normalized"), names.book_key(F.col("raw")).alias("book_key"))


@query
def redact_secrets(spark, sf):
    text = F.concat(F.lit("GET /odds?API-KEY="), F.md5("event_type"), F.lit("&user="), "user_id", F.lit(" props "), "props")
    return tables.table(spark, sf, "events").select("event_id", names.redact_secrets(text).alias("message"))


@query
def side_market_maps(spark, sf):
    rows = tables.raw_offers(spark, sf)
    return rows.groupBy(
        odds_json.mapped(odds_json.MARKET_MAP, F.col("market")).alias("market"),
        odds_json.mapped(odds_json.SIDE_MAP, F.lower("side")).alias("side"),
    ).agg(F.count("*").alias("offers"))


# --- projections and recommendations --------------------------------------------------


def _requests(spark, sf) -> DataFrame:
    """A projection request on every quote."""
    lines = tables.table(spark, sf, "lineitem")
    quotes = lines.withColumns({"quote_id": tables.quote_id(), "captured_at": F.col("l_shipdate")})
    part = lambda i: F.col({1: "l_orderkey", 3: "l_partkey", 4: "l_suppkey"}[i])  # numbers of the id
    share = lambda c, m: 0.3 + (c % m) / F.lit(100.0)
    shift = lambda c: F.make_dt_interval(mins=c.cast("int"))
    return quotes.select(
        F.col("quote_id").alias("request_id"),
        "quote_id",
        (0.2 + (part(3) % 61) / F.lit(100.0)).alias("model_probability"),
        (F.col("captured_at") - shift(part(1) % 120)).alias("input_captured_at"),
        (F.col("captured_at") + shift(part(3) % 7)).alias("decided_at"),
        share(part(1), 71).alias("data_quality"),
        share(part(3), 71).alias("sample_size"),
        share(part(4), 71).alias("role_stability"),
        share(part(1), 53).alias("injury_certainty"),
        share(part(3), 53).alias("matchup_certainty"),
        share(part(4), 53).alias("market_stability"),
    )


DECIDED = [
    "request_id",
    "american_odds",
    "implied_probability",
    "expected_return",
    "overall_confidence",
    "data_age_seconds",
    "rating",
    "rejection_reasons",
    "rationale",
]


@query
def recommend(spark, sf):
    quotes = tables.quotes(spark, sf).select("quote_id", "american_odds", F.col("captured_at").alias("quote_captured_at"))
    rows = paper.recommend(_requests(spark, sf).join(quotes, "quote_id"))
    rows = rows.withColumn("rejection_reasons", joined("rejection_reasons")).select(*DECIDED)
    return rounded(rows, "implied_probability", "expected_return", "overall_confidence")


@query
def project_and_recommend(spark, sf):
    rows = paper.project_and_recommend(_requests(spark, sf), tables.quotes(spark, sf), columns=["request_id"])
    rows = rows.withColumn("rejection_reasons", joined("rejection_reasons"))
    rows = rows.select(*DECIDED, "best_quote_id", "recommended_stake")
    return rounded(rows, "implied_probability", "expected_return", "overall_confidence")


@query
def expected_value(spark, sf):
    rows = tables.quotes(spark, sf).withColumn(
        "model_probability", (F.col("player_id") % 100) / F.lit(100.0)
    )
    ev = expected_return(F.col("model_probability"), F.col("american_odds"))
    return rounded(rows.select("quote_id", "model_probability", ev.alias("expected_return"), rating(ev).alias("rating")), "expected_return")


@query
def confidence(spark, sf):
    rows = _requests(spark, sf).select("request_id", policy.confidence().alias("overall_confidence"))
    return rounded(rows, "overall_confidence")


@query
def stale_gate(spark, sf):
    return ingest.stale_gate(tables.quotes(spark, sf), datetime(1998, 1, 1, 0, 50)).select(
        "quote_id", "data_age_seconds", "freshness"
    )


@query
def score_count_lines(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    rows = li.select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_quantity") / 7).alias("rate"),
        (F.col("l_linenumber") - F.when(F.col("l_partkey") % 2 == 0, 0.5).otherwise(0.0)).alias("line"),
    )
    return rounded(
        projections.score_lines(rows), "rate", "over_probability", "under_probability", "push_probability"
    )


@query
def poisson_over(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    rate = F.col("l_quantity") / 7
    return li.groupBy(F.col("l_quantity").alias("quantity")).agg(
        F.count("*").alias("rows"), F.round(F.avg(poisson.over_fixed_line(rate, 4.5)), 6).alias("over_probability")
    )


@query
def data_age_seconds(spark, sf):
    rows = _requests(spark, sf)
    age = policy.data_age_seconds(F.col("decided_at"), F.col("input_captured_at"))
    return rows.select("request_id", age.alias("data_age_seconds"))


@query
def project_receptions(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    rows = li.select(
        "l_orderkey",
        "l_partkey",
        (25 + F.col("l_linenumber")).cast("double").alias("projected_team_pass_attempts"),
        (F.col("l_discount") + 0.5).alias("route_participation"),
        (F.col("l_tax") + 0.15).alias("targets_per_route_run"),
        F.lit(0.65).alias("catch_probability"),
        (F.col("l_linenumber") - F.when(F.col("l_partkey") % 2 == 0, 0.5).otherwise(0.0)).alias("line"),
        F.create_map(F.lit("weather"), F.lit(0.5), F.lit("pace"), F.lit(1.5)).alias("contextual_multipliers"),
    )
    out = projections.project_receptions(rows).select(
        "l_orderkey",
        "l_partkey",
        "line",
        "projected_targets",
        "projected_receptions",
        "floor",
        "median",
        "ceiling",
        "over_probability",
        "under_probability",
        "push_probability",
    )
    return rounded(out, *out.columns[3:5], *out.columns[8:])


# --- paper bets -----------------------------------------------------------------------


@query
def opening_quote(spark, sf):
    quotes = tables.quotes(spark, sf)
    return market.opening_quote(quotes, quotes).select("quote_id", "opening_line", "opening_odds")


def _bet_requests(spark, sf) -> tuple[DataFrame, DataFrame]:
    bets = tables.bets(spark, sf)
    fresh = bets.filter("status = 'ACTIVE'").select(
        F.col("bet_id").alias("request_id"),
        "player_id",
        "event_id",
        "market",
        "side",
        (F.col("stake") / 10).cast("decimal(10,2)").alias("stake"),
        "placed_at",
    )
    return fresh, bets.filter("status <> 'ACTIVE'")


@query
def duplicate_open_bet(spark, sf):
    return paper.duplicate_open_bets(*_bet_requests(spark, sf)).select("request_id")


@query
def correlation_flags(spark, sf):
    rows = paper.correlation_flags(*_bet_requests(spark, sf))
    return rows.select("request_id", joined("correlation_flags").alias("correlation_flags"))


@query
def exposure_rejections(spark, sf):
    fresh, bets = _bet_requests(spark, sf)
    rows = paper.with_open_exposure(fresh, bets)
    rows = paper.with_weekly_exposure(rows, bets)
    zero = policy.money("0")
    reasons = policy.exposure_rejections(
        F.col("stake") * 4, F.col("weekly_open"), F.coalesce("player_open", zero), F.coalesce("event_open", zero)
    )
    return rows.select("request_id", joined(reasons).alias("rejections"))


#: Caps wide enough that a few dozen requests are admitted and every cap refuses some.
WIDE = policy.Policy(single_cap="50.00", weekly_cap="800.00", player_cap="70.00", event_cap="90.00")


@query
def place_bets(spark, sf):
    placed = paper.place_bets(*_bet_requests(spark, sf), datetime(2001, 8, 1), WIDE)
    return placed.select(
        "request_id", "accepted", joined("rejections").alias("rejections"), joined("correlation_flags").alias("flags")
    )


@query
def bet_rows(spark, sf):
    """Bets of the admitted requests with the opening quote of their series."""
    fresh, bets = _bet_requests(spark, sf)
    known = tables.bets(spark, sf).select(F.col("bet_id").alias("request_id"), "book_id", "line", "american_odds")
    placed = paper.place_bets(fresh, bets, datetime(2001, 8, 1), WIDE).join(known, "request_id")
    quotes = tables.bets(spark, sf).filter("status <> 'SETTLED'").select(
        F.col("bet_id").alias("quote_id"), "player_id", "event_id", "market", "side", "book_id",
        (F.col("line") - 1).alias("line"), F.lit(120).alias("american_odds"), F.col("placed_at").alias("captured_at"),
    )
    quotes = quotes.withColumn("side", F.when(F.col("quote_id") % 3 == 0, "none").otherwise(F.col("side")))
    rows = paper.bet_rows(placed, quotes)
    return rows.select("request_id", "stake", "line", "american_odds", "opening_line", "opening_odds", "status")


@query
def exposures(spark, sf):
    return paper.exposures(tables.bets(spark, sf))


@query
def stake_allocation(spark, sf):
    rows = tables.bets(spark, sf).withColumn("requested_stake", F.col("stake"))
    return paper.stake_allocation(rows, at="placed_at", identity="bet_id").select("bet_id", "recommended_stake")


@query
def clv(spark, sf):
    rows = paper.closing_line_value(tables.bets(spark, sf)).select(
        "bet_id", "line_movement", "price_movement", "beat_closing_line", "clv_percentage"
    )
    return rounded(rows, "line_movement", "price_movement", "clv_percentage")


@query
def settle_book(spark, sf):
    return paper.settle(tables.bets(spark, sf)).select("bet_id", "outcome", "net_profit")


@query
def bet_state(spark, sf):
    bets = tables.bets(spark, sf)
    closings = bets.filter("closing_odds is not null").select("bet_id")
    closings = closings.unionAll(closings.filter("bet_id % 13 = 0"))
    settlements = bets.filter("outcome is not null").select("bet_id")
    settlements = settlements.unionAll(settlements.filter("bet_id % 17 = 0"))
    rows = paper.bet_state(bets, closings, settlements)
    return rows.select("bet_id", "status", joined("violations").alias("violations"))


@query
def performance_total(spark, sf):
    rows = paper.performance_total(tables.bets(spark, sf))
    return rounded(rows, "roi", "average_expected_value", "average_clv", "clv_hit_rate")


@query
def performance_by(spark, sf):
    return rounded(paper.performance_by(tables.bets(spark, sf)), "roi")


@query
def max_drawdown(spark, sf):
    return paper.max_drawdown(tables.bets(spark, sf))


# --- digests and logs -----------------------------------------------------------------


@query
def digest_table(spark, sf):
    return digests.table_digest(tables.quotes(spark, sf))


@query
def payload_hash(spark, sf):
    offers = tables.raw_offers(spark, sf)
    return ingest.payload_hash(offers, ["payload_id"])


@query
def namespaced_digest(spark, sf):
    events = tables.table(spark, sf, "events")
    return events.select("event_id", digests.namespaced_digest("events.v1", F.col("props")).alias("digest"))


@query
def duplicate_batch(spark, sf):
    rows = feeds.duplicate_batches(tables.feed_batches(spark, sf))
    return rows.select("provider", "batch_id", "duplicate_suppressed", "row_count")


@query
def versioned_log(spark, sf):
    events = tables.table(spark, sf, "events")
    entries = events.select(
        F.col("user_id").alias("stream"),
        F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("idempotency_key"),
        F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("content"),
        F.col("ts").alias("appended_at"),
        F.col("event_id").alias("entry_id"),
    )
    return logs.versioned_log(entries)


def _log_entries(spark, sf) -> DataFrame:
    events = tables.table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("stream"),
        F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("idempotency_key"),
        F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("content"),
        F.col("ts").alias("appended_at"),
        F.col("event_id").alias("entry_id"),
    )


@query
def append_log(spark, sf):
    """Two appends to a stored log, the second repeating a part of the first, which is then sent again."""
    entries, path = _log_entries(spark, sf), fresh_dir(spark, "log")
    first = entries.filter("entry_id % 2 = 0")
    logs.append_log(first, path, "first")
    second = logs.append_log(entries.filter("entry_id % 2 = 1 or entry_id % 10 = 0"), path, "second")
    again = logs.append_log(first, path, "first").filter("entry_id % 10 <> 0")
    return second.unionByName(again).select("entry_id", "stream", "idempotency_key", "outcome", "version")


@query
def log_gaps(spark, sf):
    log = logs.versioned_log(_log_entries(spark, sf)).filter("outcome = 'APPENDED'")
    return logs.log_gaps(log.filter("version % 7 <> 3 and version % 11 <> 4"))


def _id_part(i: int, column: str, quote_id: Column | None = None) -> Column:
    """The ``i``-th number of a quote's id; read from its column where the id names all four."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    whole = reduce(lambda a, b: a & b, [F.col(n) >= 0 for n in names])
    spelt = F.split_part(tables.quote_id() if quote_id is None else quote_id, F.lit("-"), F.lit(i)).cast("long")
    return F.when(whole, F.col(column).cast("long")).otherwise(spelt)


def _candidates(spark, sf) -> DataFrame:
    li = tables.table(spark, sf, "lineitem")
    parts = {1: "l_orderkey", 2: "l_linenumber", 3: "l_partkey", 4: "l_suppkey"}
    q = li.withColumn("quote_id", tables.quote_id()).select(
        "quote_id",
        F.col("l_shipdate").alias("captured_at"),
        *[_id_part(i, c, F.col("quote_id")).alias(f"_part{i}") for i, c in parts.items()],
    )
    part = lambda i: F.col(f"_part{i}")
    digit7 = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 7, "0"))
    scores = {
        "CAPABILITY_FIT": digit7((part(1) * 7919 + part(3)) % 10_000_000),
        "LATENCY_OBJECTIVE": digit7((part(3) * 104_729 + part(4)) % 10_000_000),
        "LOAD_BALANCE": F.lit("1"),
    }
    return q.select(
        part(1).alias("request_id"),
        F.col("quote_id").alias("worker_id"),
        F.lit("org").alias("request_organization_id"),
        F.when(part(4) % 11 == 0, "elsewhere").otherwise("org").alias("organization_id"),
        F.lit("ctx").alias("request_workload_context_id"),
        F.lit("ctx").alias("workload_context_id"),
        F.col("quote_id").alias("reference"),
        F.col("quote_id").alias("digest"),
        F.lit(logs.READINESS_VERSION).alias("schema_version"),
        F.col("captured_at").alias("expires_at"),
        F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz").alias("evaluation_boundary"),
        (part(3) % 5 != 0).alias("ready"),
        F.array(F.lit("a"), F.lit("b")).alias("required_capabilities"),
        F.when(part(2) == 5, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("capabilities"),
        F.when(part(3) % 13 == 0, F.lit(None)).otherwise(part(3) % 7 != 0).alias("hard_policy_pass"),
        (part(4) % 23 != 0).alias("evidence_consistent"),
        F.date_trunc("month", "captured_at").cast("timestamp_ntz").alias("evaluated_at"),
        F.struct(*[c.alias(k) for k, c in scores.items()]).alias("scores"),
    )


@query
def score_candidates(spark, sf):
    return logs.score_candidates(_candidates(spark, sf)).select(
        "request_id", "worker_id", "eligible", joined("exclusion_reasons").alias("exclusion_reasons"), "score", "rank"
    )


@query
def selection_outcomes(spark, sf):
    rows = _candidates(spark, sf)
    reasons = logs.exclusion_reasons()
    rows = rows.withColumn("exclusion_reasons", reasons).withColumn("eligible", F.size("exclusion_reasons") == 0)
    return logs.selection_outcomes(rows)


@query
def replay_verify(spark, sf):
    recorded = materialize(selection_outcomes(spark, sf))
    changed = F.when(F.col("request_id") % 11 == 0, F.col("excluded") + 1).otherwise(F.col("excluded"))
    again = selection_outcomes(spark, sf).filter("request_id % 7 <> 0").withColumn("excluded", changed)
    rows = logs.replay_verify(recorded, again, "request_id", ["outcome", "candidates", "excluded"])
    return rows.select("request_id", F.col("recomputed_digest").isNull().alias("missing"))


@query
def validity_gate(spark, sf):
    orders = tables.table(spark, sf, "orders")
    key = F.col("c_custkey")
    days = lambda c: F.make_dt_interval(days=c.cast("int"))
    start = F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz")
    leases = tables.table(spark, sf, "customer").select(
        key.alias("lease_id"),
        (key % 19 != 0).alias("bounded"),
        (start + days(key % 500)).alias("effective_at"),
        (start + days(500 + key % 2000)).alias("expires_at"),
        (key % 29 == 0).alias("revoked"),
    )
    readiness = orders.select(
        F.col("o_custkey").alias("lease_id"),
        (F.col("o_orderdate") + days(F.lit(1500))).alias("ready_expires_at"),
        (F.col("o_orderkey") % 97 == 0).alias("superseded"),
    )
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("lease_id"), F.col("o_orderdate").alias("instant")
    )
    rows = logs.validity_gate(requests, leases, readiness)
    return rows.select("request_id", "outcome", joined("reasons").alias("reasons"))


@query
def evidence_reference_check(spark, sf):
    orders = tables.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = orders.select(
        key.alias("request_id"),
        (F.col("o_custkey") % 10).alias("scope"),
        *[F.concat(F.lit(f"{k}-"), key.cast("string")).alias(f"{k}_reference") for k in ("plan", "selection")],
        *[F.md5("o_orderstatus").alias(f"{k}_digest") for k in ("plan", "selection")],
    )
    plan = orders.filter("o_orderkey % 10 <> 3").select(
        (F.col("o_custkey") % 10).alias("scope"),
        F.concat(F.lit("plan-"), key.cast("string")).alias("reference"),
        F.when(key % 17 == 0, "tampered").otherwise(F.md5("o_orderstatus")).alias("digest"),
    )
    selection = orders.select(
        F.when(key % 23 == 0, 99).otherwise(F.col("o_custkey") % 10).alias("scope"),
        F.concat(F.lit("selection-"), key.cast("string")).alias("reference"),
        F.md5("o_orderstatus").alias("digest"),
    )
    selection = selection.unionAll(selection.filter("substring(reference, -2, 2) = '19'"))
    rows = logs.evidence_reference_check(base, {"plan": plan, "selection": selection})
    return rows.select("request_id", joined("violations").alias("violations"))


# --- streams --------------------------------------------------------------------------


#: How late a tenth of the rows arrive, how late a row may be, and how long a silent key is remembered.
LATE, DELAY, MEMORY = 20, "30 days", 10_000
ARRIVALS = 4
#: Files of a slice at most, all of one micro-batch.
SLICE_FILES = 64


def arriving(rows: DataFrame, at: str, identity: str, out: str, run) -> None:
    """Land a table in ``ARRIVALS`` slices of time and run a stream after each, from its checkpoint.

    About a tenth of the rows of the last ``LATE`` days of a slice arrive with the next one. The table
    is cut in one pass; a slice lands by renaming its folder.
    """
    spark = rows.sparkSession
    day = F.unix_date(F.col(at).cast("date"))
    first, last = rows.agg(F.min(day), F.max(day)).first()
    width = (last - first) // (ARRIVALS - 1) + 1
    slot = F.floor((day - first) / width).cast("int")
    late = (day - first - slot * width >= width - LATE) & (F.pmod(F.xxhash64(identity), F.lit(10)) == 0)
    landed = rows.withColumn("slot", slot + late.cast("int")).coalesce(SLICE_FILES)
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, ARRIVALS + 1)  # so that nothing is sorted by slice
    try:
        landed.write.partitionBy("slot").parquet(f"{out}/slices")
    finally:
        spark.conf.set(writers, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(out).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder(f"{out}/landing"))
    for k in range(ARRIVALS):
        if files.exists(folder(f"{out}/slices/slot={k}")) and not files.rename(folder(f"{out}/slices/slot={k}"), folder(f"{out}/landing/{k}")):
            raise OSError(f"slice {k} cannot land in {out}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", SLICE_FILES).option("recursiveFileLookup", "true")
        run(stream.parquet(f"{out}/landing"))


@query
def stream_movement(spark, sf):
    out = fresh_dir(spark, "movement")
    quotes = tables.quotes(spark, sf).select(*market.SERIES, "quote_id", "captured_at", "line", "american_odds")
    go = lambda s: ingest.stream_movement(s, f"{out}/moves", f"{out}/checkpoint", DELAY, MEMORY).awaitTermination()
    arriving(quotes, "captured_at", "quote_id", out, go)
    return ingest.directions(spark.read.parquet(f"{out}/moves")).select("quote_id", "direction")


@query
def stream_provider_health(spark, sf):
    out = fresh_dir(spark, "health")
    attempts = tables.fetch_attempts(spark, sf)
    go = lambda s: ingest.stream_provider_health(s, f"{out}/health", f"{out}/checkpoint", DELAY).awaitTermination()
    arriving(attempts, "ended_at", "attempt_id", out, go)
    rows = keyed.newest_health(spark.read.parquet(f"{out}/health"))
    return rounded(rows.select(*feeds.HEALTH_COLUMNS), "average_latency_ms")


@query
def stream_suppress_unchanged(spark, sf):
    out = fresh_dir(spark, "suppress")
    batches = tables.feed_batches(spark, sf)
    go = lambda s: ingest.stream_suppress_unchanged(s, f"{out}/placed", f"{out}/checkpoint", DELAY, MEMORY).awaitTermination()
    arriving(batches, "captured_at", "batch_id", out, go)
    return ingest.suppressed(spark.read.parquet(f"{out}/placed")).select("provider", "batch_id", "duplicate_suppressed", "row_count")


def polls_of(li: DataFrame) -> DataFrame:
    """One poll per order line: a single offer, sometimes broken, sometimes a failed fetch."""
    q = tables.quotes_of(li)
    number = F.split_part("quote_id", F.lit("-"), F.lit(4)).cast("long")
    offer = F.struct(
        F.lit("E").alias("event_id"),
        F.lit("game").alias("event_name"),
        F.lit(None).cast("timestamp_ntz").alias("commence_time"),
        F.lit("Book").alias("bookmaker"),
        "market",
        F.lit("A Player").alias("player"),
        "side",
        F.when(number % 37 == 0, -1.0).otherwise(F.col("line")).alias("line"),
        "american_odds",
    )
    failed = number % 41 == 0
    return q.select(
        F.concat(F.lit("feed-"), F.col("player_id").cast("string")).alias("provider"),
        F.col("quote_id").alias("poll_id"),
        "captured_at",
        F.lit(10.0).alias("latency_ms"),
        F.lit(1).alias("attempts"),
        F.when(failed, "TIMEOUT").alias("error_category"),
        F.when(failed, "deadline api_key=abc passed").alias("error_message"),
        F.when(~failed, F.array(offer)).alias("offers"),
    )


def _ingested(spark, sf, run) -> tuple[DataFrame, str]:
    """Audit rows of all polls and the folder of what ``run`` wrote beside them."""
    out = fresh_dir(spark, "ingest")

    def go(polls: DataFrame) -> None:
        ingest.stream_decisions(polls, f"{out}/decisions", f"{out}/checkpoint/decisions", DELAY, MEMORY).awaitTermination()
        run(polls, out)

    arriving(polls_of(tables.table(spark, sf, "lineitem")), "captured_at", "poll_id", out, go)
    return ingest.audit_of(spark.read.parquet(f"{out}/decisions")), out


@query
def stream_offers(spark, sf):
    flags = lambda polls, out: ingest.stream_flags(polls, out, f"{out}/checkpoint/flags", NOW).awaitTermination()
    audit, out = _ingested(spark, sf, flags)
    offers = ingest.accepted_offers(spark.read.parquet(f"{out}/valid"), audit)
    return offers.select("poll_id", "market", "side", "line", "american_odds")


@query
def ingest_audit(spark, sf):
    audit, _ = _ingested(spark, sf, lambda polls, out: None)
    return audit.select("poll_id", "provider", "status", "error_category", "error_message", "row_count")


@query
def stream_snapshot_unique(spark, sf):
    """Quotes of a stream without repeats: every seventh arrives twice, at once or with the next slice."""
    out = fresh_dir(spark, "unique")
    quotes = tables.quotes(spark, sf)
    again = quotes.filter("crc32(quote_id) % 7 = 0").withColumn("quote_id", F.concat(F.lit("again-"), "quote_id"))

    def go(stream: DataFrame) -> None:
        ingest._to_table(ingest.stream_snapshot_unique(stream, DELAY), f"{out}/quotes", f"{out}/checkpoint").awaitTermination()

    arriving(quotes.unionByName(again), "captured_at", "quote_id", out, go)
    kept = spark.read.parquet(f"{out}/quotes")
    columns = ["event_id", "player_id", "book_id", "market", "side", "line", "american_odds"]
    return kept.select(*columns, F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query
def movement_pages(spark, sf):
    points = market.movement_points(market.movement_direction(tables.quotes(spark, sf)))
    pages = market.movement_pages(points, 5)
    return pages.select(*market.SERIES, "page_no", F.size("points").alias("points"), joined(F.transform("points", lambda p: p["direction"])).alias("directions"))
