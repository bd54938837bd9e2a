"""Domain views derived from the star-schema tables the queries run on.

Identifiers scale with the data (players, events and teams grow with their source keys),
so the number of series grows while their length stays about the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_SECONDS = 43_200
BUCKETS_PER_SEASON = 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def quotes(spark: SparkSession, directory: str) -> DataFrame:
    """Quote snapshots from order lines: who, where, which side, line, price and when."""
    return quotes_of(table(spark, directory, "lineitem"))


def quote_id() -> Column:
    """Id of an order line's quote."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))


def quotes_of(li: DataFrame) -> DataFrame:
    points = F.round(F.col("l_discount") * 1000).cast("int")
    return li.select(
        quote_id().alias("quote_id"),
        F.trunc("l_shipdate", "month").alias("batch"),
        F.floor(F.col("l_partkey") / 40).alias("event_id"),
        F.floor(F.col("l_partkey") / 10).alias("player_id"),
        (F.col("l_suppkey") % 8).alias("book_id"),
        F.when(F.col("l_returnflag") == "A", "player_receptions")
        .when(F.col("l_returnflag") == "N", "player_pass_yds")
        .otherwise("player_pass_tds")
        .alias("market"),
        F.when(F.col("l_linestatus") == "O", "over").otherwise("under").alias("side"),
        F.when(F.col("l_linenumber") % 7 != 0, F.ceil(F.col("l_quantity") / 10) - 0.5).alias("line"),
        F.when(F.col("l_discount") < 0.05, -(110 + points)).otherwise(100 + points).alias("american_odds"),
        F.col("l_shipdate").alias("captured_at"),
    )


def player_games(spark: SparkSession, directory: str) -> DataFrame:
    """One row per player and game from the event stream, with team, opponent and box score."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (BUCKET_SECONDS * 1_000_000))
    totals = (
        table(spark, directory, "events")
        .groupBy("user_id", bucket.alias("bucket"))
        .agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("_value"))
    )
    user, b = F.col("user_id"), F.col("bucket")
    base = F.floor(user / 100) * 4
    team = base + user % 4
    opponent = base + (user % 4).bitwiseXOR(1 + b % 3)
    targets = F.ceil(F.col("_value") / 20).cast("double")
    rows = totals.select(
        "user_id",
        "bucket",
        (b % BUCKETS_PER_SEASON + 1).cast("int").alias("week"),
        F.floor(b / BUCKETS_PER_SEASON).cast("int").alias("season"),
        F.timestamp_seconds(b * BUCKET_SECONDS).cast("timestamp_ntz").alias("kickoff"),
        team.alias("_team"),
        opponent.alias("_opponent"),
        targets.alias("targets"),
    )
    low = F.least("_team", "_opponent")
    name = lambda c: F.concat(F.lit("T"), F.lpad(c.cast("string"), 7, "0"))
    receptions = F.floor(F.col("targets") * 3 / 5).cast("double")
    return rows.select(
        F.concat(F.lit("P"), F.lpad(user.cast("string"), 9, "0")).alias("player_id"),
        F.concat_ws("-", F.lpad(b.cast("string"), 8, "0"), name(low)).alias("game_id"),
        "season",
        "week",
        "kickoff",
        name(F.col("_team")).alias("team"),
        name(F.col("_opponent")).alias("opponent"),
        (F.col("_team") == low).alias("is_home"),
        F.when(user % 5 == 4, "QB").otherwise("WR").alias("position"),
        receptions.alias("receptions"),
        "targets",
        (F.col("targets") * 7).alias("receiving_yards"),
        (F.col("targets") + 1).alias("attempts"),
        receptions.alias("completions"),
        F.when(user % 5 != 0, F.col("targets") / (F.col("targets") + 4)).alias("snap_share"),
    )


def bets(spark: SparkSession, directory: str) -> DataFrame:
    """Paper bets from orders, with closing quotes and settlements where the status has them."""
    o = table(spark, directory, "orders")
    key = F.col("o_orderkey")
    line = F.when(key % 11 != 0, (key % 9) + 0.5)
    settled = F.col("o_orderstatus").isin("F", "P")
    closed = settled | (key % 2 == 0)
    outcome = (
        F.when((F.col("o_orderstatus") == "F") & (key % 2 == 0), "WIN")
        .when(F.col("o_orderstatus") == "F", "LOSS")
        .when((F.col("o_orderstatus") == "P") & (key % 5 == 0), "PUSH")
        .when(F.col("o_orderstatus") == "P", "LOSS")
    )
    return o.select(
        key.alias("bet_id"),
        F.col("o_custkey").alias("player_id"),
        F.floor(F.col("o_custkey") / 4).alias("event_id"),
        (key % 8).alias("book_id"),
        F.col("o_orderpriority").alias("market"),
        F.when(F.floor(key / 2) % 2 == 0, "over").otherwise("under").alias("side"),
        line.alias("line"),
        F.when(key % 3 == 0, 100 + key % 150).otherwise(-(100 + key % 50)).cast("int").alias("american_odds"),
        (F.floor(F.col("o_totalprice") / 100) / 100.0).cast("decimal(10,2)").alias("stake"),
        ((key % 41 - 20) / 100.0).alias("expected_value"),
        F.when(key % 3 == 0, "WATCH").otherwise("BET").alias("rating"),
        F.when(settled, "SETTLED").when(closed, "CLOSED").otherwise("ACTIVE").alias("status"),
        outcome.alias("outcome"),
        F.col("o_orderdate").alias("placed_at"),
        F.when(closed, line + (key % 3) - 1).alias("closing_line"),
        F.when(closed, F.when(key % 4 == 0, 100 + key % 90).otherwise(-(100 + key % 70))).cast("int").alias("closing_odds"),
        F.when(settled, F.col("o_orderdate") + F.make_dt_interval(days=(key % 10).cast("int"))).alias("settled_at"),
    )


def player_stats(games: DataFrame) -> DataFrame:
    """Season statistics in the raw contract's shape."""
    return games.select(
        "season",
        "week",
        F.lit("REG").alias("season_type"),
        "player_id",
        F.concat(F.lit("Mike "), "player_id", F.lit(" Jr.")).alias("player_display_name"),
        "position",
        F.col("team").alias("recent_team"),
        "receptions",
        "targets",
        "receiving_yards",
        "attempts",
        "completions",
    )


def schedules(games: DataFrame) -> DataFrame:
    """One row per game in the raw contract's shape."""
    home = F.when(F.col("is_home"), F.col("team")).otherwise(F.col("opponent"))
    away = F.when(F.col("is_home"), F.col("opponent")).otherwise(F.col("team"))
    return games.select(
        "season",
        "week",
        F.lit("REG").alias("game_type"),
        "game_id",
        F.date_format("kickoff", "yyyy-MM-dd").alias("gameday"),
        F.date_format("kickoff", "HH:mm").alias("gametime"),
        home.alias("home_team"),
        away.alias("away_team"),
    ).dropDuplicates(["season", "week", "game_id"])


def snap_counts(games: DataFrame) -> DataFrame:
    """Optional usage input: snap share per player and game."""
    return games.select(F.col("player_id").alias("source_player_id"), "game_id", "snap_share")


def fetch_attempts(spark: SparkSession, directory: str) -> DataFrame:
    """Feed attempts from the event stream; error events are failed fetches."""
    return attempts_of(table(spark, directory, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("feed-"), F.col("user_id").cast("string")).alias("provider"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").alias("ended_at"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("records"),
    )


def feed_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Snapshot batches per feed; the payload hash stands for the event type."""
    return batches_of(table(spark, directory, "events"))


def batches_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("feed-"), F.col("user_id").cast("string")).alias("provider"),
        F.col("event_id").alias("batch_id"),
        F.col("ts").alias("captured_at"),
        F.md5("event_type").alias("payload_hash"),
        F.get_json_object("props", "$.k").cast("long").alias("row_count"),
    )


def raw_offers(spark: SparkSession, directory: str) -> DataFrame:
    """Unchecked offers: quotes with some broken records, grouped in payloads by ship month."""
    li = table(spark, directory, "lineitem")
    q = quotes_of(li)
    tail = F.substring("quote_id", -1, 1)
    number = F.split_part("quote_id", F.lit("-"), F.lit(4)).cast("long")
    return q.select(
        F.date_format("batch", "yyyy-MM").alias("payload_id"),
        F.col("quote_id").alias("record_index"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("event_name"),
        F.col("captured_at").alias("commence_time"),
        F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("bookmaker"),
        F.when(number % 29 == 0, "player_rush_yds").otherwise(F.col("market")).alias("market"),
        F.when(number % 31 == 0, " ")
        .when(tail == "3", F.concat(F.lit("MIKE O'Player "), F.col("player_id").cast("string")))
        .otherwise(F.concat(F.lit("Michael O.Player "), F.col("player_id").cast("string"), F.lit(" III")))
        .alias("player"),
        "side",
        F.when(number % 37 == 0, -F.col("line")).otherwise(F.col("line")).alias("line"),
        F.when(number % 41 == 0, 50).otherwise(F.col("american_odds")).alias("american_odds"),
        "captured_at",
    )


def payloads(spark: SparkSession, directory: str) -> DataFrame:
    """One nested JSON document per quote, with entries that must be dropped."""
    q = quotes(spark, directory)
    outcome = lambda name, who, price: F.struct(
        name.alias("name"), who.alias("description"), F.col("line").alias("point"), price.alias("price")
    )
    player = F.concat(F.lit("Player "), F.col("player_id").cast("string"))
    price = F.col("american_odds").cast("double")
    good = outcome(F.initcap("side"), player, F.col("american_odds").cast("string"))
    nobody = outcome(F.initcap("side"), F.lit(""), F.lit("100"))
    draw = outcome(F.lit("Draw"), player, F.lit("100"))
    broken = outcome(F.initcap("side"), player, F.concat(price.cast("string"), F.lit("5")))
    document = F.struct(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("H"), (F.col("event_id") % 32).cast("string")).alias("home_team"),
        F.concat(F.lit("A"), (F.col("event_id") % 31).cast("string")).alias("away_team"),
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"),
        F.array(
            F.struct(
                F.concat(F.lit("book_"), F.col("book_id").cast("string")).alias("key"),
                F.when(F.col("book_id") != 0, F.concat(F.lit("Book "), F.col("book_id").cast("string"))).alias("title"),
                F.array(
                    F.struct(F.col("market").alias("key"), F.array(good, nobody, draw, broken).alias("outcomes")),
                    F.struct(F.lit("h2h").alias("key"), F.array(good).alias("outcomes")),
                ).alias("markets"),
            )
        ).alias("bookmakers"),
    )
    return q.select("quote_id", F.to_json(document).alias("payload"))
