"""Nested odds payloads: flattening to offers, and appending snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices stay text so that a fractional price can be told from a whole one.
EVENT_SCHEMA = (
    "struct<id:string,home_team:string,away_team:string,commence_time:string,bookmakers:array<struct<key:string,"
    "title:string,markets:array<struct<key:string,outcomes:array<struct<name:string,description:string,"
    "point:double,price:string>>>>>>>"
)
# Provider market and side names.
MARKET_MAP = {
    "player_pass_yds": "player_pass_yds",
    "player_pass_tds": "player_pass_tds",
    "player_pass_interceptions": "player_pass_interceptions",
    "player_receptions": "player_receptions",
    "player_anytime_td": "player_anytime_td",
}
SIDE_MAP = {"over": "over", "under": "under", "yes": "yes", "no": "no"}


def mapped(names: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), value)


def flatten_odds(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Offers of nested event documents (batch or stream); unusable entries are dropped."""
    keep = [c for c in payloads.columns if c != column]
    name = F.concat(F.coalesce("e.away_team", F.lit("")), F.lit(" at "), F.coalesce("e.home_team", F.lit("")))
    event = payloads.select(*keep, F.from_json(F.col(column), EVENT_SCHEMA).alias("e"))
    # An explode copies what stands beside it to every row: only plain values do, never the arrays.
    books = event.select(
        *keep,
        F.col("e.id").alias("event_id"),
        F.trim(name).alias("event_name"),
        F.try_to_timestamp(F.col("e.commence_time")).cast("timestamp_ntz").alias("commence_time"),
        F.explode("e.bookmakers").alias("b"),
    )
    have = [*keep, "event_id", "event_name", "commence_time"]
    bookmaker = F.coalesce("b.title", "b.key", F.lit("Unknown")).alias("bookmaker")
    markets = books.select(*have, bookmaker, F.explode("b.markets").alias("m"))
    have += ["bookmaker"]
    outcomes = markets.select(*have, mapped(MARKET_MAP, F.col("m.key")).alias("market"), F.explode("m.outcomes").alias("o"))
    rows = outcomes.select(
        *have,
        "market",
        F.col("o.description").alias("player"),
        mapped(SIDE_MAP, F.lower("o.name")).alias("side"),
        F.col("o.point").alias("line"),
        F.when(F.col("o.price").rlike(r"^-?\d+$"), F.col("o.price").try_cast("int")).alias("american_odds"),
    )
    usable = (
        F.col("market").isNotNull()
        & F.col("side").isNotNull()
        & (F.coalesce("player", F.lit("")) != "")
        & F.col("american_odds").isNotNull()
    )
    return rows.filter(usable)


def append_snapshot(offers: DataFrame, path: str) -> None:
    """Append one JSON line per offer, in compressed files: the names of the fields are most of a line."""
    offers.write.mode("append").option("compression", "gzip").json(path)
