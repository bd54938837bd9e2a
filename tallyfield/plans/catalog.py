"""Every registered query: name -> callable(spark, table directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import market
from tallyfield.session import configure
from tallyfield.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query, name: str | None = None) -> Query:
    """Register ``build`` under its own or a given name; returns it unchanged."""
    register(name or build.__name__, build)
    return build


def register(name: str, build: Query) -> None:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(configure(spark), directory)

    QUERIES[name] = run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- quotes ---------------------------------------------------------------------------


@query
def price_quotes(spark, sf):
    priced = market.price_quotes(tables.quotes(spark, sf))
    return rounded(
        priced.select("quote_id", "american_odds", "decimal_odds", "implied_probability"),
        "decimal_odds",
        "implied_probability",
    )


@query
def best_line(spark, sf):
    return market.best_line(tables.quotes(spark, sf))


@query
def latest_per_key(spark, sf):
    quotes = tables.quotes(spark, sf).drop("batch")
    return market.latest_per_key(quotes, market.SERIES, market.ARRIVAL)


@query
def rank_offers(spark, sf):
    return market.rank_offers(tables.quotes(spark, sf)).select(
        "quote_id",
        "player_id",
        "market",
        "side",
        "line",
        "american_odds",
        "decimal_odds",
        "implied_probability",
        "rank",
    )


@query
def vig_removal(spark, sf):
    fair = market.vig_removal(tables.quotes(spark, sf))
    return rounded(
        fair.select("quote_id", "implied_probability", "fair_market_probability", "vig_removed"),
        "implied_probability",
        "fair_market_probability",
    )


@query
def movement_direction(spark, sf):
    return market.movement_direction(tables.quotes(spark, sf)).select("quote_id", "direction")


@query
def movement_points(spark, sf):
    return market.movement_points(market.movement_direction(tables.quotes(spark, sf)))


@query
def consensus(spark, sf):
    return rounded(market.consensus(tables.quotes(spark, sf)), "consensus_line", "consensus_probability")


@query
def moved_first(spark, sf):
    return market.moved_first(market.series_summary(market.movement_direction(tables.quotes(spark, sf))))


@query
def movement_summary(spark, sf):
    """The points of a series as text: time in microseconds, line, odds and direction of each."""
    rows = market.movement_summary(tables.quotes(spark, sf))

    def text(point):
        line = F.coalesce(point["line"].cast("string"), F.lit("-"))
        micros = F.unix_micros(point["captured_at"].cast("timestamp"))
        return F.concat_ws("|", micros, line, point["american_odds"], point["direction"])

    rows = rows.withColumn("movements", F.array_join(F.transform("movements", text), ";"))
    return rounded(rows, "consensus_line", "consensus_probability")
