"""Quote analytics: pricing, best lines, ranking, vig removal, movement, consensus."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.odds import american_to_decimal, implied_probability, line_score
from tallyfield.operators.scan import groups_fit, look_back, ordered, running, with_totals
from tallyfield.session import materialize

CONTRACT = ["event_id", "player_id", "market", "side"]
SERIES = [*CONTRACT, "book_id"]
ARRIVAL = ["captured_at", "quote_id"]
POINT = ["captured_at", "line", "american_odds", "direction"]


def price_quotes(quotes: DataFrame) -> DataFrame:
    """Decimal price and implied probability per quote."""
    odds = F.col("american_odds")
    return quotes.withColumns(
        {"decimal_odds": american_to_decimal(odds), "implied_probability": implied_probability(odds)}
    )


def best_line(quotes: DataFrame, latest_only: bool = False, as_of=None) -> DataFrame:
    """Best quote per contract: line first, price second, lowest quote id on ties.

    The whole history takes part unless ``as_of`` cuts it or ``latest_only`` keeps one
    quote per book.
    """
    if as_of is not None:
        quotes = quotes.filter(F.col("captured_at") <= F.lit(as_of))
    if latest_only:
        quotes = latest_per_key(quotes, SERIES, ARRIVAL)
    score = line_score(F.col("side"), F.col("line"))
    price = american_to_decimal(F.col("american_odds"))
    payload = ["quote_id", "book_id", "line", "american_odds", "captured_at"]
    best = quotes.groupBy(*CONTRACT).agg(
        F.min_by(F.struct(*payload), F.struct(-score, -price, F.col("quote_id"))).alias("best")
    )
    reason = (
        F.when(
            F.col("line").isNull() | F.col("side").isin("yes", "no"),
            "Selected the best available price for this binary market.",
        )
        .when(F.col("side") == "over", "Selected the lowest OVER line; price breaks ties between equal lines.")
        .otherwise("Selected the highest UNDER line; price breaks ties between equal lines.")
    )
    return best.select(*CONTRACT, "best.*").withColumn("reason", reason)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key in the given order, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns)


def rank_offers(
    quotes: DataFrame, player: str | None = None, market: str | None = None, side: str | None = None
) -> DataFrame:
    """Rank quotes 1..n per (player, market, side), best line and then best price first."""
    rows = quotes.withColumn("player_key", F.lower(F.col("player_id").cast("string")))
    if player is not None:
        rows = rows.filter(F.col("player_key") == player.lower())
    if market is not None:
        rows = rows.filter(F.col("market") == market)
    if side is not None:
        rows = rows.filter(F.col("side") == side)
    rows = price_quotes(rows).withColumn("_score", line_score(F.col("side"), F.col("line")))
    scan = ordered(rows, ["player_key", "market", "side"], ["-_score", "-decimal_odds", "quote_id"])
    ranked = running(scan, {"rank": ("count", F.lit(1))}, inclusive=True).result()
    return ranked.withColumns(
        {
            "decimal_odds": F.bround("decimal_odds", 4),
            "implied_probability": F.bround("implied_probability", 4),
        }
    ).drop("_score", "player_key")


def vig_removal(quotes: DataFrame, batch: str = "batch", sizes_of: DataFrame | None = None) -> DataFrame:
    """Fair probability of quotes that form exactly one opposing pair in a batch.

    Groups are read in place, in one shuffle of the quotes. Where one is too large for a task
    (then it is no pair) only groups of two leave an aggregate; they are joined back on the
    unique quote id, never on the group key. ``sizes_of`` names a cheaper frame with columns
    that a group shares, for that decision.
    """
    key = [batch, "event_id", "player_id", "book_id", "market", "line"]
    priced = quotes.withColumn("implied_probability", implied_probability(F.col("american_odds")))
    member = F.struct("side", "quote_id", "implied_probability")
    if sizes_of is None:
        sizes_of = quotes.select(*key)
    if groups_fit(sizes_of, sizes_of.columns):
        group = Window.partitionBy(*key)
        low, high = F.min("side").over(group), F.max("side").over(group)
        priced_two = (F.count("*").over(group) == 2) & (F.count("implied_probability").over(group) == 2)
        pair = priced_two & (((low == "over") & (high == "under")) | ((low == "no") & (high == "yes")))
        total = F.sum("implied_probability").over(group)
        rows = priced.withColumns({"_pair": pair, "_total": total})
        fair = F.when(F.col("_pair"), F.col("implied_probability") / F.col("_total"))
        rows = rows.withColumn("fair_market_probability", fair).drop("_pair", "_total")
        return rows.withColumn("vig_removed", F.col("fair_market_probability").isNotNull())
    groups = priced.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(member).alias("a"), F.max(member).alias("b")
    )
    opposing = ((F.col("a.side") == "over") & (F.col("b.side") == "under")) | (
        (F.col("a.side") == "no") & (F.col("b.side") == "yes")
    )
    total = F.col("a.implied_probability") + F.col("b.implied_probability")
    fair = groups.filter((F.col("n") == 2) & opposing).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(f"{m}.quote_id").alias("_pair_id"),
                        (F.col(f"{m}.implied_probability") / total).alias("fair_market_probability"),
                    )
                    for m in ("a", "b")
                ]
            )
        )
    )
    joined = priced.join(fair, priced["quote_id"] == fair["_pair_id"], "left").drop("_pair_id")
    return joined.withColumn("vig_removed", F.col("fair_market_probability").isNotNull())


def movement_direction(quotes: DataFrame) -> DataFrame:
    """Direction of every quote against the previous one of the same book."""

    def build(df, window):
        before_line, before_odds = F.lag("line").over(window), F.lag("american_odds").over(window)
        df = df.withColumns({"_line": before_line, "_odds": before_odds})
        direction = (
            F.when(F.col("_odds").isNull(), "INITIAL")
            .when(F.col("line") > F.col("_line"), "UP")
            .when(F.col("line") < F.col("_line"), "DOWN")
            .when(F.col("american_odds") > F.col("_odds"), "PRICE_UP")
            .when(F.col("american_odds") < F.col("_odds"), "PRICE_DOWN")
            .otherwise("UNCHANGED")
        )
        return df.withColumn("direction", direction).drop("_line", "_odds")

    return look_back(ordered(quotes, SERIES, ARRIVAL), 1, build).result()


def movement_points(directed: DataFrame) -> DataFrame:
    """The first quote of a series and every later quote that moved, numbered in order."""
    points = directed.filter(F.col("direction") != "UNCHANGED")
    scan = ordered(points, SERIES, ARRIVAL)
    numbered = running(scan, {"point_no": ("count", F.lit(1))}, inclusive=True).result()
    return numbered.select(*SERIES, "point_no", "quote_id", "captured_at", "line", "american_odds", "direction")


def movement_pages(points: DataFrame, page_size: int = 500) -> DataFrame:
    """Movement points as nested arrays of bounded length; a long series has several pages."""
    page = F.floor((F.col("point_no") - 1) / page_size).cast("int")
    entry = F.struct("point_no", "captured_at", "line", "american_odds", "direction")
    return (
        points.withColumn("page_no", page)
        .groupBy(*SERIES, "page_no")
        .agg(F.array_sort(F.collect_list(entry)).alias("points"))
    )


def series_summary(directed: DataFrame) -> DataFrame:
    """First, latest and extreme line and odds per book series, and its movement points in order.

    A row holds all points of its series; ``movement_pages`` has them in rows of bounded length.
    """
    arrival = F.struct(*ARRIVAL)
    quote = F.struct("line", "american_odds")
    moved = ~F.col("direction").isin("INITIAL", "UNCHANGED")
    point = F.struct(*ARRIVAL, "line", "american_odds", "direction")
    entry = lambda p: F.struct(*[p[c].alias(c) for c in POINT])
    summary = directed.groupBy(*SERIES).agg(
        F.min_by(quote, arrival).alias("first"),
        F.max_by(quote, arrival).alias("latest"),
        F.min(arrival).alias("first_seen"),
        F.min("line").alias("minimum_line"),
        F.max("line").alias("maximum_line"),
        F.min("american_odds").alias("minimum_odds"),
        F.max("american_odds").alias("maximum_odds"),
        F.min(F.when(moved, F.col("captured_at"))).alias("first_move_at"),
        F.count_if(F.col("direction") != "UNCHANGED").alias("movement_points"),
        F.array_sort(F.collect_list(F.when(F.col("direction") != "UNCHANGED", point))).alias("movements"),
    )
    return summary.select(
        *SERIES,
        F.col("first.line").alias("first_line"),
        F.col("first.american_odds").alias("first_odds"),
        F.col("latest.line").alias("latest_line"),
        F.col("latest.american_odds").alias("latest_odds"),
        "minimum_line",
        "maximum_line",
        "minimum_odds",
        "maximum_odds",
        "first_move_at",
        "first_seen",
        "movement_points",
        F.transform("movements", entry).alias("movements"),
    )


def consensus_of(latest: DataFrame, line: str = "line", odds: str = "american_odds") -> DataFrame:
    """Median line and probability over one latest quote per book.

    Medians are exact; a group holds one value per book.
    """
    probability = implied_probability(F.col(odds))
    grouped = latest.groupBy(*CONTRACT).agg(
        F.count("*").alias("_books"),
        F.count(line).alias("_with_line"),
        F.median(F.col(line)).alias("_line"),
        F.median(probability).alias("_probability"),
    )
    enough = (F.col("_books") >= 2) & (F.col("_with_line") >= 2)
    return grouped.select(
        *CONTRACT,
        F.when(enough, F.col("_line")).alias("consensus_line"),
        F.when(enough, F.col("_probability")).alias("consensus_probability"),
        F.when(enough, F.col("_books")).alias("books_contributing"),
    )


def consensus(quotes: DataFrame) -> DataFrame:
    """Cross-book consensus per contract from each book's latest quote."""
    latest = quotes.groupBy(*SERIES).agg(
        F.max_by(F.struct("line", "american_odds"), F.struct(*ARRIVAL)).alias("q")
    )
    return consensus_of(latest.select(*SERIES, "q.*"))


def moved_first(summary: DataFrame) -> DataFrame:
    """Book whose first real move is earliest; ties go to the book seen first."""
    return (
        summary.filter(F.col("first_move_at").isNotNull())
        .groupBy(*CONTRACT)
        .agg(F.min_by("book_id", F.struct("first_move_at", "first_seen")).alias("moved_first"))
    )


def movement_summary(quotes: DataFrame) -> DataFrame:
    """Per book series: summary with its movement points, the book that moved first, and the consensus.

    Everything derives from one ordered pass, which is stored; later steps only see one row per series.
    """
    summary = materialize(series_summary(movement_direction(quotes)))
    leaders = moved_first(summary)
    agreed = consensus_of(summary, "latest_line", "latest_odds")
    return (
        summary.drop("first_move_at", "first_seen")
        .join(leaders, CONTRACT, "left")
        .join(agreed, CONTRACT, "left")
    )


def opening_quote(requests: DataFrame, quotes: DataFrame) -> DataFrame:
    """Earliest quote of the requested book series, falling back to the request's own.

    Quotes that ask for themselves are ordered once along their series.
    """
    own = F.struct("line", "american_odds")
    if requests is quotes:
        scan = ordered(quotes, SERIES, [*ARRIVAL, "line", "american_odds"])
        if scan.chunked:
            first = F.struct(*ARRIVAL, "line", "american_odds")
            rows = running(scan, {"_first": ("min", first)}, inclusive=True).result()
        else:  # plain columns, so that nothing is shuffled twice over
            rows = scan.df.withColumns({f"_{c}": F.first(c).over(scan.window()) for c in ("line", "american_odds")})
            rows = rows.withColumn("_first", F.struct(F.col("_line").alias("line"), F.col("_american_odds").alias("american_odds")))
        known = reduce(and_, [F.col(c).isNotNull() for c in SERIES])  # a missing key names no series
        rows = rows.withColumn("_open", F.when(known, F.struct("_first.line", "_first.american_odds")).otherwise(own))
        return rows.select(
            *requests.columns, F.col("_open.line").alias("opening_line"), F.col("_open.american_odds").alias("opening_odds")
        )
    opening = quotes.groupBy(*SERIES).agg(
        F.min_by(F.struct("line", "american_odds"), F.struct(*ARRIVAL)).alias("_open")
    )
    joined = with_totals(requests, opening, SERIES)
    return joined.withColumn("_open", F.coalesce("_open", own)).select(
        *requests.columns,
        F.col("_open.line").alias("opening_line"),
        F.col("_open.american_odds").alias("opening_odds"),
    )
