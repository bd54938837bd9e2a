"""Feed bookkeeping: duplicate batches, provider health, listings and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.names import book_key, normalize_name
from tallyfield.operators.scan import look_back, ordered, running, with_totals
from tallyfield.session import materialize, with_one_row


def duplicate_batches(batches: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Flag a batch whose payload hash equals the provider's batch right before it.

    ``previous`` gives the last known hash per provider from earlier runs.
    """
    rows = batches
    if previous is not None:
        known = previous.select("provider", F.col("payload_hash").alias("_known"))
        rows = rows.join(known, "provider", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))

    def build(df, window):
        before = F.coalesce(F.lag("payload_hash").over(window), F.col("_known"))
        return df.withColumn("duplicate_suppressed", F.coalesce(before == F.col("payload_hash"), F.lit(False)))

    done = look_back(ordered(rows, ["provider"], ["captured_at", "batch_id"], sizes_of=batches), 1, build).result()
    done = done.drop("_known")
    if "row_count" in done.columns:
        done = done.withColumn("row_count", F.when(F.col("duplicate_suppressed"), 0).otherwise(F.col("row_count")))
    return done


HEALTH_COLUMNS = (
    "provider",
    "status",
    "successful_fetches",
    "consecutive_failures",
    "average_latency_ms",
    "records_returned",
    "last_successful_fetch",
    "last_failed_fetch",
)


def provider_health(attempts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Fold fetch attempts into one health row per provider; ``previous`` is the state so far.

    ``attempts``: provider, attempt_id, ended_at, succeeded, latency_ms, records.
    Only order-free aggregates are used, so a busy provider combines map-side.
    """
    at = F.struct("ended_at", "attempt_id")
    good = F.col("succeeded")
    last = attempts.filter(good).groupBy("provider").agg(F.max(at).alias("_last_good"))
    rows = with_totals(attempts, last, ["provider"])
    late = ~good & (F.col("_last_good").isNull() | (at > F.col("_last_good")))
    facts = rows.groupBy("provider").agg(
        F.count_if(good).alias("_good"),
        F.sum(F.when(good, F.col("latency_ms"))).alias("_latency"),
        F.count_if(late).alias("_late"),
        F.max_by(F.when(good, F.col("records")), F.when(good, at)).alias("_records"),
        F.max(F.when(good, F.col("ended_at"))).alias("_success_at"),
        F.max(F.when(~good, F.col("ended_at"))).alias("_failure_at"),
        F.max_by(F.when(~good, F.col("latency_ms")), F.when(~good, at)).alias("_failure_latency"),
    )
    if previous is None:
        empty = {f"p_{c}": F.lit(None).cast("double") for c in HEALTH_COLUMNS[2:6]}
        empty |= {f"p_{c}": F.lit(None).cast("timestamp_ntz") for c in HEALTH_COLUMNS[6:]}
        both = facts.withColumns(empty)
    else:
        state = previous.select("provider", *[F.col(c).alias(f"p_{c}") for c in HEALTH_COLUMNS[2:]])
        both = facts.join(state, "provider", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count = zero("p_successful_fetches") + zero("_good")
    total = zero("p_average_latency_ms") * zero("p_successful_fetches") + F.coalesce("_latency", F.lit(0.0))
    failures = F.when(zero("_good") > 0, zero("_late")).otherwise(zero("p_consecutive_failures") + zero("_late"))
    average = F.when(count > 0, total / count).otherwise(F.coalesce("_failure_latency", "p_average_latency_ms"))
    return both.select(
        "provider",
        F.when(failures >= 3, "DOWN").when(failures > 0, "DEGRADED").otherwise("HEALTHY").alias("status"),
        count.cast("long").alias("successful_fetches"),
        failures.cast("long").alias("consecutive_failures"),
        average.alias("average_latency_ms"),
        F.coalesce("_records", "p_records_returned").cast("long").alias("records_returned"),
        F.greatest("_success_at", "p_last_successful_fetch").alias("last_successful_fetch"),
        F.greatest("_failure_at", "p_last_failed_fetch").alias("last_failed_fetch"),
    )


# --- listings -------------------------------------------------------------------------


def newest(rows: DataFrame, order: list[str], limit: int, **equal) -> DataFrame:
    """Rows matching the given equalities, newest first, as a bounded top-k."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit)


def star_join(quotes: DataFrame, events: DataFrame, players: DataFrame, books: DataFrame) -> DataFrame:
    """Quotes with event, player and book attributes; join sides are sized at run time."""
    return quotes.join(events, "event_id").join(players, "player_id").join(books, "book_id")


# --- entities -------------------------------------------------------------------------


def allocate_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """``normalized`` and ``new_id``: dense ids above the highest of ``taken`` (column ``id``).

    Distinct names are numbered in their order by a scan that cuts very many of them into
    ranges, so no two names share an id and the same inputs give the same ids again, however
    they are partitioned. Batches that allocate have to run one after the other.
    """
    distinct = names.select("normalized").distinct()
    scan = running(ordered(distinct, [], ["normalized"]), {"_n": ("count", F.lit(1))}, inclusive=True)
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return with_one_row(scan.result(), top).select("normalized", (F.col("_top") + F.col("_n")).cast("long").alias("new_id"))


def resolve_alias(offers: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Player of every distinct (provider, raw name), and how it was found.

    Tiers: the provider's own alias; any provider's alias (conflict if they disagree); a
    player of the same normalised name; otherwise a new player.
    """
    names = offers.select("provider", "raw_name").dropDuplicates()
    names = names.withColumn("normalized", normalize_name(F.col("raw_name")))
    own = aliases.groupBy("provider", F.col("normalized_alias").alias("normalized")).agg(F.min("player_id").alias("_own"))
    shared = aliases.groupBy(F.col("normalized_alias").alias("normalized")).agg(
        F.min("player_id").alias("_any"), (F.min("player_id") != F.max("player_id")).alias("_conflict")
    )
    named = (
        players.withColumn("normalized", normalize_name(F.col("name")))
        .groupBy("normalized")
        .agg(F.min("player_id").alias("_named"))
    )
    rows = names.join(own, ["provider", "normalized"], "left").join(shared, "normalized", "left").join(named, "normalized", "left")
    tier = (
        F.when(F.col("normalized") == "", "INVALID")
        .when(F.col("_own").isNotNull(), "PROVIDER_ALIAS")
        .when(F.col("_conflict"), "CONFLICT")
        .when(F.col("_any").isNotNull(), "GLOBAL_ALIAS")
        .when(F.col("_named").isNotNull(), "PLAYER_NAME")
        .otherwise("NEW")
    )
    rows = materialize(rows.withColumn("tier", tier))
    taken = players.select(F.col("player_id").alias("id")).unionByName(aliases.select(F.col("player_id").alias("id")))
    rows = with_totals(rows, allocate_ids(rows.filter(F.col("tier") == "NEW"), taken), ["normalized"])
    player = (
        F.when(F.col("tier").isin("INVALID", "CONFLICT"), F.lit(None))
        .when(F.col("tier") == "NEW", F.col("new_id"))
        .otherwise(F.coalesce("_own", "_any", "_named"))
    )
    return rows.select("provider", "raw_name", "normalized", "tier", player.cast("long").alias("player_id"))


def new_players(resolved: DataFrame) -> DataFrame:
    fresh = resolved.filter(F.col("tier") == "NEW")
    return fresh.groupBy("player_id").agg(F.min(F.trim("raw_name")).alias("name"))


def new_aliases(resolved: DataFrame) -> DataFrame:
    fresh = resolved.filter(F.col("tier").isin("GLOBAL_ALIAS", "PLAYER_NAME", "NEW"))
    return fresh.select("provider", F.col("raw_name").alias("raw_alias"), F.col("normalized").alias("normalized_alias"), "player_id")


def persist_offers(offers: DataFrame, players: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Dimension additions, fact rows for accepted offers, and the offers that are refused.

    Book and event keys are functions of their natural keys, so they need no lookup.
    Offers: offer_id, batch_id, provider, event_id, event_name, commence_time, bookmaker,
    market, player, side, line, american_odds, captured_at.
    """
    from tallyfield.operators.market import vig_removal

    named = offers.withColumn("raw_name", F.col("player"))
    # Stored, so that a name with very many offers can be split in the join below.
    resolved = materialize(resolve_alias(named, players, aliases))
    keys = resolved.select("provider", "raw_name", "player_id")
    facts = named.join(keys, ["provider", "raw_name"], "left").withColumns(
        {"book_id": book_key(F.col("bookmaker")), "quote_id": F.col("offer_id"), "batch": F.col("batch_id")}
    )
    sizes_of = offers.select("batch_id", "event_id", "market", "line")
    facts = vig_removal(facts.filter(F.col("player_id").isNotNull()), sizes_of=sizes_of)
    # Names that are empty or claimed by two players get no fact row and are listed instead.
    refused = named.join(resolved.select("provider", "raw_name", "tier", F.col("player_id").alias("_p")), ["provider", "raw_name"])
    violations = refused.filter(F.col("_p").isNull()).select("offer_id", "provider", "raw_name", F.col("tier").alias("violation"))
    books = offers.groupBy(book_key(F.col("bookmaker")).alias("book_id")).agg(F.min("bookmaker").alias("name"))
    events = offers.groupBy("event_id").agg(F.min("event_name").alias("name"), F.min("commence_time").alias("commence_time"))
    return {
        "quotes": facts,
        "resolved": resolved,
        "players": new_players(resolved),
        "aliases": new_aliases(resolved),
        "books": books,
        "events": events,
        "violations": violations,
    }
