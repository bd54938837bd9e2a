"""Contract and data-quality checks. Violations are data; ``require`` turns them into errors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions.names import normalize_name
from tallyfield.operators.scan import Ordered, look_back, ordered
from tallyfield.session import materialize


class ContractError(ValueError):
    """A table breaks its contract."""


def missing_columns(df: DataFrame, required, any_of=()) -> list[str]:
    """Names a contract needs and the table lacks; ``any_of`` lists alternative sets."""
    have = set(df.columns)
    missing = sorted(set(required) - have)
    if any_of and not any(set(option) <= have for option in any_of):
        missing.append(" or ".join("+".join(sorted(option)) for option in any_of))
    return missing


def check_season(df: DataFrame, seasons) -> DataFrame:
    """One row: row count, missing seasons, unexpected seasons, verdict."""
    wanted = F.array(*[F.lit(int(s)) for s in sorted(seasons)])
    found = F.sort_array(F.collect_set(F.col("season").cast("int")))
    facts = df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("season").isNull()).alias("null_seasons"), found.alias("seasons")
    )
    valid = (F.col("rows") > 0) & (F.col("null_seasons") == 0) & (F.col("seasons") == wanted)
    return facts.withColumn("valid", valid)


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Composite keys that repeat or contain a missing or blank part."""
    blank = reduce(
        lambda a, b: a | b,
        [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys],
    )
    counted = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    reason = F.when(blank, "blank_key").when(F.col("rows") > 1, "duplicate_key")
    return counted.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def nullable_float(df: DataFrame, column: str) -> DataFrame:
    """Lenient cast to double; text that is no number becomes null."""
    return df.withColumn(column, F.col(column).try_cast("double"))


def nullable_float_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per column: values that are no number, not finite, or out of bounds; one scan."""
    kinds = ["not_numeric", "not_finite", "below_minimum", "above_maximum"]
    totals = []
    for name, (low, high) in bounds.items():
        value = F.col(name).try_cast("double")
        infinite = F.isnan(value) | (F.abs(value) == float("inf"))
        tests = [
            F.col(name).isNotNull() & value.isNull(),
            infinite,
            ~infinite & (value < low) if low is not None else F.lit(False),
            ~infinite & (value > high) if high is not None else F.lit(False),
        ]
        totals += [F.count_if(t).alias(f"{name}:{k}") for t, k in zip(tests, kinds)]
    wide = df.agg(*totals)
    entries = [
        F.struct(F.lit(n).alias("column"), *[F.col(f"`{n}:{k}`").alias(k) for k in kinds]) for n in bounds
    ]
    return wide.select(F.inline(F.array(*entries)))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each named rule (``rule`` is the violating condition); one scan."""
    wide = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    entries = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return wide.select(F.inline(F.array(*entries)))


def require(violations: DataFrame, label: str, count: str = "violations") -> None:
    """Raise with a few examples if any violation was counted."""
    found = violations.filter(F.col(count) > 0).take(5)
    if found:
        raise ContractError(f"{label}: {[row.asDict() for row in found]}")


def training_rules() -> dict[str, Column]:
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return {
        "identity_missing": blank("player_id") | blank("player_display_name"),
        "team_missing": F.col("team").isNull(),
        "receptions_invalid": F.col("receptions").isNull() | (F.col("receptions") < 0),
    }


def usage_rules() -> dict[str, Column]:
    def bad(c):
        return F.col(c).isNull() | (F.col(c) < 0)

    return {
        "receptions_invalid": bad("receptions"),
        "targets_invalid": bad("targets"),
        "receiving_yards_invalid": bad("receiving_yards"),
        "receptions_above_targets": F.col("receptions") > F.col("targets"),
    }


def passing_rules() -> dict[str, Column]:
    return {
        "completions_without_attempts": F.col("completions").isNotNull() & F.col("attempts").isNull(),
        "completions_above_attempts": F.col("completions") > F.col("attempts"),
        "attempts_negative": F.col("attempts") < 0,
    }


def target_rules(target: str = "actual_receptions") -> dict[str, Column]:
    value = F.col(target)
    return {
        "target_missing": value.isNull(),
        "target_negative": value < 0,
        "target_not_whole": value != F.floor(value),
    }


def schema_differences(df: DataFrame, expected: T.StructType) -> list[str]:
    """Exact comparison of column order and types."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if [n for n, _ in found] != [n for n, _ in wanted]:
        return [f"columns {[n for n, _ in found]} instead of {[n for n, _ in wanted]}"]
    return [f"{n}: {have} instead of {want}" for (n, have), (_, want) in zip(found, wanted) if have != want]


# --- quote payloads -------------------------------------------------------------------

# Accepted markets and sides, line bounds.
MARKETS = (
    "player_pass_yds",
    "player_pass_tds",
    "player_pass_interceptions",
    "player_receptions",
    "player_anytime_td",
)
SIDES = ("over", "under", "yes", "no")
MAX_LINE = 10_000
CONTRACT_KEY = ["event_id", "_book", "market", "normalized_name", "side", "line"]


def reject_rule(field: Callable[[str], Column]) -> Column:
    """First rule that a single record breaks, or null; ``field`` gives its columns."""
    line, odds, market = field("line"), field("american_odds"), field("market")
    known = F.coalesce(market.isin(*MARKETS), F.lit(False))
    malformed = (
        field("event_id").isNull()
        | field("bookmaker").isNull()
        | field("player").isNull()
        | odds.isNull()
        | ~F.coalesce(field("side").isin(*SIDES), F.lit(False))
    )
    impossible = F.isnan(line) | (line < 0) | (line > MAX_LINE) | ((market == "player_anytime_td") & line.isNotNull())
    return (
        F.when(~known, "UNSUPPORTED_MARKET")
        .when(malformed, "MALFORMED_PAYLOAD")
        .when(F.trim(field("player")) == "", "MISSING_PLAYER_NAME")
        .when(F.abs(odds) < 100, "INVALID_ODDS")
        .when(F.coalesce(impossible, F.lit(False)), "IMPOSSIBLE_LINE")
    )


def valid_offers(offers: Column) -> Column:
    """The records of one payload's array that ``flag_offers`` accepts, by sorting inside the array.

    A single record meets no other, so nothing is normalised or sorted for it.
    """
    passed = F.filter(offers, lambda o: reject_rule(o.getField).isNull())

    def contract(o: Column) -> Column:
        return F.struct(o["event_id"], F.lower(o["bookmaker"]), o["market"], normalize_name(o["player"]), o["side"], o["line"])

    keyed = F.transform(passed, lambda o, i: F.struct(contract(o).alias("contract"), i.alias("i"), o.alias("offer")))
    # Equal contracts are neighbours now, the first record of each in front; each meets the one before it.
    ranked = F.array_sort(keyed)
    before = F.concat(F.array(F.lit(None)), F.transform(ranked, lambda k: k["contract"]))
    paired = F.zip_with(ranked, before, lambda k, last: F.struct(k.alias("k"), last.alias("last")))
    first = F.filter(paired, lambda p: p["k"].isNotNull() & ~p["k"]["contract"].eqNullSafe(p["last"]))
    return F.when(F.size(offers) <= 1, passed).otherwise(F.transform(first, lambda p: p["k"]["offer"]))


def flag_offers(offers: DataFrame, now, stale_event_hours: int = 6, payload: str = "payload_id") -> DataFrame:
    """First failing rule per record, then alias and duplicate checks, per payload.

    Adds ``reject_category``, ``warnings`` and ``normalized_name``. Records are ordered by
    ``record_index`` inside their payload.
    """
    category = reject_rule(F.col)
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(stale_event_hours))
    stale = F.col("commence_time").cast("timestamp_ntz") < cutoff
    rows = offers.withColumns(
        {"reject_category": category, "normalized_name": normalize_name(F.col("player")), "_book": F.lower("bookmaker")}
    )
    # Parsed and normalised once; the checks below read it several times.
    rows = materialize(rows)
    valid = F.col("reject_category").isNull()
    scan = ordered(rows.filter(valid), [payload, "normalized_name"], ["record_index"])
    passed = _alias_changed(scan, "player").result()
    contract = [payload, *CONTRACT_KEY]
    if scan.chunked:
        kept = first_of_contract(passed, contract, "record_index")
        passed = passed.join(kept, [payload, "record_index"], "left")
    else:
        # A contract lies inside its name, whose rows are together already: no further shuffle.
        number = F.row_number().over(Window.partitionBy(*contract).orderBy("record_index"))
        passed = passed.withColumn("_first", F.when(number == 1, True))
    passed = passed.withColumn("reject_category", F.when(F.col("_first").isNull(), "DUPLICATE_CONTRACT"))
    warnings = F.array_compact(
        F.array(
            F.when(stale, "STALE_EVENT"), F.when(F.col("alias_changed"), "PLAYER_ALIAS_VARIATION")
        )
    )
    rejected = rows.filter(~valid).withColumn("warnings", F.array().cast("array<string>"))
    checked = passed.withColumn("warnings", warnings).drop("alias_changed", "_first")
    return rejected.unionByName(checked).drop("_book")


def alias_variation(rows: DataFrame, keys: list[str], raw: str, index: str) -> DataFrame:
    """Flag rows whose previous row with the same normalised name was spelled differently."""
    # The first key is read as it is; to count by the name all names would be normalised once more.
    return _alias_changed(ordered(rows, keys, [index], coarse=keys[:1]), raw).result()


def _alias_changed(scan: Ordered, raw: str) -> Ordered:
    def build(df, window):
        return df.withColumn("alias_changed", F.coalesce(F.lag(raw).over(window) != F.col(raw), F.lit(False)))

    return look_back(scan, 1, build)


def first_of_contract(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Index of the first row of each contract (missing lines are equal), with a marker."""
    payload = keys[0]
    return rows.groupBy(*keys).agg(F.min(index).alias(index)).select(payload, index, F.lit(True).alias("_first"))


def quality_flags(flagged: DataFrame, payload: str = "payload_id") -> DataFrame:
    """Long form: one row per category raised for a record."""
    categories = F.array_compact(F.concat(F.col("warnings"), F.array("reject_category")))
    return flagged.select(payload, "record_index", F.explode(categories).alias("category"))


def snapshot_unique(quotes: DataFrame) -> DataFrame:
    """One row per event, player, book, market, side, line, price and capture time."""
    return quotes.dropDuplicates(
        ["event_id", "player_id", "book_id", "market", "side", "line", "american_odds", "captured_at"]
    )
