"""American-odds arithmetic, expected value and closing-line value as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sides without a numeric line.
BINARY_SIDES = ("yes", "no")
BET_EV = 0.05
WATCH_EV = 0.0


def american_to_decimal(odds: Column) -> Column:
    """Decimal payout per unit staked; null for the invalid price 0."""
    return F.when(odds > 0, 1 + odds / F.lit(100.0)).when(odds < 0, 1 + F.lit(100.0) / F.abs(odds))


def implied_probability(odds: Column) -> Column:
    """Break-even win probability of a price; null for the invalid price 0."""
    size = F.abs(odds)
    return F.when(odds > 0, F.lit(100.0) / (odds + 100)).when(odds < 0, size / (size + F.lit(100.0)))


def exact_profit_factor(odds: Column) -> Column:
    """Decimal odds minus one to 27 decimals, for money."""
    hundredth = (odds.cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(28,20)")
    inverse = F.lit(100).cast("decimal(19,16)") / F.abs(odds).cast("decimal(10,0)")
    return F.when(odds > 0, hundredth.cast("decimal(36,27)")).when(odds < 0, inverse.cast("decimal(36,27)"))


def line_score(side: Column, line: Column) -> Column:
    """Higher is better for the bettor: low lines for overs, high lines for unders."""
    return (
        F.when(line.isNull() | side.isin(*BINARY_SIDES), F.lit(0.0))
        .when(side == "over", -line)
        .otherwise(line)
    )


def expected_return(probability: Column, odds: Column) -> Column:
    return probability * american_to_decimal(odds) - 1


def rating(ev: Column, watch: float = WATCH_EV, bet: float = BET_EV) -> Column:
    return F.when(ev >= bet, "BET").when(ev >= watch, "WATCH").otherwise("PASS")


def clv_columns(
    side: Column, bet_line: Column, bet_odds: Column, closing_line: Column, closing_odds: Column
) -> dict[str, Column]:
    """Line move, price move, beat-the-close flag and CLV share."""
    bet_price, close_price = american_to_decimal(bet_odds), american_to_decimal(closing_odds)
    moved = bet_line != closing_line
    beat = (
        F.when(F.coalesce((side == "over") & moved, F.lit(False)), bet_line < closing_line)
        .when(F.coalesce((side == "under") & moved, F.lit(False)), bet_line > closing_line)
        .otherwise(bet_price > close_price)
    )
    return {
        "line_movement": closing_line - bet_line,
        "price_movement": bet_price - close_price,
        "beat_closing_line": beat,
        "clv_percentage": F.when(bet_line.eqNullSafe(closing_line), bet_price / close_price - 1),
    }


def settled_profit(outcome: Column, stake: Column, odds: Column) -> Column:
    """Net profit in cents, half-even, in 28-digit decimal arithmetic.

    The product is first rounded to 28 significant digits, as a decimal calculator does:
    that decides which repeating quotients count as an exact half cent.
    """
    # A positive price has two decimals, so its product is exact.
    direct = stake.cast("decimal(12,2)") * (odds.cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")
    # Below even money the factor has no whole digit, which leaves room for eight in the stake.
    product = stake.cast("decimal(10,2)") * exact_profit_factor(odds).try_cast("decimal(27,27)")
    digits = F.when(product >= 10_000_000, F.bround(product, 20).cast("decimal(38,28)"))
    for whole in range(7, 0, -1):
        digits = digits.when(product >= 10 ** (whole - 1), F.bround(product, 28 - whole).cast("decimal(38,28)"))
    digits = digits.otherwise(product.cast("decimal(38,28)"))
    win = F.when(odds > 0, F.bround(direct, 2)).when(odds == -100, stake).otherwise(F.bround(digits, 2))
    amount = F.when(outcome == "WIN", win).when(outcome == "LOSS", -stake).otherwise(F.lit(0))
    return amount.cast("decimal(20,2)")
