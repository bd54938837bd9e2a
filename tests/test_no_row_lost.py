"""Rows with missing partners or values stay in the result and say why."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyfield.operators import feeds, logs, paper, projections, scan
from tallyfield.plans import catalog_market
from tallyfield.sources import tables

T0 = datetime(2030, 5, 6, 12)


def test_null_lines_and_rates_are_kept(spark):
    rows = spark.createDataFrame(
        [(1, 2.5, 1.5), (2, None, 1.5), (3, 2.5, None), (4, None, None), (5, 3.0, 2.0), (5, 3.0, 2.0)],
        "id int, rate double, line double",
    )
    got = projections.score_lines(rows).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5, 5]
    by = {r.id: r for r in got}
    assert by[2].over_probability is None and by[2].median is None
    assert by[3].over_probability is None and by[3].median is not None
    assert abs(by[5].over_probability + by[5].under_probability + by[5].push_probability - 1) < 1e-9


def test_request_without_lease_is_denied(spark):
    requests = spark.createDataFrame([(1, 1, T0), (2, 9, T0)], "request_id int, lease_id int, instant timestamp_ntz")
    leases = spark.createDataFrame(
        [(1, True, T0, T0 + timedelta(1), False)],
        "lease_id int, bounded boolean, effective_at timestamp_ntz, expires_at timestamp_ntz, revoked boolean",
    )
    ready = spark.createDataFrame([], "lease_id int, ready_expires_at timestamp_ntz, superseded boolean")
    got = {r.request_id: (r.outcome, r.reasons) for r in logs.validity_gate(requests, leases, ready).collect()}
    assert got == {1: ("APPROVED", ["OFFER_APPROVED"]), 2: ("DENIED", ["LEASE_NOT_FOUND"])}


def test_conflicting_and_empty_names_are_listed(spark, sf):
    offers = catalog_market._offers(spark, sf).limit(200)
    offers = offers.withColumn("player", F.when(F.col("offer_id") == offers.first().offer_id, " ").otherwise(F.col("player")))
    out = feeds.persist_offers(offers, *catalog_market._players(spark, sf))
    assert out["quotes"].count() + out["violations"].count() == 200
    assert {r.violation for r in out["violations"].select("violation").distinct().collect()} <= {"INVALID", "CONFLICT"}


def test_unknown_quote_is_refused_and_earlier_stakes_count(spark, sf):
    quotes = tables.quotes(spark, sf)
    requests = catalog_market._requests(spark, sf)
    stray = requests.limit(1).withColumn("request_id", F.lit("stray")).withColumn("quote_id", F.lit("none"))
    asked = requests.unionByName(stray)
    got = paper.project_and_recommend(asked, quotes)
    assert got.count() == asked.count()
    row = got.filter("request_id = 'stray'").first()
    assert (row.rating, row.rejection_reasons, row.recommended_stake) == ("REFUSED", ["Quote not found."], Decimal("0.00"))
    bets = got.filter("rating = 'BET' and recommended_stake > 0")
    week = bets.first().decided_at
    earlier = spark.createDataFrame([(week, Decimal("1000.00"))], "decided_at timestamp_ntz, recommended_stake decimal(12,2)")
    again = paper.project_and_recommend(asked, quotes, earlier=earlier)
    same_week = F.date_trunc("week", "decided_at") == F.date_trunc("week", F.lit(week))
    assert again.filter(same_week & (F.col("recommended_stake") > 0)).count() == 0
    assert again.filter(~same_week & (F.col("recommended_stake") > 0)).count() == got.filter(
        ~same_week & (F.col("recommended_stake") > 0)
    ).count()


def test_large_stakes_settle(spark):
    rows = spark.createDataFrame(
        [(Decimal("10000000.00"), -110, "WIN"), (Decimal("99999999.99"), -100, "WIN"), (Decimal("99999999.99"), 100000, "WIN"), (Decimal("99999999.99"), 150, "LOSS")],
        "stake decimal(10,2), odds int, outcome string",
    )
    from tallyfield.functions.odds import settled_profit

    got = [r[0] for r in rows.select(settled_profit(F.col("outcome"), F.col("stake"), F.col("odds"))).collect()]
    assert got == [Decimal("9090909.09"), Decimal("99999999.99"), Decimal("99999999990.00"), Decimal("-99999999.99")]


def test_line_scores_do_not_loop_inside_rows(spark):
    """The chances of the column functions, without an interpreted loop of the engine for every row."""
    from tallyfield.functions import poisson

    pairs = [(r, x) for r in (0.0, 0.3, 4.0, 12.5, 700.0, 990.0) for x in (0.0, 0.5, 3.0, 11.5, 40.0, 702.0, 1500.0)]
    rows = spark.createDataFrame(pairs, "rate double, line double")
    scored = projections.score_lines(rows)
    assert "aggregate(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    under = F.when(F.col("line") == F.floor("line"), F.col("line").cast("long") - 1).otherwise(F.floor("line"))
    push = F.when(F.col("line") == F.floor("line"), poisson.pmf(F.col("line").cast("long"), F.col("rate"))).otherwise(0.0)
    got = scored.withColumns(
        {
            "o": poisson.over(F.col("rate"), F.col("line")),
            "u": poisson.cdf(under, F.col("rate")),
            "p": push,
            "q": poisson.quantiles(F.col("rate"), projections.QUANTILES),
        }
    ).collect()
    for row in got:
        assert abs(row.over_probability - row.o) < 1e-11 and abs(row.under_probability - row.u) < 1e-11
        assert abs(row.push_probability - row.p) < 1e-11 and (row.floor, row.median, row.ceiling) == tuple(row.q)
    odd = spark.createDataFrame([(4.0, -2.0), (4.0, 1e12), (-1.0, 2.0), (float("nan"), 2.0)], "rate double, line double")
    below, far, *none = projections.score_lines(odd).collect()
    assert (below.over_probability, below.push_probability) == (1.0, 0.0) and far.over_probability < 1e-12
    assert all(r.over_probability is None and r.median is None for r in none)


def test_recommendations_joined_in_parts_are_the_same(spark, sf, monkeypatch):
    """Requests without a quote or with a key of another type stay, and only named columns are carried."""
    from conftest import same_rows

    quotes = tables.quotes(spark, sf)
    requests = catalog_market._requests(spark, sf)
    stray = requests.limit(2).withColumn("request_id", F.concat(F.lit("stray-"), "request_id")).withColumn("quote_id", F.lit(None).cast("string"))
    asked = requests.unionByName(stray)
    want = paper.project_and_recommend(asked, quotes)
    monkeypatch.setattr(paper, "SPLIT_ROWS", 0)
    got = paper.project_and_recommend(asked, quotes, columns=["request_id"])
    assert {"injury_certainty", "quote_id"} <= set(want.columns) and not {"injury_certainty", "quote_id"} & set(got.columns)
    same_rows(got, want.select(*got.columns))
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string"), spark.createDataFrame([(1, "A"), (2, "B")], "k long, y string")
    pairs = scan.dealt(left, right, ["k"], 3)
    assert sorted(r.x + (r.y or "") for a, b in pairs for r in a.join(b, "k", "left").collect()) == ["aA", "bB", "c"]
