"""What keeps the cost of a step in proportion to its input."""

from datetime import datetime

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tallyfield.operators import logs, market, paper, scan
from tallyfield.session import ROWS_PER_TASK


def never():
    return F.raise_error(F.lit("was computed")).cast("string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_sizes_are_exact_above_the_limit_only(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, F.lit(None)).otherwise(F.col("id")).alias("k"))
    assert scan._largest_group(rows, ("k",), 500) == (700, 1000)
    most, total = scan._largest_group(rows, ("k",), 900)
    assert 700 <= most <= 900 and total == 1000


def test_key_groups_are_counted_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(scan, "SIZE_BUCKETS", 1)
    rows = spark.range(100).withColumn("t", F.col("id"))
    spark.conf.set(ROWS_PER_TASK, "50")
    try:  # the one bucket is above the limit, its keys are not
        assert not scan.ordered(rows, ["id"], ["t"]).chunked
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_scan_without_key_is_cut_below_the_limit_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(scan, "KEYLESS_ROWS", 50)
    rows = spark.range(400).withColumn("t", F.col("id") % 7)
    found = scan.ordered(rows, [], ["t", "id"])
    assert found.chunked and found.df.select(scan.CHUNK).distinct().count() >= 4
    assert not scan.ordered(rows, ["t"], ["id"]).chunked
    got = scan.running(found, {"n": ("count", F.lit(1))}, inclusive=True).result()
    assert sorted(r.n for r in got.collect()) == list(range(1, 401))


def test_coarse_groups_spare_the_key(spark):
    rows = spark.range(20).select(F.col("id").alias("a"), never().alias("b"))
    assert not scan.ordered(rows, ["a", "b"], ["a"], coarse=["a"]).chunked


QUOTE = "quote_id string, batch int, event_id int, player_id int, book_id int, market string, side string, line double, american_odds int, captured_at int"


@pytest.fixture(scope="module")
def quotes(spark):
    rows = [
        (f"q{i}", i % 3, i % 2, 7, None if i % 11 == 0 else i % 4, "m", "over" if i % 5 < 3 else "under", None if i % 7 == 0 else i % 3 + 0.5, -110 + i, i // 3)
        for i in range(120)
    ]
    rows += [("n1", 9, 1, 1, 1, "m", "over", 1.5, None, 1), ("n2", 9, 1, 1, 1, "m", "under", 1.5, 100, 1)]
    return spark.createDataFrame(rows, QUOTE).cache()


def test_pairs_need_one_shuffle_and_equal_the_joined_form(spark, quotes):
    in_place = market.vig_removal(quotes)
    assert "Join" not in plan_of(in_place) and plan_of(in_place).count("Exchange hashpartitioning") == 1
    spark.conf.set(ROWS_PER_TASK, "1")
    try:
        joined = market.vig_removal(quotes)
        assert "Join" in plan_of(joined)
        same_rows(in_place, joined)
    finally:
        spark.conf.unset(ROWS_PER_TASK)


@pytest.mark.parametrize("limit", ["2", "1000000"])
def test_own_openings_need_no_join(spark, quotes, limit):
    want = market.opening_quote(quotes.select("*"), quotes)
    spark.conf.set(ROWS_PER_TASK, limit)
    try:
        got = market.opening_quote(quotes, quotes)
        if limit != "2":
            assert "Join" not in plan_of(got)
        same_rows(got, want)
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_movement_is_ordered_once(spark, quotes):
    assert "Window" not in plan_of(market.movement_summary(quotes))


def test_week_sizes_do_not_rate(spark):
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    rows = spark.range(5).select(F.col("id").alias("request_id"), at.alias("decided_at"), never().alias("rating"))
    paper.stake_allocation(rows, sizes_of=rows.select("decided_at"))


def test_score_equals_the_sum_of_its_components(spark):
    scores = [{"CAPABILITY_FIT": "0.1234565"}, {"LOAD_BALANCE": "1", "COST_PREFERENCE": "0.3333333333333"}, {}, {"CAPABILITY_FIT": None}]
    rows = spark.createDataFrame([(s,) for s in scores], "scores map<string,string>")
    found = rows.select(logs.weighted_score().alias("score"), logs.component_scores().alias("c")).collect()
    assert all(r.score == sum(c.weighted_score for c in r.c) for r in found) and found[0].score > 0


def test_baseline_queries_compute_no_other_features(spark, sf):
    from tallyfield.plans import catalog_research

    rows = catalog_research.held_out(spark, sf, catalog_research.BASELINE_INPUTS)
    assert set(catalog_research.BASELINE_INPUTS) <= set(rows.columns) and "targets_roll8" not in rows.columns
    assert len(rows.columns) < 16


def test_parts_of_a_quote_id_are_read_from_their_columns(spark, monkeypatch):
    from tallyfield.plans import catalog_market

    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = lambda: [catalog_market._id_part(i + 1, n).alias(f"p{i}") for i, n in enumerate(names)]
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    whole = spark.createDataFrame([(7, 1, 20, 3), (0, 2, 0, 4)], shape)
    odd = spark.createDataFrame([(None, 1, 20, 3, 17.0)], f"{shape}, l_quantity double")
    assert [tuple(r) for r in odd.select(*parts()).collect()] == [(1, 20, 3, 17)]
    monkeypatch.setattr(catalog_market.tables, "quote_id", never)  # the id of a whole row is not spelt
    assert [tuple(r) for r in whole.select(*parts()).collect()] == [(7, 1, 20, 3), (0, 2, 0, 4)]


def test_exclusion_codes_come_in_the_order_of_their_names(spark):
    assert "sort_array" not in logs.exclusion_reasons()._jc.toString()


def test_evaluations_carry_only_what_they_read(spark):
    from tallyfield.plans import evaluate

    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    numbers = [F.col("id").cast("double").alias(c) for c in evaluate.SCORED_INPUTS[3:]]
    rows = spark.range(3).select(F.lit("p").alias("source_player_id"), F.col("id").cast("string").alias("game_id"), at.alias("kickoff"), *numbers)
    based = evaluate.with_baselines_of(rows.withColumn("unread", never()))
    assert based.columns == [*evaluate.SCORED_INPUTS, "baselines"] and based.count() == 3
    assert "Window" not in plan_of(evaluate.with_baselines_of(based.select("*").localCheckpoint()))


def test_blocks_of_resamples_are_not_put_into_one_task(spark):
    from tallyfield.operators import resample

    rows = spark.range(60).select("id", F.col("id").cast("double").alias("v"))
    sums = resample.resampled_sums(rows, ["id"], {"v": F.col("v")}, 5, 1, rows_per_block=20)
    assert "REPARTITION_BY_NUM" in plan_of(sums)
    assert all(r.draws == 60 for r in sums.collect())


def test_candidates_are_ranked_without_maps_filters_or_code_lists(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["score_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and " map(" not in plan
    below = plan[plan.index("Window") :]
    assert "[ORGANIZATION_OR_WORKLOAD_MISMATCH]" not in below  # lists are built behind the shuffle


ODD_CANDIDATE = dict(
    request_id=1, worker_id="w", request_organization_id="o", organization_id="o", request_workload_context_id="w", workload_context_id="w",
    reference="r", digest="d", schema_version=logs.READINESS_VERSION, expires_at=datetime(2024, 1, 2), evaluation_boundary=datetime(2024, 1, 1), ready=True,
    required_capabilities=["a", None], capabilities=["a", None], hard_policy_pass=True, evidence_consistent=True, evaluated_at=datetime(2024, 1, 1), scores={"LOAD_BALANCE": "1"},
)
CANDIDATE = (
    "request_id int, worker_id string, request_organization_id string, organization_id string, request_workload_context_id string, "
    "workload_context_id string, reference string, digest string, schema_version string, expires_at timestamp_ntz, "
    "evaluation_boundary timestamp_ntz, ready boolean, required_capabilities array<string>, capabilities array<string>, "
    "hard_policy_pass boolean, evidence_consistent boolean, evaluated_at timestamp_ntz, scores map<string,string>"
)


def test_codes_of_missing_evidence(spark):
    cases = [
        ({}, []),
        ({"capabilities": [None, "b", "a"]}, []),
        ({"capabilities": ["a"]}, ["REQUIRED_CAPABILITY_MISSING"]),
        ({"capabilities": None, "ready": None, "expires_at": None, "organization_id": None}, []),
        ({"required_capabilities": None, "evidence_consistent": None, "schema_version": None}, []),
        ({"reference": None, "hard_policy_pass": None}, ["HARD_POLICY_EVIDENCE_UNAVAILABLE", "REQUIRED_EVIDENCE_INVALID"]),
        ({"evidence_consistent": False, "ready": False, "scores": None}, ["CONTRADICTORY_EVIDENCE", "WORKER_NOT_READY"]),
        ({"scores": None}, []),
    ]
    made = [tuple((ODD_CANDIDATE | over | {"worker_id": f"w{i}"}).values()) for i, (over, _) in enumerate(cases)]
    rows = logs.score_candidates(spark.createDataFrame(made, CANDIDATE)).orderBy("worker_id").collect()
    assert [r.exclusion_reasons for r in rows] == [want for _, want in cases]
    assert [r.eligible for r in rows] == [not want for _, want in cases]
    assert all((r.score is not None) == (r.rank is not None) == (r.components is not None) == r.eligible for r in rows)
    assert rows[0].score == 5 and rows[7].score == 0 and rows[7].rank == 5


def test_evidence_may_be_a_struct(spark):
    made = [tuple((ODD_CANDIDATE | {"worker_id": w, "scores": s}).values()) for w, s in (("a", {"LOAD_BALANCE": "1"}), ("b", {"LOAD_BALANCE": "0.5"}), ("c", None))]
    mapped = spark.createDataFrame(made, CANDIDATE)
    spelt = mapped.withColumn("scores", F.struct(F.col("scores")["LOAD_BALANCE"].alias("LOAD_BALANCE"), F.lit("9").alias("OTHER")))
    same_rows(logs.score_candidates(spelt).drop("scores"), logs.score_candidates(mapped).drop("scores"))
