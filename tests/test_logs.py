from datetime import datetime, timedelta
from decimal import Decimal

from tallyfield.operators import logs

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "request_id int, worker_id string, request_organization_id string, organization_id string, request_workload_context_id string, "
    "workload_context_id string, reference string, digest string, schema_version string, expires_at timestamp_ntz, "
    "evaluation_boundary timestamp_ntz, ready boolean, required_capabilities array<string>, capabilities array<string>, "
    "hard_policy_pass boolean, evidence_consistent boolean, evaluated_at timestamp_ntz, scores map<string,string>"
)


def row(worker, scores, request=1, **over):
    base = dict(
        request_id=request, worker_id=worker, ro="o", o="o", rw="w", w="w", reference="r", digest="d", schema_version=logs.READINESS_VERSION,
        expires=T0 + timedelta(1), boundary=T0, ready=True, required=["a"], capabilities=["a", "b"], policy=True, consistent=True, at=T0, scores=scores,
    )
    return tuple((base | over).values())


def test_scores_round_half_even_and_rank(spark):
    df = spark.createDataFrame(
        [
            row("w1", {"CAPABILITY_FIT": "0.1234565"}),
            row("w3", {"CAPABILITY_FIT": "0.9"}, at=T0 + timedelta(1)),
            row("w2", {"CAPABILITY_FIT": "0.9"}),
            row("w4", {"CAPABILITY_FIT": "1"}, ready=False, policy=None, capabilities=[]),
        ],
        SCHEMA,
    )
    got = {r.worker_id: r for r in logs.score_candidates(df).collect()}
    assert got["w1"].score == Decimal("4.938240") and got["w1"].components[0].normalized_value == Decimal("0.123456")
    assert [got[w].rank for w in ("w2", "w3", "w1", "w4")] == [1, 2, 3, None]
    assert got["w4"].exclusion_reasons == ["HARD_POLICY_EVIDENCE_UNAVAILABLE", "REQUIRED_CAPABILITY_MISSING", "WORKER_NOT_READY"]
    assert got["w1"].components[1].reason_code == "ORGANIZATION_POLICY_PREFERENCE_EVIDENCE_MISSING"
    bad = spark.createDataFrame([row("w", {"CAPABILITY_FIT": "1.5", "LOAD_BALANCE": "x", "OTHER": "9"})], SCHEMA)
    assert logs.score_violations(bad).count() == 2


def test_outcomes(spark):
    df = spark.createDataFrame(
        [
            row("a", {}, 1),
            row("a", {}, 2, consistent=False),
            row("a", {}, 3, policy=None),
            row("a", {}, 4, policy=False),
            row("a", {}, 5, expires=T0 - timedelta(1)),
            row("a", {}, 6, ready=False),
        ],
        SCHEMA,
    )
    got = {r.request_id: r.outcome for r in logs.selection_outcomes(logs.score_candidates(df)).collect()}
    assert got == {1: "CANDIDATE_FOUND", 2: "INDETERMINATE", 3: "EVIDENCE_UNAVAILABLE", 4: "POLICY_FILTERED", 5: "EVIDENCE_UNAVAILABLE", 6: "NO_ELIGIBLE_WORKERS"}


def test_versioned_log_continues_and_finds_conflicts(spark):
    entries = spark.createDataFrame(
        [("s", "k1", "a", T0, 1), ("s", "k1", "a", T0 + timedelta(1), 2), ("s", "k1", "b", T0 + timedelta(2), 3), ("s", "k2", "a", T0 + timedelta(3), 4)],
        "stream string, idempotency_key string, content string, appended_at timestamp_ntz, entry_id int",
    )
    first = {r.entry_id: r for r in logs.versioned_log(entries).collect()}
    assert [(first[i].outcome, first[i].version) for i in range(1, 5)] == [("APPENDED", 1), ("EXISTING", 1), ("CONFLICT", 1), ("APPENDED", 2)]
    log = logs.versioned_log(entries).filter("outcome = 'APPENDED'").select("stream", "idempotency_key", "content_digest", "version")
    more = spark.createDataFrame(
        [("s", "k2", "a", T0 + timedelta(9), 5), ("s", "k3", "z", T0 + timedelta(9), 6), ("t", "k1", "z", T0 + timedelta(9), 7)], entries.schema
    )
    second = {r.entry_id: (r.outcome, r.version) for r in logs.versioned_log(more, log).collect()}
    assert second == {5: ("EXISTING", 2), 6: ("APPENDED", 3), 7: ("APPENDED", 1)}
    assert logs.log_gaps(log).count() == 0 and logs.log_gaps(log.filter("version <> 1")).collect() == [("s", 1, 1)]


def test_append_log_is_idempotent(spark, tmp_path):
    schema = "stream string, idempotency_key string, content string, appended_at timestamp_ntz, entry_id int"
    one = spark.createDataFrame([("s", "k1", "a", T0, 1), ("s", "k1", "b", T0, 2), ("t", "k1", "a", T0, 3)], schema)
    two = spark.createDataFrame([("s", "k2", "a", T0, 4), ("s", "k1", "a", T0, 5), ("t", "k9", "a", T0, 6), ("u", "k", "a", T0, 7), ("s", "k1", "a", T0, 1)], schema)
    path = str(tmp_path / "log")
    as_set = lambda df: {(r.entry_id, r.outcome, r.version) for r in df.collect()}
    first = as_set(logs.append_log(one, path, "a"))
    assert first == {(1, "APPENDED", 1), (2, "CONFLICT", 1), (3, "APPENDED", 1)}
    second = as_set(logs.append_log(two, path, "b"))
    assert second == {(4, "APPENDED", 2), (5, "EXISTING", 1), (6, "APPENDED", 2), (7, "APPENDED", 1), (1, "APPENDED", 1)}
    assert as_set(logs.append_log(one, path, "a")) == first and as_set(logs.append_log(two, path, "b")) == second
    (tmp_path / "log" / "batch=b" / "_SUCCESS").unlink()  # an append that broke off
    assert logs.read_log(spark, path).count() == 2
    assert as_set(logs.append_log(two, path, "b")) == second and logs.read_log(spark, path).count() == 5


def test_gaps_of_a_long_stream(spark, split_groups):
    gone = {1, 2, 9, 30, 31, 32, 47}
    log = spark.createDataFrame([(s, v) for s in "ab" for v in range(1, 50) if s == "b" or v not in gone], "stream string, version long")
    assert sorted(logs.log_gaps(log).collect()) == [("a", 1, 2), ("a", 9, 9), ("a", 30, 32), ("a", 47, 47)]


def test_validity_gate(spark):
    requests = spark.createDataFrame([(1, 1, T0), (2, 2, T0), (3, 3, T0)], "request_id int, lease_id int, instant timestamp_ntz")
    day = timedelta(1)
    leases = spark.createDataFrame(
        [(1, True, T0, T0, False), (2, True, T0 + day, T0 - day, True), (3, False, T0, T0, False)], "lease_id int, bounded boolean, effective_at timestamp_ntz, expires_at timestamp_ntz, revoked boolean"
    )
    ready = spark.createDataFrame(
        [(1, T0, False), (2, T0 - day, False), (2, T0 + day, True)], "lease_id int, ready_expires_at timestamp_ntz, superseded boolean"
    )
    got = {r.request_id: r for r in logs.validity_gate(requests, leases, ready).collect()}
    assert got[1].outcome == "APPROVED" and got[1].reasons == ["OFFER_APPROVED"]
    assert got[2].reasons == ["LEASE_EXPIRED", "LEASE_INAPPLICABLE", "LEASE_REVOKED", "READINESS_EXPIRED", "READINESS_SUPERSEDED"]
    assert got[3].reasons == ["LEASE_INAPPLICABLE"]
