"""Append-only records: versioned logs, validity gates, weighted ranking, replay, references."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import WindowSpec

from tallyfield.functions.digests import row_digest
from tallyfield.operators.scan import look_back, ordered, running, with_totals
from tallyfield.session import materialize

# Score components, weights and codes of the ranking policy.
COMPONENTS = {
    "CAPABILITY_FIT": 40,
    "ORGANIZATION_POLICY_PREFERENCE": 20,
    "LATENCY_OBJECTIVE": 15,
    "COST_PREFERENCE": 10,
    "AFFINITY_PREFERENCE": 10,
    "LOAD_BALANCE": 5,
}
READINESS_VERSION = "worker-readiness.v1"
_SCALE = "decimal(12,6)"


def _exclusions() -> dict[str, Column]:
    """Condition of every exclusion code, in the order of their names, so that a row's codes need no sort."""
    mismatch = (F.col("organization_id") != F.col("request_organization_id")) | (
        F.col("workload_context_id") != F.col("request_workload_context_id")
    )
    # Equal lists, the common case, need no set.
    required, capabilities = F.col("required_capabilities"), F.col("capabilities")
    missing = (required != capabilities) & (F.size(F.array_except(required, capabilities)) > 0)
    invalid = (F.coalesce("reference", F.lit("")) == "") | (F.coalesce("digest", F.lit("")) == "")
    return {
        "CONTRADICTORY_EVIDENCE": ~F.col("evidence_consistent"),
        "HARD_POLICY_EVIDENCE_UNAVAILABLE": F.col("hard_policy_pass").isNull(),
        "HARD_POLICY_FILTERED": ~F.col("hard_policy_pass"),
        "ORGANIZATION_OR_WORKLOAD_MISMATCH": mismatch,
        "READINESS_EXPIRED": F.col("expires_at") < F.col("evaluation_boundary"),
        "READINESS_VERSION_UNSUPPORTED": F.col("schema_version") != READINESS_VERSION,
        "REQUIRED_CAPABILITY_MISSING": missing,
        "REQUIRED_EVIDENCE_INVALID": invalid,
        "WORKER_NOT_READY": ~F.col("ready"),
    }


def _codes_of(conditions: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds; joined from short arrays, as a filter would be interpreted."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(c, F.array(F.lit(code))).otherwise(none) for code, c in conditions.items()])


def exclusion_reasons() -> Column:
    """Sorted codes of everything that keeps a candidate out."""
    return _codes_of(_exclusions())


def _evidence(code: str) -> Column:
    return F.try_element_at(F.col("scores"), F.lit(code))


def _evidence_in(candidates: DataFrame) -> Callable[[str], Column]:
    """How the evidence of a component is read: from a map, or from a struct, which needs no map in each row."""
    kind = candidates.schema["scores"].dataType
    if not isinstance(kind, StructType):
        return _evidence
    return lambda code: F.col(f"scores.{code}") if code in kind.names else F.lit(None).cast("string")


def _normalized(raw: Column) -> Column:
    """Score evidence of a component with six digits; zero where there is none."""
    return F.coalesce(F.bround(raw.cast("decimal(30,20)"), 6).cast(_SCALE), F.lit(0).cast(_SCALE))


def weighted_score(evidence: Callable[[str], Column] = _evidence) -> Column:
    """Sum of the weighted components, without the rest of their rows."""
    total = F.lit(0).cast(_SCALE)
    for code, weight in COMPONENTS.items():
        total = (total + (_normalized(evidence(code)) * F.lit(weight)).cast(_SCALE)).cast(_SCALE)
    return total


def component_scores(evidence: Callable[[str], Column] = _evidence) -> Column:
    """Array of (code, raw, normalized, weight, weighted, reason) in policy order."""
    entries = []
    for code, weight in COMPONENTS.items():
        raw = evidence(code)
        value = _normalized(raw)
        entries.append(
            F.struct(
                F.lit(code).alias("component_code"),
                raw.alias("raw_value"),
                value.alias("normalized_value"),
                F.lit(weight).alias("weight"),
                (value * F.lit(weight)).cast(_SCALE).alias("weighted_score"),
                F.when(raw.isNull(), f"{code}_EVIDENCE_MISSING").otherwise(f"{code}_SCORED").alias("reason_code"),
            )
        )
    return F.array(*entries)


def score_violations(candidates: DataFrame) -> DataFrame:
    """Score evidence that is no decimal in [0, 1]."""
    entries = candidates.select("request_id", "worker_id", F.explode("scores").alias("component_code", "raw_value"))
    value = F.col("raw_value").try_cast("decimal(30,20)")
    bad = F.col("raw_value").isNotNull() & (value.isNull() | (value < 0) | (value > 1))
    return entries.filter(F.col("component_code").isin(*COMPONENTS) & bad)


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Exclusion reasons, exact weighted score and rank per request.

    ``scores`` is a map or a struct from component to evidence. Scores outside [0, 1] are
    violations (see ``score_violations``).
    """
    evidence = _evidence_in(candidates)
    # Codes travel as the bits of a number and become an array behind the shuffle.
    bits = {code: 1 << i for i, code in enumerate(_exclusions())}
    codes = sum((F.when(c, bits[code]).otherwise(0) for code, c in _exclusions().items()), F.lit(0))
    rows = candidates.withColumn("_codes", codes)
    # Excluded rows sort behind every eligible row of the request, then lose their rank.
    score = F.when(F.col("_codes") == 0, weighted_score(evidence)).otherwise(F.lit(-1).cast(_SCALE))
    rows = rows.withColumn("_order", score)
    scan = ordered(rows, ["request_id"], ["-_order", "evaluated_at", "worker_id"], sizes_of=candidates)
    ranked = running(scan, {"_rank": ("count", F.lit(1))}, inclusive=True).result()
    eligible = F.col("_codes") == 0
    return ranked.select(
        *candidates.columns,
        _codes_of({code: F.col("_codes").bitwiseAND(bit) != 0 for code, bit in bits.items()}).alias("exclusion_reasons"),
        eligible.alias("eligible"),
        F.when(eligible, component_scores(evidence)).alias("components"),
        F.when(eligible, F.col("_order")).alias("score"),
        F.when(eligible, F.col("_rank")).alias("rank"),
    )


def selection_outcomes(scored: DataFrame) -> DataFrame:
    """One verdict per request, from flags that combine map-side."""
    has = lambda code: F.array_contains("exclusion_reasons", code)
    only_policy = F.forall("exclusion_reasons", lambda r: r == "HARD_POLICY_FILTERED")
    unavailable = [
        "ORGANIZATION_OR_WORKLOAD_MISMATCH",
        "REQUIRED_EVIDENCE_INVALID",
        "READINESS_VERSION_UNSUPPORTED",
        "READINESS_EXPIRED",
        "REQUIRED_CAPABILITY_MISSING",
    ]
    blocked = F.arrays_overlap("exclusion_reasons", F.array(*[F.lit(c) for c in unavailable]))
    flags = scored.groupBy("request_id").agg(
        F.count_if("eligible").alias("candidates"),
        F.count_if(~F.col("eligible")).alias("excluded"),
        F.bool_or(has("CONTRADICTORY_EVIDENCE")).alias("_contradictory"),
        F.bool_or(has("HARD_POLICY_EVIDENCE_UNAVAILABLE")).alias("_no_policy"),
        F.bool_and(only_policy).alias("_only_policy"),
        F.bool_or(blocked).alias("_blocked"),
    )
    outcome = (
        F.when(F.col("candidates") > 0, "CANDIDATE_FOUND")
        .when(F.col("_contradictory"), "INDETERMINATE")
        .when(F.col("_no_policy"), "EVIDENCE_UNAVAILABLE")
        .when(F.col("_only_policy"), "POLICY_FILTERED")
        .when(F.col("_blocked"), "EVIDENCE_UNAVAILABLE")
        .otherwise("NO_ELIGIBLE_WORKERS")
    )
    return flags.select("request_id", outcome.alias("outcome"), "candidates", "excluded")


def validity_gate(requests: DataFrame, leases: DataFrame, readiness: DataFrame) -> DataFrame:
    """Approve or deny each request at its instant against its lease and readiness evidence.

    A request without a lease is denied as ``LEASE_NOT_FOUND``.
    """
    # Any readiness row past its expiry is the earliest one past it.
    ready = readiness.groupBy("lease_id").agg(
        F.min("ready_expires_at").alias("ready_expires_at"), F.bool_or("superseded").alias("superseded")
    )
    known = leases.withColumn("_known", F.lit(True))
    rows = with_totals(requests.join(known, "lease_id", "left"), ready, ["lease_id"])
    at = F.col("instant")
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("_known").isNull(), "LEASE_NOT_FOUND"),
                F.when(~F.col("bounded") | (at < F.col("effective_at")), "LEASE_INAPPLICABLE"),
                F.when(at > F.col("expires_at"), "LEASE_EXPIRED"),
                F.when(F.col("revoked"), "LEASE_REVOKED"),
                F.when(at > F.col("ready_expires_at"), "READINESS_EXPIRED"),
                F.when(F.col("superseded"), "READINESS_SUPERSEDED"),
            )
        )
    )
    rows = rows.withColumn("_r", reasons)
    return rows.select(
        *requests.columns,
        F.when(F.size("_r") > 0, "DENIED").otherwise("APPROVED").alias("outcome"),
        F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.array(F.lit("OFFER_APPROVED"))).alias("reasons"),
    )


def versioned_log(entries: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Outcome and version of each append: new, already present, or in conflict.

    ``entries``: stream, idempotency_key, content, appended_at, entry_id. ``log`` holds
    earlier versions (stream, idempotency_key, content_digest, version).
    """
    key = ["stream", "idempotency_key"]
    rows = entries.withColumn("content_digest", F.sha2(F.col("content").cast("string"), 256))
    firsts = rows.groupBy(*key).agg(
        F.min_by(F.struct("appended_at", "entry_id", "content_digest"), F.struct("appended_at", "entry_id")).alias("_f")
    )
    firsts = firsts.select(*key, "_f.appended_at", "_f.entry_id", F.col("_f.content_digest").alias("first_digest"))
    if log is not None:
        # An entry that is sent again is told what it was told first.
        sent = [F.col("entry_id").alias("_first")] if "entry_id" in log.columns else []
        known = log.select(*key, F.col("content_digest").alias("first_digest"), "version", *sent)
        top = log.groupBy("stream").agg(F.max("version").alias("_top"))
        firsts = with_totals(firsts.join(known.select(*key), key, "left_anti"), top, ["stream"])
    else:
        firsts = firsts.withColumn("_top", F.lit(0))
    scan = running(ordered(firsts, ["stream"], ["appended_at", "entry_id"]), {"_n": ("count", F.lit(1))}, inclusive=True)
    fresh = scan.result().select(
        *key, "first_digest", (F.col("_n") + F.coalesce("_top", F.lit(0))).alias("version"), F.col("entry_id").alias("_first")
    )
    if log is not None:
        fresh = fresh.unionByName(known, allowMissingColumns=True)
    joined = with_totals(rows, fresh, key, "inner")
    outcome = (
        F.when(F.col("entry_id").eqNullSafe(F.col("_first")), "APPENDED")
        .when(F.col("content_digest") == F.col("first_digest"), "EXISTING")
        .otherwise("CONFLICT")
    )
    return joined.select("entry_id", *key, "content_digest", outcome.alias("outcome"), "version")


def append_log(entries: DataFrame, path: str, batch: str) -> DataFrame:
    """Append a batch to the log stored at ``path``; returns each entry's outcome and version.

    Numbers continue from every stream's highest version. A batch writes its new versions into
    a folder of its own, whose success marker ends it: without the marker a batch that is run
    again replaces what it left, with it nothing is written and every entry gets its first answer.
    """
    batches = _batches(entries.sparkSession, path)
    complete = batches.pop(batch, False)
    if complete:
        return versioned_log(entries, read_log(entries.sparkSession, path))
    others = [name for name, ended in batches.items() if ended]
    log = read_log(entries.sparkSession, path, others) if others else None
    done = materialize(versioned_log(entries, log))
    fresh = done.filter(F.col("outcome") == "APPENDED").select("stream", "idempotency_key", "content_digest", "version", "entry_id")
    if log is not None:  # entries of other batches that were sent again
        fresh = fresh.join(log.select("stream", "idempotency_key"), ["stream", "idempotency_key"], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return done


def _batches(spark: SparkSession, path: str) -> dict[str, bool]:
    """Batches at ``path`` and whether each has ended."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=")]
    return {p.getName()[6:]: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in found}


def read_log(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> DataFrame:
    """Versions of the given batches at ``path``, or of all that have ended."""
    names = [b for b, ended in _batches(spark, path).items() if ended] if batches is None else batches
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in names])


def log_gaps(log: DataFrame) -> DataFrame:
    """Missing versions of every stream as ranges ``missing_from``..``missing_to``.

    A version is compared with the one before it in its stream; a stream of very many versions
    is cut into chunks. Missing versions above the highest one cannot be known.
    """

    def build(df: DataFrame, window: WindowSpec) -> DataFrame:
        return df.withColumn("_before", F.coalesce(F.lag("version").over(window), F.lit(0)))

    rows = look_back(ordered(log.select("stream", "version"), ["stream"], ["version"]), 1, build).result()
    missing = rows.filter(F.col("version") - F.col("_before") > 1)
    return missing.select("stream", (F.col("_before") + 1).alias("missing_from"), (F.col("version") - 1).alias("missing_to"))


def replay_verify(recorded: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Decisions whose recomputation differs from the record, or exists on one side only."""
    a = recorded.select(key, row_digest(columns).alias("recorded_digest"))
    b = recomputed.select(key, row_digest(columns).alias("recomputed_digest"))
    joined = a.join(b, key, "full_outer")
    return joined.filter(~F.col("recorded_digest").eqNullSafe(F.col("recomputed_digest")))


def evidence_reference_check(requests: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """Violation codes of each request's references.

    For every kind a request carries ``<kind>_reference`` and ``<kind>_digest``; the evidence
    frame has ``scope``, ``reference`` and ``digest``. A reference must exist exactly once in
    the request's scope and with the same digest.
    """
    rows, codes = requests, []
    for kind, frame in evidence.items():
        known = frame.groupBy(F.col("scope"), F.col("reference").alias(f"{kind}_reference")).agg(
            F.count("*").alias(f"_{kind}_n"), F.min("digest").alias(f"_{kind}_digest")
        )
        rows = with_totals(rows, known, ["scope", f"{kind}_reference"])
        code = kind.upper()
        codes += [
            F.when(F.col(f"_{kind}_n").isNull(), f"{code}_REFERENCE_MISSING"),
            F.when(F.col(f"_{kind}_n") > 1, f"{code}_REFERENCE_AMBIGUOUS"),
            F.when(F.col(f"_{kind}_digest") != F.col(f"{kind}_digest"), f"{code}_DIGEST_MISMATCH"),
        ]
    return rows.select(*requests.columns, F.array_sort(F.array_compact(F.array(*codes))).alias("violations"))
