import random

import pytest
from conftest import same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators.scan import exact_quantiles, look_back, ordered, running, wide_medians, with_totals
from tallyfield.session import ROWS_PER_TASK, materialize


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        key = "hot" if i % 3 else rng.choice(["a", "b", None, "c", "d"])
        value = None if rng.random() < 0.2 else float(rng.randint(-9, 9))
        rows.append((key, rng.randint(0, 40), i, value))
    return spark.createDataFrame(rows, "k string, t int, id int, v double").cache()


@pytest.mark.parametrize("limit", ["3", "40", "1000000"])
def test_look_back_equals_plain_window(spark, skewed, limit):
    def build(df, w):
        frame = w.rowsBetween(-8, -1)
        return df.withColumns(
            {"lag1": F.lag("v").over(w), "n": F.count("v").over(frame), "s": F.sum("v").over(frame), "l8": F.lag("id", 8).over(w)}
        )

    spark.conf.set(ROWS_PER_TASK, limit)
    try:
        scan = ordered(skewed, ["k"], ["t", "-id"])
        assert scan.chunked == (limit != "1000000")
        got = look_back(scan, 8, build).result()
        same_rows(got, build(skewed, Window.partitionBy("k").orderBy("t", F.desc("id"))))
    finally:
        spark.conf.unset(ROWS_PER_TASK)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_plain_window(spark, skewed, keys, inclusive):
    specs = {
        "s": ("sum", F.col("v")),
        "n": ("count", F.col("v")),
        "hi": ("max", F.col("v")),
        "lo": ("min", F.col("v")),
    }
    base = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("t", "id")
    frame = base.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    kinds = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    want = skewed.withColumns({n: kinds[k](e).over(frame) for n, (k, e) in specs.items()})
    spark.conf.set(ROWS_PER_TASK, "7")
    try:
        same_rows(running(ordered(skewed, keys, ["t", "id"]), specs, inclusive=inclusive).result(), want)
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_running_with_refined_key(spark, skewed, split_groups):
    rows = skewed.withColumn("season", (F.col("t") / 10).cast("int"))
    got = running(ordered(rows, ["k"], ["t", "id"]), {"s": ("sum", F.col("v"))}, by=["season"]).result()
    frame = Window.partitionBy("k", "season").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    same_rows(got, rows.withColumn("s", F.sum("v").over(frame)))


@pytest.mark.parametrize("limit", ["4", "1000000"])
@pytest.mark.parametrize("groups", [["k"], []])
def test_exact_quantiles_equal_percentile(spark, skewed, groups, limit):
    probs = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q90": 0.9}
    spark.conf.set(ROWS_PER_TASK, limit)
    try:
        got = exact_quantiles(skewed, groups, "v", probs)
        want = skewed.groupBy(*groups).agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
        same_rows(got, want)
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_a_hot_key_is_split_in_a_join_with_totals(spark):
    """The finished plan says so; the same join without the stored totals cannot be split."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), "id")
    totals = rows.groupBy("k").agg(F.count("*").alias("n"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # More than one file, so that the hot key's rows come from several map tasks.
        plans = []
        for joined in (with_totals(materialize(rows.repartition(8)), totals, ["k"]), materialize(rows.repartition(8)).join(totals, "k", "left")):
            assert joined.filter("k = 7 and n <> 180001 and n <> 180000").count() == 0
            joined.write.format("noop").mode("overwrite").save()
            joined.collect()
            plans.append(joined._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plans[0] and "skew=true" not in plans[1]


def test_wide_medians_are_exact(spark):
    import statistics

    rng = random.Random(11)
    rows = [(i, float(rng.randint(0, 5)) if i % 7 else None, rng.gauss(0, 1), None, 3.0, float(i % 2)) for i in range(5001)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double")
    for frame, n in ((df, 5001), (df.filter("id < 4"), 4), (df.filter("id = 1"), 1)):
        want = {}
        for k, name in enumerate("abcde", 1):
            values = [r[k] for r in rows[:n] if r[k] is not None] if n != 1 else [rows[1][k]] if rows[1][k] is not None else []
            want[name] = statistics.median(values) if values else None
        for most in (100_000, 1, 40):  # 1 and 40: the brackets are narrowed, or end at one value
            got = wide_medians(frame, list("abcde"), exact_below=max(most, 1))
            assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {k: v if v is None else round(v, 9) for k, v in want.items()}
    assert set(wide_medians(df.filter("false"), ["a"]).values()) == {None}


def test_flags_of_whole_and_of_split_names_agree(spark, sf):
    """Contracts are checked beside their names without a join; split names give the same flags."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from tallyfield.operators import quality
    from tallyfield.session import ROWS_PER_TASK
    from tallyfield.sources import tables

    rows = tables.raw_offers(spark, sf).withColumn("event_id", F.lit("E"))
    rows = rows.withColumn("player", F.when(F.col("player") != " ", F.concat(F.lit("P"), F.crc32("record_index") % 9)).otherwise(" "))
    flags = lambda: quality.flag_offers(rows, datetime(1998, 1, 1)).select("payload_id", "record_index", "reject_category", F.array_join("warnings", ";").alias("w"))
    whole = flags()
    assert " Join " not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, whole.collect()), key=str)
    assert any(r[2] == "DUPLICATE_CONTRACT" for r in got)
    spark.conf.set(ROWS_PER_TASK, "5")
    try:
        assert sorted(map(tuple, flags().collect()), key=str) == got
    finally:
        spark.conf.unset(ROWS_PER_TASK)
