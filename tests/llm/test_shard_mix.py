import zlib

import duckdb
import pytest

from check_oracle import TABLES, rows
from tallyfield.llm import mixing, sharding
from tallyfield.llm.queries import QUERIES
from tallyfield.llm.sql import ORACLES

ODD = [
    (1, None, "a", 3), (2, "", "a", 4), (3, "x", None, 5), (3, "x", None, 5), (None, "y z", "", 6),
    (4, "é" * 40_000 + " w", "b", 7), (5, " \t ", "b", 8), (6, "one two three", "c", 9), (7, "w " * 500, "c", 1),
]


@pytest.fixture
def odd(spark):
    # The extra columns carry names that the operators use inside.
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, _size long")


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_sharding", "op10_mixing"])
def test_query_equals_its_twin(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cursor = db.execute(ORACLES[name])
    assert got == rows(cursor.fetchall(), [d[0] for d in cursor.description])


def test_shards_of_odd_rows(odd):
    got = sharding.byte_shards(odd, 3).collect()
    assert len(got) == len(ODD)
    sizes = {d: len((t or "").encode()) + 1 for d, t, _, _ in ODD}
    assert {r.doc_id: r.size for r in got} == sizes
    assert {r.doc_id: r.text_crc32 for r in got} == {d: zlib.crc32((t or "").encode()) for d, t, _, _ in ODD}
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or 0 for r in ordered] == sorted(d or 0 for d, *_ in ODD)
    for shard in {r.shard for r in got}:
        assert [r.slot for r in ordered if r.shard == shard] == list(range(sum(r.shard == shard for r in got)))
    assert sharding.byte_shards(odd.limit(0)).count() == 0


def test_shards_are_balanced(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', int(id % 50)) as text")
    sums = [r[1] for r in sharding.byte_shards(docs).groupBy("shard").sum("size").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 2 * 50


def test_mix_of_odd_rows(odd):
    got = {(r.doc_id, r.taken, r.size) for r in mixing.taken_words(odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (5, 0, 0)} <= got
    assert mixing.taken_words(odd).count() == len(ODD)
    again = mixing.mixed(odd)
    assert again.columns == odd.columns
    counts = {}
    for r in again.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    copies = {}
    for r in mixing.mix(odd.drop("_size")).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r["_copies"]
    assert counts == {d: n for d, n in copies.items() if n}
    assert mixing.mixed(odd.limit(0)).count() == 0 and mixing.taken_words(odd.limit(0)).count() == 0


def test_mix_meets_targets_with_a_hot_source(spark):
    docs = spark.range(6000).selectExpr(
        "id as doc_id", "repeat('w ', int(id % 7) + 1) as text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) as source"
    )
    got = mixing.taken_words(docs).groupBy("source_size", "target").agg({"taken": "sum", "size": "sum"}).collect()
    total = sum(r["sum(size)"] for r in got)
    assert abs(sum(r["sum(taken)"] for r in got) - 1.5 * total) <= 7
    assert abs(sum(r.target * (r["sum(size)"] / r.source_size) for r in got) - 1.5 * total) < 1e-6 * total
    for r in got:
        sources = r["sum(size)"] / r.source_size
        assert abs(r["sum(taken)"] - r.target * sources) <= 14 * sources
    taken = mixing.taken_words(docs)
    assert taken.filter("taken > 2 * size").count() == 0
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, mixing.taken_words(docs.repartition(5)).collect()))
