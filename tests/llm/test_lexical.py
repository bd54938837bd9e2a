import math
import random
import re
from collections import Counter
from itertools import accumulate

from tallyfield.llm import lexical
from tallyfield.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, queries):
    """Scores of every document for every query, one by one."""
    counts = [(d, Counter(w.translate(LOWER) for w in WORD.findall(t or ""))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in sorted(set(queries), key=str):
        asked = Counter(w.translate(LOWER) for w in WORD.findall(text or ""))
        scored = []
        for doc, c in counts:
            m = 25 + (75 * c.total() * n) // length
            score = sum(
                k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                for w, k in asked.items()
                if c[w]
            )
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored)[:10])]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    queries = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert ordered(QUERIES["op11_lexical"](spark, sf).collect()) == ordered(plain(docs, queries))


def invented(rng, n):
    words = [f"w{k}" for k in range(40)] + ["é", "日本", "Z9"]
    return [" ".join(rng.choices(words, k=rng.choice((1, 3, 30, 31, 200)))) for _ in range(n)]


def test_small_pieces_blocks_and_pruning_change_nothing(spark):
    rng = random.Random(5)
    docs = list(enumerate(invented(rng, 300))) + [(1000 + k, "w1 w2 w3 rare") for k in range(60)]
    queries = list(enumerate(invented(rng, 12))) + [(50, "rare w1 w1"), (51, "absent"), (52, "w1 " * 5000)]
    want = ordered(plain(docs, queries))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    index = lexical.build_index(frame, piece_postings=60)
    found = lexical.search(index, asked, block_bytes=200)
    assert ordered(found.select("item_id", "rank", "doc_id", "score").collect()) == want
    strata = index.strata.df
    assert strata.count() > strata.select("m").distinct().count() > 5
    read = found.groupBy("item_id").agg({"visits": "max", "strata": "max"}).collect()
    assert any(r["max(visits)"] < r["max(strata)"] for r in read)
    index.drop()


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha BETA"), (-5, "alpha beta"), (6, "alpha " * 100_000),
        (7, "q" * 300_000), (8, "é e E"), (9, "9 nine"),
    ]
    queries = [(1, "ALPHA beta alpha"), (1, "ALPHA beta alpha"), (2, None), (3, ""), (4, "nothing"), (None, "é"), (6, "Q" * 300_000)]
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, m int, terms binary")
    asked = spark.createDataFrame([(*q, 3) for q in queries], "item_id long, text string, rank int")
    got = lexical.rank_documents(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ordered(got.collect()) == ordered(plain(docs, queries))


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(frame.limit(0), asked).collect() == []
    assert lexical.rank_documents(frame, asked.limit(0)).collect() == []


def test_impacts_bound_a_stratum(spark):
    rng = random.Random(9)
    frame = spark.createDataFrame(list(enumerate(invented(rng, 80))), "doc_id long, text string")
    index = lexical.build_index(frame)
    for row in index.strata.df.collect():
        runs, tfs = list(accumulate(memoryview(row.term_runs).cast("H"), initial=0)), memoryview(row.run_tfs).cast("i")
        assert runs[-1] == len(tfs) == len(memoryview(row.run_sizes).cast("H"))
        for first, last in zip(runs[:-1], runs[1:], strict=True):
            assert list(tfs[first:last]) == sorted(set(tfs[first:last]), reverse=True)
