import numpy as np
import pytest

from tallyfield.llm import ann
from tallyfield.llm.queries import QUERIES


def exact(rows, every, k):
    """Brute force; rows are (vec_id, vector), usable and of one length."""
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, (q, _) in enumerate(rows):
        if q % every == 0:
            best = {}
            for (d, _), s in zip(rows, x @ x[i], strict=True):
                if d != q:
                    best[d] = max(best.get(d, -2), s)
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_query_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, 50, 5)
    got = {}
    for r in QUERIES["op6_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    found = 0
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        scores = [ranks[n][1] for n in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
        assert all(s == pytest.approx(unit[q] @ unit[i], abs=1e-12) for i, s in ranks.values())
        found += len({i for i, _ in ranks.values()} & {i for i, _ in want[q]})
    assert found >= 0.9 * 5 * len(want)


def test_parts_are_balanced_and_follow_the_graph():
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(8, 12))
    x = centres[np.arange(640) % 8] + pick.normal(size=(640, 12)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(x, 10)
    part = ann.balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(ann.IMBALANCE * 80)
    assert (part[graph] == part[:, None]).mean() > 0.9
    assert ann.fit_router(x, 8).probes <= 2


def test_copies_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    pick = np.random.default_rng(3)
    base = pick.normal(size=8)
    rows = [(i, base.tolist()) for i in range(60)] + [(100 + i, pick.normal(size=8).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, every=10, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 60, 10):
        assert [i for _, i in sorted(got[q])] == [i for i in range(4) if i != q][:3]


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [1.0, None]),
        (None, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (300, []),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, ann.nearest(frame).collect()))
    half = pytest.approx(0.5**0.5)
    assert got == [(0, 1, 3, 1.0), (0, 2, 50, half), (50, 1, 0, half), (50, 2, 3, half)]
    assert ann.nearest(frame.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.nearest(frame.limit(0)).count() == 0
