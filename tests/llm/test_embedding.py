import numpy as np
import pytest

from tallyfield.llm import embedding
from tallyfield.llm.queries import QUERIES


def plain(rows, threshold=0.98):
    """Brute force over all pairs; rows are (vec_id, vector, label)."""

    def usable(row):
        v = row[1]
        return row[0] is not None and row[2] is not None and v and None not in v and np.isfinite(v).all() and any(v)

    good = [i for i, r in enumerate(rows) if usable(r)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    links, group = {i: 0 for i in range(len(rows))}, list(range(len(rows)))
    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        least = min(ids) if r[0] is not None else None
        out.append((r[0], links[i], least, r[0] is None or least == r[0]))
    return sorted(out, key=str)


def near_copies(pick, count, labels=3, width=16):
    rows = []
    for i in range(count):
        v = pick.normal(size=width)
        rows.append((i, v.tolist(), int(pick.integers(labels))))
        for _ in range(int(pick.integers(0, 4))):
            w = v + pick.normal(size=width) * pick.choice([0.0, 0.03, 0.05])
            rows.append((count + len(rows), (w * pick.choice([1.0, 3.0])).tolist(), rows[-1][2]))
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding.link_classes, "__defaults__", (embedding.THRESHOLD, block))
    pick = np.random.default_rng(4)
    rows = near_copies(pick, 40)
    hub = pick.normal(size=16)
    rows += [(1000 + i, (hub + pick.normal(size=16) * 0.01).tolist(), 1) for i in range(40)]
    rows += [(2000 + i, hub.tolist(), 1) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in embedding.near_duplicates(frame).collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1e200, 2e200], 1), (9, [1e-200, 2e-200], 1),
        (10, [1.0, 2.0, 0.0], 1), (11, [1.0, 2.0], 2), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3), (8, [5.0, -1.0], 1),
    ]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    tiny = [(i, [x * 1e-200 if x == 1e200 or x == 2e200 else x * 1e200 if 0 < x < 1e-100 else x for x in v] if v and None not in v else v, y) for i, v, y in rows]
    assert sorted((tuple(r) for r in embedding.near_duplicates(frame).collect()), key=str) == plain(tiny)
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_query_on_all_vectors(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in QUERIES["op2_embedding_dedup"](spark, sf).collect()), key=str)
    assert got == plain(rows)
