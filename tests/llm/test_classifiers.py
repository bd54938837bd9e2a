import zlib

import numpy as np
import pytest

from tallyfield.llm import quality, toxicity
from tallyfield.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def scored(spark, name, label, divisor, value):
    got = QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == value)
        assert 0 <= r.score <= 1
    return [(r, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]


def test_toxicity_on_the_held_out_fold(spark):
    rows = scored(spark, "op3_toxicity", "toxic", 3, 1)
    assert all(r.predicted == (r.score >= 0.7) for r, _ in rows)
    ranks = np.array([r.score for r, _ in rows])
    toxic = np.array([y == 1 for _, y in rows])
    # Some junk texts of this table are labelled toxic without a toxic word in them.
    assert (ranks[toxic][:, None] > ranks[~toxic]).mean() > 0.93
    assert np.mean([r.predicted for r, y in rows if y]) >= 0.88
    assert np.mean([r.predicted for r, y in rows if not y]) <= 0.04


def test_quality_on_the_held_out_fold(spark):
    rows = scored(spark, "op7_quality", "quality", 5, 0)
    assert all(r.predicted == (r.score >= 0.3) for r, _ in rows)
    assert np.mean([r.predicted for r, y in rows if y]) >= 0.98
    assert np.mean([r.predicted for r, y in rows if not y]) <= 0.2


def test_margin_of_a_word_is_the_mean_of_its_n_grams():
    model = toxicity.ToxicityModel(np.arange(toxicity.BUCKETS, dtype=np.float32), -1.0)
    words = ["alpha", "b", "", "!!", "grüße", "alpha"]
    buckets, sizes = toxicity.subwords(words)
    assert len(buckets) == sizes.sum() and sizes.min() >= 1
    cut = np.split(buckets, np.cumsum(sizes)[:-1])
    assert np.allclose(model.word_margins(words), [c.mean() for c in cut])
    assert set(cut[0]) == set(cut[5]) and len(set(cut[0]) & set(toxicity.subwords(["alphq"])[0])) >= 3
    plain = [
        max(
            sum(model.word_margins([w])[0] for w in p) / (len(p) + toxicity.BLANKS)
            for p in toxicity.passages("a long alpha text grüße".split() * 30)
        )
    ]
    score = toxicity.Scorer(model).score(["A long ALPHA text grüße " * 30])[0]
    assert score == pytest.approx(1 / (1 + np.exp(1.0 - plain[0])))


def test_unseen_misspellings_score_above_clean_words():
    clean = ["the river runs past green hills and a quiet town number %d" % i for i in range(300)]
    bad = ["the river runs past a worthless idiot and a quiet town number %d" % i for i in range(300)]
    model = toxicity.fit(clean + bad, [0] * 300 + [1] * 300)
    good, toxic, odd = model.word_margins(["hills", "worthless", "worthles"])
    assert toxic > odd > good
    p_clean, p_odd = toxicity.Scorer(model).score(["green hills and a quiet town", "a wrothless idiott and a worthles town"])
    assert p_clean < 0.5 < p_odd


def test_support_vectors_reach_the_optimum():
    pick = np.random.default_rng(1)
    rows = [np.unique(pick.integers(0, 30, 6)) for _ in range(60)]
    y = np.where(np.array([5 in r or 7 in r for r in rows]), 1, -1)
    weights, bias = quality._support_vectors(rows, y, np.ones(quality.BUCKETS))
    cost = {s: quality.COST * 60 / (2 * (y == s).sum()) for s in (1, -1)}

    def loss(w, b):
        margins = np.array([w[r].sum() / len(r) ** 0.5 + b for r in rows])
        return (w @ w + b * b) / 2 + sum(cost[s] * max(0, 1 - s * m) for s, m in zip(y, margins, strict=True))

    best = loss(weights, bias)
    for _ in range(300):
        nudge = np.zeros(quality.BUCKETS)
        nudge[:30] = pick.normal(0, 0.05, 30)
        assert loss(weights + nudge, bias + pick.normal(0, 0.05)) >= best - 1e-2 * best


@pytest.mark.parametrize("module,keep", [(toxicity, "keep_clean"), (quality, "keep_good")])
def test_odd_rows(spark, module, keep):
    rows = [(1, None, 0), (None, "a b", 1), (2, "", 2), (2, "", 2), (3, "word " * 60_000, 3), (4, " \n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score int")
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, None), (3, 0, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int"
    )
    for marks in (labels, labels.limit(0)):
        got = module.score_documents(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert [r.held_out for r in got if r.doc_id is None] == [False]
        kept = getattr(module, keep)(docs, marks)
        assert kept.columns == docs.columns
        assert kept.count() == sum(
            (r.predicted == 0) if module is toxicity else (r.predicted == 1) for r in got
        )
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_quality_reads_texts_without_white_space_to_their_end():
    features = quality.Features()
    for n in (64, 100, 6400, 64_000):
        head = "這是一個沒有空格的句子。" * (n // 12 + 1)
        plain, other = features.of(head[:n] + "好" * 64), features.of(head[:n] + "A7$b" * 16)
        assert not np.array_equal(plain, other)
    short = ["word", "x" * 64]
    assert quality.pieces(short) == (short, [False, False])
    link = "https://example.org/" + "ab1/" * 40
    cut, again = quality.pieces(["see", link, link])
    assert "".join(cut) == "see" + link + link and max(map(len, cut)) == quality.PIECE
    assert again[: len(cut) // 2 + 1] == [False] * (len(cut) // 2 + 1) and all(again[len(cut) // 2 + 1 :])


def test_verdict_on_a_phrase_does_not_depend_on_its_place():
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, dtype=np.float32), -1.0)
    phrase = ["bad%d" % i for i in range(20)]
    model.margins[np.unique(toxicity.subwords(phrase)[0])] = 10
    filler = ["f%d" % (i % 7) for i in range(200)]
    texts = [" ".join(filler[:at] + phrase + filler[at:]) for at in range(0, 201, 3)]
    scores = toxicity.Scorer(model).score(texts)
    assert np.allclose(scores, scores[0])


def test_runs_equal_brute_force():
    pick = np.random.default_rng(3)
    for size in (1, 2, 49, 50, 51, 99, 173):
        numbers = pick.integers(0, 40, size)
        margin = pick.normal(0, 1, 40)
        plain = max(
            sum(margin[w] for w in own) / (len(own) + toxicity.BLANKS)
            for at in range(max(1, size - toxicity.PASSAGE + 1))
            for own in [set(numbers[at : at + toxicity.PASSAGE])]
        )
        assert toxicity.run_means(numbers, margin[numbers]).max() == pytest.approx(plain)
