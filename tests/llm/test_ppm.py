import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest

from tallyfield.llm import ppm
from tallyfield.llm.common import lower_words
from tallyfield.llm.queries import QUERIES


def kind_of(text):
    words = lower_words(text)
    if not words:
        return b"A"
    counts = Counter(words)
    most = [w for w, n in counts.items() if n == max(counts.values())]
    return bytes([65 + zlib.crc32(sorted(most, key=lambda w: (len(w), w))[0]) % ppm.KINDS])


def form_of(kind, word):
    return kind + (word + b" " if word else b"\t")


def plain_trie(forms):
    """Context (bytes) -> symbol -> count, from counted forms of words."""
    trie = defaultdict(Counter)
    for form, n in forms.items():
        for at in range(1, len(form)):
            for order in range(min(at, ppm.ORDER) + 1):
                trie[form[at - order : at]][form[at]] += n
    return trie


def plain_p(trie, context, symbol):
    """Probability with escape and exclusion, spelt out over all 256 symbols."""

    def all_of(context):
        below = all_of(context[1:]) if context else [1 / 256] * 256
        met = trie.get(context)
        if not met:
            return below
        total, kinds = sum(met.values()), len(met)
        left = sum(p for s, p in enumerate(below) if s not in met)
        escape = kinds / (total + kinds)
        return [met[s] / (total + kinds) if s in met else escape * below[s] / left for s in range(256)]

    distribution = all_of(context)
    assert isclose(sum(distribution), 1, rel_tol=1e-9)
    return distribution[symbol]


def plain_scores(docs):
    return list(plain_scores_of(docs, docs))


def plain_scores_of(few, docs):
    """Brute-force scores of some documents, learned from all."""
    counts, forms = Counter(), Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*lower_words(t), b""])
            kind = kind_of(t)
            forms.update(form_of(kind, w) for w in [*lower_words(t), b""])
    trie, n, v = plain_trie(forms), sum(counts.values()), len(counts)
    memo = {}

    def p(context, symbol):
        if (context, symbol) not in memo:
            memo[context, symbol] = log10(plain_p(trie, context, symbol))
        return memo[context, symbol]

    def score(form):
        return sum(p(form[max(0, at - ppm.ORDER) : at], form[at]) for at in range(1, len(form)))

    out = []
    for d, t in few:
        tokens, kind = [*lower_words(t), b""], kind_of(t)
        out.append(
            (
                d, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(tokens), sum(counts[w] > 0 for w in tokens),
                n, sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), sum(score(form_of(kind, w)) for w in tokens) - log10(ppm.KINDS),
            )
        )
    return out


ODD = [
    (1, None), (2, ""), (3, "abra cadabra ABRA"), (4, " \t\n"), (5, "naïve Éa \U0001f600 zz"), (6, "abra abba"),
    (7, "ab" * 3000), (8, "x\x00y abra"), (8, "x\x00y abra"), (None, "abba cab"), (9, "dab " * 2000), (11, "cad qzq"),
]


def close(got, want):
    key = lambda r: str(tuple(r)[:5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert isclose(a.base_score, b[5], rel_tol=1e-9) and isclose(a.score, b[6], rel_tol=1e-9)


@pytest.mark.parametrize("frequent,together", [(200_000, 200_000), (3, 4)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, frequent, together):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    monkeypatch.setattr(ppm, "WORDS_AT_A_TIME", together)
    docs = spark.createDataFrame([(*r, "a", 1) for r in ODD], "doc_id long, text string, word string, n int")
    got = ppm.score_documents(docs).collect()
    close(got, plain_scores(ODD))


def test_empty_table(spark):
    assert ppm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_all_documents(spark, sf):
    got = QUERIES["op4_ppm"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(docs)
    assert any(r.held_out for r in got) and all(r.score < 0 and r.base_score < 0 for r in got)
    few = sorted(docs, key=lambda d: len(d[1]))[:25]
    base = {r.doc_id: r for r in got}
    want = {r[0]: r for r in plain_scores_of(few, docs)}
    for d, _ in few:
        r = base[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[d][2:5]
        assert isclose(r.score, want[d][6], rel_tol=1e-9) and isclose(r.base_score, want[d][5], rel_tol=1e-9)


def test_kinds_use_every_capital_letter():
    openings = {ppm.opening(Counter([b"word%d" % i])) for i in range(2000)}
    assert openings == {bytes([65 + i]) for i in range(26)}


def test_words_are_split_by_the_stated_characters_alone():
    plain = re.compile(rb"[^\x20\x09-\x0D]+")
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    texts = ["".join(map(chr, range(0x250))) * 2, "A\x1cB\x1dC\x85D\xa0E F G", "\ud800X y", "", None, "\x0b\x0c"]
    for text in texts:
        want = plain.findall(text.encode("utf-8", "surrogatepass").translate(lower)) if text else []
        assert lower_words(text) == want


def test_context_counts_are_those_of_the_plain_trie():
    forms = {b"Aabra": 3, b"Bab": 2, b"A": 1, b"Zz\x00y": 5}
    found = ppm.context_counts(list(forms), np.array(list(forms.values())))
    got = dict(zip(found.column("key").to_pylist(), found.column("n").to_pylist(), strict=True))
    want = Counter()
    for context, symbols in plain_trie({form_of(w[:1], w[1:]): n for w, n in forms.items()}).items():
        packed = int.from_bytes(context, "big")
        for symbol, n in symbols.items():
            want[(len(context) << 48 | packed) << 8 | symbol] += n
    assert got == want and len(found) == len(got)


def test_contexts_are_counted_without_sorting(monkeypatch):
    """A group of words is counted by hash, as sorting its contexts was most of that step."""
    monkeypatch.setattr(np, "unique", lambda *a, **k: pytest.fail("sorted"))
    ppm.context_counts([b"Aabra", b"Bab"], np.array([1, 2]))


def plain_running_scores(docs):
    """Brute-force scores of whole texts as one sequence each."""
    form = lambda t: b"A" + b"".join(w + b" " for w in lower_words(t)) + b"\t"
    trie = plain_trie(Counter(form(t) for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 5 != 1))
    memo = {}

    def p(context, symbol):
        if (context, symbol) not in memo:
            memo[context, symbol] = log10(plain_p(trie, context, symbol))
        return memo[context, symbol]

    return [sum(p(f[max(0, at - ppm.ORDER) : at], f[at]) for at in range(1, len(f))) for f in (form(t) for _, t in docs)]


@pytest.mark.parametrize("frequent,held", [(1_000_000, 2_000_000), (3, 20)])
def test_contexts_across_words_equal_brute_force(spark, monkeypatch, frequent, held):
    monkeypatch.setattr(ppm, "FREQUENT_KEYS", frequent)
    monkeypatch.setattr(ppm, "_HELD_KEYS", held)
    got = ppm.score_documents(spark.createDataFrame(ODD, "doc_id long, text string"), across_words=True).collect()
    want = [(*w[:6], score) for w, score in zip(plain_scores(ODD), plain_running_scores(ODD), strict=True)]
    close(got, want)


def test_order_of_words_counts_across_words(spark):
    text = "one two three four five six seven eight nine ten"
    mixed = "four ten two nine one seven three six eight five"
    held_out = [d for d in range(10, 60) if zlib.crc32(str(d).encode()) % 5 == 1]
    learned = [d for d in range(10, 60) if d not in held_out]
    pair = spark.createDataFrame([(learned[0], text), (learned[1], text), (held_out[0], text), (held_out[1], mixed)], "doc_id long, text string")
    found = {r.doc_id: r for r in ppm.score_documents(pair, across_words=True).collect()}
    assert found[held_out[0]].held_out and found[held_out[1]].held_out
    assert found[held_out[0]].score > found[held_out[1]].score + 1
    assert found[held_out[0]].base_score == pytest.approx(found[held_out[1]].base_score)


def test_query_scores_the_order_of_words_too(spark, sf):
    """The query's rows hold the scores of whole texts as sequences beside those of their words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in QUERIES["op4_ppm"](spark, sf).collect()}
    want = {r.doc_id: r.score for r in ppm.score_documents(docs, across_words=True).collect()}
    assert len(got) == len(want) == docs.count()
    assert all(isclose(got[d].running_score, want[d], rel_tol=1e-9) for d in want)
    assert any(not isclose(got[d].score, want[d], rel_tol=1e-3) for d in want)
