from collections import Counter
from itertools import combinations

import xxhash

from tallyfield.llm import simhash
from tallyfield.llm.common import lower_words
from tallyfield.llm.queries import QUERIES


def plain_print(text):
    words = lower_words(text)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    distinct = sorted(set(prints.values()))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for doc, p in prints.items():
        least[root(p)] = min(doc, least.get(root(p), doc))
    return {doc: least[root(p)] for doc, p in prints.items()}


def test_every_four_positions_hold_a_triple():
    family = {frozenset(t) for t in simhash.positional_triples()}
    assert len(family) == 20
    for four in combinations(range(8), 4):
        assert any(t <= set(four) for t in family)


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: plain_print(t) for d, t in texts.items()}
    groups = plain_groups(prints)
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in texts}


def test_links_of_close_fingerprints_and_blocks(spark):
    base = 0x0123456789ABCDEF
    near = [base ^ sum(1 << b for b in bits) for n in (0, 1, 2) for bits in combinations(range(0, 64, 5), n)]
    far = [base ^ (0x1F << s) for s in (0, 20, 40)]
    values = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(near + far)]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for block in (7, 2048):
        links = simhash.link_fingerprints(frame, block).distinct().collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in links)
        prints = {i: v & (2**64 - 1) for i, v in enumerate(values)}
        want = plain_groups(prints)
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fingerprint long")
        found = simhash.component_of_fingerprints(rows).df
        got = {r.doc_id: r.component_id for r in rows.join(found, "fingerprint").collect()}
        assert got == want


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one Two", "x"), (5, "ONE two", "x"),
        (6, "word " * 30_000, None), (6, "word " * 30_000, None), (None, "one two", "x"), (7, "éÉ \U0001f600 a b c", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    groups = {d: c for d, _, c in got}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == groups[5] == groups[None] == 4 and groups[6] == 6
    assert {f for d, f, _ in got if d in (1, 2, 3)} == {"0" * 16}
    assert dict((d, f) for d, f, _ in got)[7] == f"{plain_print(rows[-1][1]):016x}"
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_chain_and_star(spark):
    from tallyfield.llm.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, **{i: 5 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    texts = ["red green blue black white %d %s" % (i, "abcdefgh"[i] * (i + 1)) for i in range(8)]
    rows = [(3, t) for t in texts] + [(3, texts[0]), (1, texts[1]), (None, texts[2])]
    # A null text without an id is not document 42, which is what its hash comes to.
    rows += [(42, "forty two is a document of its own"), (None, None), (None, "no id at all in this one")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    prints = {n: plain_print(t) for n, (_, t) in enumerate(rows)}
    groups = plain_groups(prints)
    want = Counter()
    for root in set(groups.values()):
        own = [rows[n] for n in groups if groups[n] == root]
        want[min(own, key=lambda r: (r[0] is None, r[0] or 0))] += 1
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert Counter(kept) == want and len(kept) == 11
    assert {(3, texts[0]), (1, texts[1]), (3, texts[2]), (42, rows[11][1]), (None, None)} <= set(kept)
