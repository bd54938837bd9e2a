import hashlib
import re

from tallyfield.llm import decontaminate, terms
from tallyfield.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return [m.group().translate(LOWER) for m in WORD.finditer(text or "")]


def plain(docs, items, window=10):
    """Every window against every place of every document."""
    windows = []
    for item, text in items:
        words = plain_words(text)
        width = min(window, len(words))
        windows += [(item, words[at : at + width]) for at in range(len(words) - width + 1) if width]
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, run in windows:
            for at in range(len(words) - len(run) + 1):
                if words[at : at + len(run)] == run:
                    hit.update(range(at, at + len(run)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(names), digest, bool(hit)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs[:60], items)
    got = QUERIES["op12_decontaminate"](spark, sf).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    mine = {r[0]: r for r in ordered(got)}
    assert all(mine[row[0]] == row for row in want)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short Item"), (2, "short item"), (3, None), (4, "?!"),
    (5, "é Ünder 日本 x " + "w" * 300), (None, "no id here"), (10, "a a a a a a a a a a a"),
]
DOCS = [
    (1, None), (2, ""), (3, " ,.;"), (4, "one-two THREE four/five six seven eight nine ten!"), (4, "one-two THREE four/five six seven eight nine ten!"),
    (5, "x short\n\nITEM, short item short"), (6, "two three four five six seven eight nine ten eleven twelve one"), (None, "no ID here"),
    (7, "é\U0001f600 é ünder 日本 X " + "W" * 300 + " é Ünder 日本 x " + "w" * 300), (8, "a " * 5000), (9, "z" * 200_000), (10, "é ünder 日本 x " + "w" * 299),
]


def tables(spark):
    docs = spark.createDataFrame([(*r, [1], "x") for r in DOCS], "doc_id long, text string, spans array<int>, items string")
    items = spark.createDataFrame([(*r, "y") for r in ITEMS], "item_id long, text string, block string")
    return docs, items


def test_odd_rows_in_one_block_and_in_many(spark):
    docs, items = tables(spark)
    want = ordered(plain(DOCS, ITEMS))
    assert ordered(decontaminate.contamination(docs, items).collect()) == want
    whole = decontaminate.find_passages(docs, items)
    parted = decontaminate.find_passages(docs, items, block_bytes=20)
    assert ordered(parted.collect()) == ordered(whole.collect())


def test_spans_are_places_of_the_original_text(spark):
    docs, items = tables(spark)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.find_passages(docs, items).collect()}
    texts = dict(DOCS)
    assert [texts[4][a:b] for a, b in spans[4]] == ["one-two THREE four/five six seven eight nine ten"]
    assert [texts[5][a:b] for a, b in spans[5]] == ["short\n\nITEM, short item"]
    assert texts[7][slice(*spans[7][0])] == "é Ünder 日本 x " + "w" * 300 and len(spans[7]) == 1
    assert spans[1] == spans[9] == spans[10] == []


def test_long_items_are_cut_without_losing_a_window(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(57))
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 4)
    found = decontaminate.item_pieces(items).collect()
    assert len(found) == 12
    runs = {" ".join(p[at : at + 10]) for r in found for p in [bytes(r.words).decode().split()] for at in range(len(p) - 9)}
    assert runs == {" ".join(words.split()[at : at + 10]) for at in range(48)}


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).filter("contaminated or n_items > 0").count()


def test_words_do_not_join_across_texts_or_slices():
    import pyarrow as pa

    cut = terms.cut(pa.array(["ab", "cd", None, "", "E-f"]).slice(1))
    assert cut.words.to_pylist() == [b"cd", b"e", b"f"]
    assert cut.bounds.tolist() == [0, 1, 1, 1, 3] and cut.starts.tolist() == [0, 0, 2] and cut.ends.tolist() == [2, 1, 3]
