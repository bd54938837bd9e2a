import hashlib
import random

import pytest
import sentencepiece

from tallyfield.llm import pieces
from tallyfield.llm.queries import PIECE_FILE, QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.load_model(tokenizer_file(PIECE_FILE)))


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))


def odd_texts():
    pick = random.Random(5)
    few, many = "ab e▁  \n\t<0x41>s é世界\U0001f600théingИи\x00#    ", "thein▁ "
    for alphabet, longest in ((few, 60), (many, 300)):
        for _ in range(1500):
            yield "".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest)))
    yield from ("", None, " ", "  ", "▁", "▁▁a", "a" * 3000, " " * 1000, "ab" * 2000, "世界" * 900)
    yield from ("<s></s><unk>", "the" * 1000, "<0x41>", "word " * 20_000, "x" * 20_000)


def test_same_ids_and_texts_as_the_library(model, lib):
    texts = list(odd_texts())
    coded = pieces._Encoder(model).encode(texts)
    for text, raw in zip(texts, coded, strict=True):
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert ids == lib.encode(text or "")
        assert model.decode(ids) == lib.decode(ids)


def test_decode_of_any_ids(model, lib):
    pick = random.Random(6)
    for _ in range(2000):
        ids = [pick.choice([pick.randint(3, 258), pick.randint(0, 31_999), 28_705]) for _ in range(pick.randint(0, 8))]
        assert model.decode(ids) == lib.decode(ids)


def test_small_memory_of_words_changes_nothing(model, monkeypatch):
    texts = [f"alpha{i} beta gamma{i % 7}" for i in range(200)]
    whole = pieces._Encoder(model).encode(texts)
    monkeypatch.setattr(pieces, "CACHED_WORDS", 10)
    small = pieces._Encoder(model)
    assert [ids for t in texts for ids in small.encode([t])] == whole


def test_query_on_all_documents(spark, sf, lib):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = lib.encode(doc.text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))]
        assert got[doc.doc_id] == (len(ids), *sha)


def test_odd_rows(spark, lib):
    rows = [(1, None, "i"), (None, "a b", "j"), (2, "", "k"), (2, "", "k"), (3, "é" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(pieces.encode_decode(docs, tokenizer_file(PIECE_FILE)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.decoded) for r in got] == [(None, "a b"), (1, ""), (2, ""), (2, ""), (3, "é" * 50_000)]
    assert got[0].ids == lib.encode("a b") and got[1].ids == []
    assert pieces.encode_decode(docs.limit(0), tokenizer_file(PIECE_FILE)).count() == 0
