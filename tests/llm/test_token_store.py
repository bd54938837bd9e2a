import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyfield.llm import token_store
from tallyfield.llm.queries import QUERIES, WORD_FILE, tokenizer_file


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(tokenizer_file(WORD_FILE))


def ids_of(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 1]


def test_chunks_give_the_same_ids_as_whole_texts(lib, monkeypatch):
    pick = random.Random(3)
    alphabet = "ab é  \u0085  　\x1c\x1f\x0b\x0c  \n\r\t<|endoftext|>s 'st é世ΣßİI's \x00#12"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 60))) for _ in range(2000)]
    signs = "aB.,;:!?é'<|>=\u0338\u0301 sT1"
    texts += ["".join(pick.choice(signs) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    texts += ["<|ENDOFTEXT|>. <|endoftext|>, it's. IT'S! a=. \u0338", "", None, " ", "<|endoftext|> a<|startoftext|>b", " ́a", "ᄀ ᅡ", "ΑΣ ΑΣΑ", "a" * 2000]
    monkeypatch.setattr(token_store, "CACHED_CHUNKS", 50)
    encoder = token_store.ChunkEncoder(lib.to_str())
    coded = [c for at in range(0, len(texts), 100) for c in encoder.encode(texts[at : at + 100])]
    for text, raw in zip(texts, coded, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(lib, text)


def test_query_reads_back_what_the_library_gives(spark, sf, lib):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_token_store"](spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert len(got) == len(docs)
    start = 0
    for doc in docs:
        ids = ids_of(lib, doc.text)
        assert got[doc.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_blocks_dictionary_and_single_access(spark, sf, lib, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 3000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = token_store.write_tokens(docs, tokenizer_file(WORD_FILE))
    assert len(spark.read.parquet(f"{path}/dictionary").first().dictionary) > 1000
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 20 and blocks.select("dictionary_sha256").distinct().count() == 1
    assert token_store.read_tokens(spark, path).count() == docs.count()


def test_odd_rows(spark, lib):
    rows = [(3, None, 1), (None, "b", 2), (2, "", 3), (2, "", 3), (1, "Long " * 40_000, 4), (4, "é\n<|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = token_store.write_tokens(docs, tokenizer_file(WORD_FILE))
    got = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4]
    texts = {d: t for d, t, _ in rows}
    start = 0
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(lib, texts[r.doc_id])
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    empty = token_store.write_tokens(docs.limit(0), tokenizer_file(WORD_FILE))
    assert token_store.read_tokens(spark, empty).count() == 0
