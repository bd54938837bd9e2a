import hashlib
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import sentencepiece
from test_simhash import plain_groups, plain_print

import corpus_pipeline
from tallyfield.llm import quality, toxicity
from tallyfield.llm.queries import PIECE_FILE, tokenizer_file
from tallyfield.llm.sql import ORACLES

SF = "/root/testdata/sf0.01"


def sample(docs, labels, place, fold, per_class):
    """The labelled sample of the classifiers, in the order that Spark gives to hashes of ids."""
    divisor, value = fold
    known = {d: y for d, y in labels.items() if y is not None and zlib.crc32(str(d).encode()) % divisor != value and d in docs}
    picked = []
    for label, most in per_class.items():
        picked += sorted((d for d, y in known.items() if y == label), key=lambda d: (place[d], d))[:most]
    picked.sort(key=lambda d: (place[d], d))
    return [docs[d].text for d in picked], [known[d] for d in picked]


def test_run_equals_brute_force(spark):
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in frame.collect()}
    place = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    total = len(docs)

    model = toxicity.fit(*sample(docs, {r.doc_id: r.toxic for r in marks}, place, toxicity.HELD_OUT, toxicity.SAMPLE))
    scorer = toxicity.Scorer(model)
    docs = {d: r for d, r in docs.items() if scorer.score([r.text])[0] < toxicity.THRESHOLD}
    assert 0.5 * total < len(docs) < total
    model = quality.fit(*sample(docs, {r.doc_id: r.quality for r in marks}, place, quality.HELD_OUT, quality.SAMPLE))
    features = quality.Features()
    before = len(docs)
    docs = {d: r for d, r in docs.items() if model.score(features.of(r.text)) >= quality.THRESHOLD}
    assert 0.5 * total < len(docs) < before
    groups = plain_groups({d: plain_print(r.text) for d, r in docs.items()})
    before = len(docs)
    docs = {d: r for d, r in docs.items() if groups[d] == d}
    assert len(docs) < before
    db = duckdb.connect()
    rows = list(docs.values())
    table = pa.table({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows], "source": [r.source for r in rows]})
    db.register("documents", table)
    cursor = db.execute(ORACLES["op10_mixing"])
    names = [c[0] for c in cursor.description]
    taken = [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))
    want: Counter = Counter()
    for row in taken:
        if row["taken"]:
            doc = docs[row["doc_id"]]
            ids = lib.encode(doc.text)
            sha = hashlib.sha256(lib.decode(ids).encode()).hexdigest()
            want[doc.doc_id, doc.source, len(ids), tuple(ids), sha] += row["taken"] // row["size"]

    result = corpus_pipeline.run(spark, SF)
    got = Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in result.collect())
    assert got == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0
        if name != "sentencepiece":
            assert after.columns == docs.columns
