import hashlib

import corpus_pipeline
from tallyfield.llm.common import prepare, store
from tallyfield.session import release_stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids array<string>, n_tokens string"


def test_token_ids_of_odd_rows(spark):
    """Null, empty and repeated texts, null ids, and columns that clash with the result's."""
    rows = [(i, t, "en", s, 1, ["x"], "y") for i, t, s in ((1, "One two", "a"), (1, "One two", "a"), (None, None, None), (2, "", "b"), (3, "é " * 20_000, "b"))]
    got = corpus_pipeline.token_ids(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(map(str, [r.doc_id for r in got])) == ["1", "1", "2", "3", "None"]
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert (r.decoded_sha256 == empty) == (r.doc_id in (None, 2)) == (r.n_tokens == 0)
    assert corpus_pipeline.token_ids(spark, spark.createDataFrame([], COLUMNS), "").collect() == []


def test_stored_tables_are_released(spark):
    prepare(spark)
    kept = store(spark.range(3), "kept")
    assert kept.df.count() == 3
    release_stages(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
