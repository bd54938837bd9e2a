import sys
import unicodedata

from pyspark.sql import functions as F

from tallyfield.functions import names


def by_hand(name):
    import re

    tokens = re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold())
    if tokens and tokens[-1] in names.SUFFIXES:
        tokens = tokens[:-1]
    if len(tokens) >= 3 and len(tokens[0]) == len(tokens[1]) == 1:
        tokens = [tokens[0] + tokens[1], *tokens[2:]]
    if tokens:
        tokens[0] = names.FIRST_NAMES.get(tokens[0], tokens[0])
    return " ".join(tokens)


def test_folding_equals_unicode_decomposition(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    changed = [c for c in chars if unicodedata.decomposition(c)]
    texts = [f"x{c}y{d}" for c, d in zip(changed, reversed(changed))] + ["".join(chars[i : i + 400]) for i in range(0, 70_000, 400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", names.ascii_fold(F.col("t")).alias("f")).collect()
    wrong = [r for r in got if r.f != unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()]
    assert wrong == []


def test_known_names(spark):
    texts = [
        "Mike Evans",
        "Michael Evans Jr.",
        "A.J. Brown",
        "D. K. Metcalf III",
        "Gabe Davis",
        "José Ramírez Jr",
        "Ja'Marr Chase",
        "straße ﬁve",
        "J R",
        "Jr.",
        "",
        "  ",
        "will v",
        "Willow Will",
        "½ Ⅳ ⑩ 𝐀b",
        "A B C D",
        "v jr",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", names.normalize_name(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: by_hand(t) for t in texts}


def test_redaction_and_book_keys(spark):
    df = spark.createDataFrame([("GET ?api_key=abc&x=s3cr3t " + "z" * 2000, "Draft Kings US")], "m string, b string")
    row = df.select(names.redact_secrets(F.col("m"), "s3cr3t").alias("m"), names.book_key(F.col("b")).alias("b")).first()
    assert row.m.startswith("GET ?api_key=[REDACTED]&x=[REDACTED] z") and len(row.m) == 1000
    assert row.b == "draft-kings-us"
