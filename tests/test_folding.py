"""Decomposition against the standard library's, for every code point and for texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions import text

CODES = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def brute(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_every_code_point(spark):
    rows = ["".join(map(chr, CODES[i : i + 512])) for i in range(0, len(CODES), 512)]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, s string").repartition(8).select("i", text.folded(F.col("s")).alias("f")).collect()
    assert len(got) == len(rows) and all(r.f == brute(rows[r.i]) for r in got)


def test_texts_of_mixed_characters(spark):
    rng = random.Random(4)
    hard = "áÉñçÅﬁﬀＡＢ１½①㎆㌀한글각ὰᾳ…™ªº ́‍\U0001d400\U0001f600İß"
    rows = ["".join(rng.choice(hard + "ab C1") for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "plain"]
    df = spark.createDataFrame([(s,) for s in rows] + [(None,)], "s string")
    got = df.select("s", text.folded(F.col("s")).alias("f"), text.comparable(F.col("s")).alias("c")).collect()
    for r in got:
        if r.s is None:
            assert r.f is None and r.c == ""
        else:
            assert r.f == brute(r.s)
            assert r.c == " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in brute(r.s).upper()).split())


def test_keys_by_hand(spark):
    df = spark.createDataFrame([("　Ｃａｆé  ½ ﬁno. ",), (" 한글;",), ("άλφα",)], "s string")
    assert [r[0] for r in df.select(text.description_key(F.col("s"))).collect()] == ["cafe 1⁄2 fino", brute("한글"), "αλφα"]
    assert [r[0] for r in df.select(text.category_key(F.col("s"))).collect()][2] == "ΑΛΦΑ"
    assert df.where("s like '%Ｃ%'").select(text.file_name(F.trim("s"), extension="pdf")).first()[0] == "cafe_1_2_fino..pdf"
