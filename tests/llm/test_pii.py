import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: (r.text, r.n) for r in pii.with_surrogates(df, key, count="n").collect()}


def luhn(s):
    digits = [int(x) for x in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


@pytest.fixture(scope="module")
def out(spark):
    return run(spark, [
        "a.bc+1@mail5.example.com and A.BC+1@MAIL5.EXAMPLE.COM", "188.54.39.104, v1.2.3", "+1 (499) 555-6503; 499-555-6503", "4871316720949013 x 4871-3167-2094-9013 4871316720949014",
        "Mrs Anna Smith, Herr Müller-Lüdenscheid, Frau Smith", "Иван Петров и г-жа Петров", "DE89 3704 0044 0532 0130 00 / 078-05-1120", None, "", "clean text Mr. x 12345 a@b", "﷐ ﷑ q@b.co ﷑m",
        'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "x@y.zz " * 3000,
    ])


def test_coreference_and_format(out):
    a, b = out[0][0].split(" and ")
    assert b == a.upper() and re.fullmatch(r"[a-z]\.[a-z]{2}\+\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    assert re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}, v1\.2\.3", out[1][0]) and "188.54" not in out[1][0]
    first, second = out[2][0].split("; ")
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", first) and re.sub(r"\D", "", first)[1:] == re.sub(r"\D", "", second)
    x, y, z = re.fullmatch(r"(\d{16}) x (\S+) (\d{16})", out[3][0]).groups()
    assert luhn(x) and x[0] == "4" and x != "4871316720949013" and y.replace("-", "") == x and z == "4871316720949014"


def test_names(out):
    m = re.fullmatch(r"Mrs ([A-Z][a-z]+a) ([A-Z][a-z]+), Herr ([A-Z][a-z]+)-([A-Z][a-z]+), Frau ([A-Z][a-z]+)", out[4][0])
    assert m and m[2] == m[5] and "Anna" not in out[4][0] and "Smith" not in out[4][0]
    m = re.fullmatch(r"([А-Я][а-я]+н) ([А-Я][а-я]+) и г-жа ([А-Я][а-я]+)", out[5][0])
    assert m and m[2] == m[3] != "Петров"


def test_account_and_number(out):
    iban, ssn = out[6][0].split(" / ")
    bare = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and iban[:2] == "DE"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn != "078-05-1120"


def test_what_stays(out):
    assert out[7] == (None, 0) and out[8] == ("", 0) and out[9] == ("clean text Mr. x 12345 a@b", 0)
    assert re.fullmatch("﷐ ﷑ [a-z]@[a-z].co ﷑m", out[10][0])
    assert out[11][1] == 0
    assert out[12][1] == 3000 and len(set(out[12][0].split())) == 1


def test_keys_differ(spark, out):
    assert run(spark, ["188.54.39.104"], "other")[0][0] != out[1][0].split(",")[0]


def test_distinct_and_never_an_entity(spark):
    # the space of one-letter names is so small that first draws collide
    emails = spark.range(2000).select(F.lit("email").alias("kind"), F.concat(F.element_at(F.split(F.lit("abcdefghij"), ""), (F.col("id") % 10 + 1).cast("int")), F.lit("@"), (F.floor(F.col("id") / 10) % 10).cast("string"), F.lit(".co")).alias("canon"))
    got = pii.resolve(emails, "k").collect()
    bodies = [r.body for r in got]
    assert len(got) == 100 and len(set(bodies)) == 100 and not {r.canon for r in got} & set(bodies)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "m@x.org", "u", "p", True, 7, "q"), (1, "m@x.org", "u", None, False, 7, "q")], "doc_id int, text string, k string, parts string, has boolean, N int, new string")
    out = pii.with_surrogates(df, "key")
    assert out.columns == df.columns and len({r.text for r in out.collect()}) == 1 and out.count() == 2
    assert sorted((r.k, r.parts or "", r.has, r.N, r.new) for r in out.collect()) == [("u", "", False, 7, "q"), ("u", "p", True, 7, "q")]
    counted = pii.with_surrogates(df, "key", count="has")
    assert sorted(counted.columns) == sorted(df.columns) and [r.has for r in counted.collect()] == [1, 1]
    assert pii.with_surrogates(df.limit(0), "key").count() == 0


def test_distinct_across_kinds(spark):
    rows = [(kind, f"{name}{i}") for kind in ("given-f-latin", "given-m-latin", "given-n-latin", "surname-latin") for i, name in enumerate("abcdefgh")]
    got = pii.resolve(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    assert len({r.body for r in got}) == len(got) == 32


NAMED = [
    ("Dr. Emily Watson spoke", r"Dr\. [A-Z][a-z]+a [A-Z][a-z]+ spoke", "Watson Emily"), ("Prof. Li Wei spoke", r"Prof\. [A-Z][a-z]+i [A-Z][a-z]+ spoke", "Wei"), ("DR MARY SMITH", r"DR [A-Z]+A [A-Z]+", "MARY SMITH"),
    ("Prof. Dr. Hans Weber", r"Prof\. Dr\. [A-Z][a-z]+n [A-Z][a-z]+", "Hans Weber"), ("Mrs. de la Cruz left", r"Mrs\. de la [A-Z][a-z]+ left", "Cruz"), ("Fatima Al-Sayed", r"[A-Z][a-z]+a [A-Z][a-z]+-[A-Z][a-z]+", "Fatima Sayed"),
    ("Dear Ruth Okafor, hello Okafor", r"Dear [A-Z][a-z]+ ([A-Z][a-z]+), hello \1", "Okafor"), ("Dear Sir or Madam", "Dear Sir or Madam", "-"), ("Robert Smith and Smith, a SMITH", r"[A-Z][a-z]+n ([A-Z][a-z]+) and \1, a [A-Z]+", "Smith SMITH"),
    ("Petra Müller, petra müller", r"([A-Z][a-z]+a) ([A-Z][a-z]+), [a-z]+ [a-z]+", "petra müller"), ("John Baker, a baker", r"[A-Z][a-z]+n [A-Z][a-z]+, a baker", "Baker"), ("call 415 555 2671.", r"call [2-9]\d\d [2-9]\d\d \d{4}\.", "2671"),
    ("Tel. 030 1234567", r"Tel\. 0\d\d \d{7}", "1234567"), ("at 2001:db8::1 now", r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f] now", "2001"), ("at 12:30:45 a::b::", "at 12:30:45 a::b::", "-"), ("fe80:1:2:3:4:5:6:7", r"[0-9a-f]{4}(:[0-9a-f]){7}", "fe80"),
]


def test_names_by_context(spark):
    got = run(spark, [c[0] for c in NAMED])
    for i, (text, pattern, gone) in enumerate(NAMED):
        assert re.fullmatch(pattern, got[i][0]) and not any(w in got[i][0] for w in gone.split()), (text, got[i])
    first, rest = got[9][0].split(", ")
    assert first.lower() == rest
