import re

from tallyspark.llm import pii

CASES = [
    ("Mr McDonald left", r"Mr [A-Z][a-z]+ left", "McDonald"), ("Mrs O'Brien, Mrs O’Brien", r"Mrs ([A-Z][a-z]+), Mrs \1", "Brien"), ("John F. Kennedy spoke", r"[A-Z][a-z]+n [A-Z]\. [A-Z][a-z]+ spoke", "Kennedy"),
    ("MR SMITH, and Mr Smith", r"MR ([A-Z]+), and Mr ([A-Z][a-z]+)", "mith"), ("Mr J. F. Kennedy.", r"Mr [A-Z][a-z]*\. [A-Z]\. [A-Z][a-z]+\.", "Kennedy"), ("MRS ANNA SMITH", r"MRS [A-Z]+A [A-Z]+", "ANNA"), ("Mrs Smith's car", r"Mrs [A-Z][a-z]+'s car", "Smith"),
    ("to AT61 1904 3002 3457 3201 EUR", r"to AT\d\d( \d{4}){4} EUR", "3457"), ("AT611904300234573201 AND", r"AT\d{18} AND", "3002"), ("NO93 8601 1117 947 OK", r"NO\d\d \d{4} \d{4} \d{3} OK", "8601"),
]


def test_forms_of_names_and_accounts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.with_surrogates(df, "k").collect()}
    for i, (text, pattern, gone) in enumerate(CASES):
        assert re.fullmatch(pattern, got[i]) and gone not in got[i], (text, got[i])
    a, b = re.fullmatch(CASES[3][1], got[3]).groups()
    assert a == b.upper()
    account = got[7].removeprefix("to ").removesuffix(" EUR").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
