"""Op 2's query against entities found by plain patterns in Python."""

import re

from tallyspark.llm.queries import QUERIES

ENTITY = re.compile(
    r"(?P<email>[\w.%+-]+@(?:[\w-]+\.)+[a-z]{2,})|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w))|(?P<phone>\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4})|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))|(?P<card>(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?!\w)|(?<![\w.-])\d{13,19}(?!\w))"
)


def luhn(s):
    digits = [int(x) for x in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_only_entities_change_and_each_one_alike(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    mapped, seen = {}, 0
    for r in QUERIES["op2_surrogates"](spark, sf_dir).collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.text is None and r.n_replaced == 0
            continue
        found = [m for m in ENTITY.finditer(text) if m.lastgroup != "card" or luhn(m[0])]
        assert r.n_replaced == len(found), (r.doc_id, [m[0] for m in found])
        # all between the entities stays, each entity is one stretch without a blank more or less
        edges = [0, *[x for m in found for x in m.span()], len(text)]
        plain = [text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
        got = re.fullmatch("(.+?)".join(map(re.escape, plain)), r.text, re.S)
        assert got, r.doc_id
        for m, new in zip(found, got.groups()):
            key = (m.lastgroup, re.sub(r"\D", "", m[0]) if m.lastgroup in ("phone", "card", "ssn") else m[0].lower())
            bare = re.sub(r"\D", "", new) if m.lastgroup in ("phone", "card", "ssn") else new.lower()
            assert mapped.setdefault(key, bare) == bare and bare != key[1]
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", new.lower())).count("0") >= 0 and (m.lastgroup == "email" or len(new) == len(m[0]) or m.lastgroup == "ip")
            assert m.lastgroup != "card" or luhn(new)
            seen += 1
    assert seen > 10 and len(set(mapped.values())) == len(mapped)
