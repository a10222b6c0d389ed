"""Op 11 against a plain alignment, token after token."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

from tallyspark.llm import token_alignment as ta

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ODD = [
    "a  b", "  a", "a ", "\n a", "a\tb c", "x▁y z", " x y", "a\0b c", "ﬁ x", "é", "\r\n a\r\nb", "a\nb\n\nc", "don't we'll 's", "12 345 x2y", "<|endoftext|> a <s> </s>", "😀 a 漢字 b", "\n", "a \n b", "a.\n\n\nb",
    " \nThe", "The \nx", "a​ b", "²³¼ ½ªº a", "a\x85b c\x1cd e", "a,b.c:d;e!f?g", "a.. b, ,c 3.14 1,000", "×, ÷. a\x1fb c", ".", "..a", "é.é,", "x.com a.b.c", "", None, "the same text", "the same text", "wört " * 3000, "ab" * 20000,
]


def plain(texts):
    a_side, b_side = ta.tokenizers(A_FILE, B_FILE)
    out, pairs = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (a_side.encode([" " + text])[0], b_side.encode([text])[0]) if text else ([], [])
        if b"".join(a_side.bytes[i] for i in a) != raw or b"".join(b_side.bytes[i] for i in b) != raw:
            out.append(None)
            continue
        a_end, b_end = list(accumulate(len(a_side.bytes[i]) for i in a)), list(accumulate(len(b_side.bytes[i]) for i in b))
        i = j = 0
        links, groups, now = [], [], ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_end[i], b_end[j]
            if x <= y:
                now[0].append(a[i])
                i += 1
            if y <= x:
                now[1].append(b[j])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, side)) for side in now))
                now = ([], [])
        pairs.update(set(links))
        out.append((len(a), len(b), links, groups))
    best = {}
    for (a, _), n in pairs.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else (o[0], o[1], len(o[3]), len(o[2]), sum(pairs[x] == best[x[0]] for x in o[2]), sum(pairs[x] for x in o[2]), hashlib.sha256(";".join(o[3]).encode()).hexdigest()) for o in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, n_a string")


@pytest.mark.parametrize("hot", [400_000, 5])
def test_as_the_plain_alignment(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(ta.frequent_from, "__defaults__", (hot,))
    monkeypatch.setattr(ta.link_counts, "__defaults__", (hot,))
    monkeypatch.setattr(ta, "BLOCK_BYTES", 300)
    got = {r[0]: tuple(r[1:]) for r in ta.alignment_counts(docs, A_FILE, B_FILE).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[k] for k in range(len(ODD))] == plain(ODD)


def test_parts_are_encoded_as_the_whole():
    parts = ta.Parts(*ta.tokenizers(A_FILE, B_FILE))
    for text in filter(None, ODD):
        cut = parts.parts(text)
        assert "".join(cut) == " " + text


def test_groups_and_links(spark):
    one = spark.createDataFrame([(7, "wonderful étage")], "doc_id long, text string")
    row = ta.align(ta.tokens_of(one, A_FILE, B_FILE)).first()
    assert row.key == 7 and [i for g in row.groups for i in g.a] and sum(len(g.a) for g in row.groups) == row.n_a and len(row.links) == row.n_a + row.n_b - len(row.groups)


def test_empty_and_null_keys(spark, docs):
    assert ta.alignment_counts(docs.limit(0), A_FILE, B_FILE).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.n_groups, r.count_sum) for r in ta.alignment_counts(rows, A_FILE, B_FILE).collect()] == [(None, 2, 4)] * 2


def test_parts_of_the_last_blocks_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(ta, "CACHE_PARTS", 6)
    parts = ta.Parts(*ta.tokenizers(A_FILE, B_FILE))
    parts.learn([" one", " two", " three", " four", " five", " six", " seven"])
    before = parts.sides[0].encode_parts
    asked = []
    monkeypatch.setattr(ta.ByteTokenizer, "encode_parts", lambda self, new: asked.extend(new) or before(new))
    parts.learn([" two", " eight"])
    assert asked == [" eight"] and parts.known.keys() == {" two", " eight"}


def test_a_part_names_the_ids_at_each_byte(spark):
    one = spark.createDataFrame([(7, "wonderful")], "doc_id long, text string")
    part = ta.tokens_of(one, A_FILE, B_FILE).first().parts[0]
    a_side, b_side = ta.tokenizers(A_FILE, B_FILE)
    a, b = a_side.encode([" wonderful"])[0], b_side.encode(["wonderful"])[0]
    assert bytes(part.digits).decode() == "".join(f"{i}," for i in [*a, *b])
    for ids, ends, held, starts, side in ((a, part.a_end, part.a_id, part.a_from, a_side), (b, part.b_end, part.b_id, part.b_from, b_side)):
        assert ends == list(accumulate(len(side.bytes[i]) for i in ids)) and held == [0, *(i for i in ids for _ in side.bytes[i])]
        assert [bytes(part.digits)[starts[s] - 1 : starts[e] - 2].decode() for s, e in zip([0, *ends[:-1]], ends, strict=True)] == list(map(str, ids))
