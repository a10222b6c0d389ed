import math
import random

import pytest

from tallyspark.llm import sentencepiece_codec as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def best_score(v, s):
    """The highest score of any segmentation, by plain dynamic programming."""
    best = [0] + [-math.inf] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - v.longest), end):
            hit = v.ids.get(s[start:end])
            if hit:
                best[end] = max(best[end], best[start] + hit[1])
        best[end] = max(best[end], best[end - 1] + v.unknown if s[end - 1] not in v.ids else -math.inf)
    return best[-1]


def score_of(v, ids, s):
    names = {i: (p, sc) for p, (i, sc) in v.ids.items()}
    total, pending = 0, 0
    for i in ids:
        if i in names:
            total += names[i][1]
        else:
            pending += 1
    unknown = sum(len((c.SPACE if x == c.LITERAL else x).encode()) for x in s if x not in v.ids)
    assert pending == unknown
    return total + v.unknown * sum(x not in v.ids for x in s)


@pytest.fixture(scope="module")
def vocabulary():
    return c.load_vocabulary(MODEL)


def texts():
    rng = random.Random(3)
    alphabet = ["the", "ing", "é", "ß", "日本", "😀", " ", "  ", "\n", "x", "▁", "0", "\t", "qz"]
    return ["", " ", "a", "▁", "é" * 50, "aaaa" * 300] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(60)]


def test_best_segmentation_and_round_trip(vocabulary):
    e = c.Encoder(vocabulary)
    for text in texts():
        ids = e.encode(text).tolist()
        assert c.decode(ids, vocabulary.tokens) == text
        if text:
            s = c.SPACE + text.replace(c.SPACE, c.LITERAL).replace(" ", c.SPACE)
            assert score_of(vocabulary, ids, s) == best_score(vocabulary, s)
            assert vocabulary.split is None or e.stream(s) == ids


def test_window_is_bounded(vocabulary):
    e = c.Encoder(vocabulary)
    e.stream("the quick brown fox jumps over lazy dogs ".replace(" ", c.SPACE) * 500)
    assert e.longest_window <= 6 * vocabulary.longest


def test_remembered_stretches_change_nothing(vocabulary):
    """One search over the whole text, without the table, commits the same ids."""
    e = c.Encoder(vocabulary)
    for text in texts():
        s = c.SPACE + text.replace(c.SPACE, c.LITERAL).replace(" ", c.SPACE)
        assert e.encode(text).tolist() == e.encode(text).tolist() == (c.Encoder(vocabulary).stream(s) if text else [])


def test_short_equals_stream(vocabulary):
    e = c.Encoder(vocabulary)
    for text in texts():
        for s in (vocabulary.split.findall(c.SPACE + text.replace(" ", c.SPACE)) if vocabulary.split else []):
            assert e.short(s) == e.stream(s)


def test_remembered_stretches_are_few_and_frequent(vocabulary, monkeypatch):
    """The table stays within its bound, and a stretch that comes again and again is searched once."""
    monkeypatch.setattr(c, "CACHE_ENTRIES", 100)
    e = c.Encoder(vocabulary)
    searched, search = [], e.short
    monkeypatch.setattr(e, "short", lambda s: searched.append(s) or search(s))
    for k in range(1000):
        ids = e.encode(f"hello a{k}").tolist()
        assert c.decode(ids, vocabulary.tokens) == f"hello a{k}"
        assert len(e.cache) + len(e.older) <= 100
    assert searched.count(f"{c.SPACE}hello") == 1 and len(searched) == 1001
    assert c.CACHE_ENTRIES == 100 and c.Encoder(vocabulary).encode("hello a1" * 40).tolist() == e.encode("hello a1" * 40).tolist()


def test_documents(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x"), (None, "long " * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids, r.n_ids, r.lossless) for r in c.encode_documents(df, MODEL).collect()), key=lambda r: (r[0], r[2]))
    assert [(r[0], r[3]) for r in got] == [(0, True), (1, True), (1, True), (2, None), (3, True)]
    assert got[3][1] is None and got[3][2] == 0 and got[4][1] == []
    back = c.decode_documents(c.encode_documents(df, MODEL), MODEL)
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r[1]) for r in rows)
    assert c.encode_documents(df.limit(0), MODEL).count() == 0
