import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import media, mixing, quality
from tallyspark.llm.common import crc_bucket


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 5, b"x" * 64):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.from_png(media.to_png(media.padded(b"abc"))[:-20] + b"0" * 20)


def test_interleaving():
    html = '<p>One <b>two</b></p><figure><img src="media:sha256-x" alt="a"><figcaption>cap <i>tion</i></figcaption></figure><script>no</script><img src="y" alt="alt">tail<video src="v">'
    items = media.parse_html(html)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [(0, "text", "One two", None, None), (1, "image", None, "media:sha256-x", "cap tion"), (2, "image", None, "y", "alt"), (3, "text", "tail", None, None), (4, "video", None, "v", None)]
    assert media.parse_html(None) is None and media.parse_html("") == [] and media.parse_html("<p>broken <b") is not None


def test_media_columns(spark):
    rows = [(1, "hé", "x"), (2, None, "y"), (3, "", "z"), (4, "hé", "w"), (None, "q" * 1000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = media.resolve(media.interleaved(media.text_pages(docs)), media.described(media.media_table(media.text_payloads(docs))), "doc_id").where("kind = 'image'").collect()
    assert len(found) == 5
    for r in found:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), str(r.doc_id) if r.doc_id is not None else "")
    assert len({r.media_sha256 for r in found}) == 3
    assert media.resolve(media.interleaved(media.text_pages(docs.limit(0))), media.described(media.media_table(media.text_payloads(docs.limit(0)))), "doc_id").count() == 0


def test_prior_and_risk():
    rng = np.random.default_rng(2)
    p, n = rng.standard_normal((800, 3)) + 1.5, rng.standard_normal((800, 3)) - 1.5
    u = np.concatenate([rng.standard_normal((480, 3)) + 1.5, n[:320]])
    w, b = quality.fit_nnpu(p, u, 0.6)
    assert ((p @ w + b) > 0).mean() > 0.95 and ((n @ w + b) > 0).mean() < 0.05
    assert 0.45 < quality.estimate_prior(p[:400] @ w + b, u @ w + b) < 0.75


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    good, poor = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(r.predicted for r in poor) / len(poor) < 0.35
    assert np.mean([g.score > b.score for g in good[:300] for b in poor[:100]]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "a b", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 3 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.classify(docs.limit(0), labels).count() == 0


def memberships(spark, rows):
    return spark.createDataFrame([(n, [float(x) for x in p]) for n, p in rows], "n_tokens long, p array<double>")


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 200)), rng.dirichlet([5, 2, 1])) for _ in range(400)]
    df = memberships(spark, rows)
    fitted = mixing.fit_rates(df, {"good": 0.4, "poor": 0.4, "toxic": 0.2})
    got = df.select("n_tokens", "p", fitted.rate(F.col("n_tokens"), F.col("p")).alias("r")).collect()
    a = np.array([[x * n for x in p] for n, p, _ in got])
    r = np.array([x.r for x in got])
    assert (r >= 0).all() and np.allclose(a.T @ r / a.sum(), [0.4, 0.4, 0.2], atol=2e-3)


def test_rates_of_nothing(spark):
    for rows in ([], [(0, [1, 0, 0])]):
        fitted = mixing.fit_rates(memberships(spark, rows), {"good": 1.0})
        assert [r[0] for r in memberships(spark, rows).select(fitted.rate(F.col("n_tokens"), F.col("p"))).collect()] == [1.0] * len(rows)
    with pytest.raises(ValueError):
        mixing.fit_rates(memberships(spark, []), {"good": 0.5})


def test_resample_keeps_clean_documents_once(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.resample(docs, labels, {"good": 0.9, "poor": 0.06, "toxic": 0.04})
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(clean - set(ids)) <= 0.01 * len(clean)


def test_fold_of_ids(spark):
    rows = spark.createDataFrame([(7,), (None,)], "doc_id long").select(crc_bucket("doc_id", 10).alias("b")).collect()
    assert [r.b for r in rows] == [zlib.crc32(b"7") % 10, 0]
