"""Op 12: archives written, read back and rewritten."""

import gzip
import hashlib
import io

import pyarrow as pa
import pytest

from tallyspark.llm import warc

LONG = "<p>" + "x" * 1200
HOSTILE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 30


def test_pages_as_defined(spark):
    rows = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "http://c/\r\nWARC-Type: x", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", HOSTILE), (9, "u", HOSTILE), (None, "u", LONG), (3, "u", LONG), (11, "u", "é" * 500), (12, "u", "é" * 500), (13, "u", "é" * 499), (14, "u", "é" * 499)]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, headers string").repartition(3)
    got = [tuple(r) for r in warc.archived_pages(spark, pages).collect()]
    assert len(got) == len(rows)
    raw = {r: (r[2] or "").encode() for r in rows}
    want = []
    for r in rows:
        same = [x[0] for x in rows if raw[x] == raw[r] and len(raw[r]) >= 1000 and x[0] is not None]
        top = max(same, default=None)
        want.append((r[0], len(raw[r]), hashlib.sha1(raw[r]).hexdigest(), *(("response", None) if top is None or r[0] == top else ("revisit", top))))
    two = [g for g in got if g[0] == 3]  # a repeated id: one of the two is the response
    assert sorted(g[3] for g in two) == ["response", "revisit"] and {g[4] for g in two} == {None, 3}
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted((g for g in got if g[0] != 3), key=key) == sorted((w for w in want if w[0] != 3), key=key)


def test_empty(spark):
    assert warc.archived_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("packed", ["members", "whole", "plain"])
def test_other_archives(spark, tmp_path, packed):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1500\r\n\r\n" + b"\0\xff" * 750
    digest = warc.sha1_label(b"\0\xff" * 750)
    parts = [
        warc.record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:i>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:1>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Target-URI": "http://a/", "Content-Type": warc.HTTP}, body),
        warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:2>", "WARC-Date": "2021-01-01T00:00:00Z", "WARC-Target-URI": "http://b/", "Content-Type": warc.HTTP}, body),
        warc.record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:3>", "WARC-Payload-Digest": digest, "WARC-Refers-To": "<urn:1>", "Content-Type": warc.HTTP}, b"HTTP/1.1 200 OK\r\nContent-Length: 1500\r\n\r\n"),
        warc.record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:4>", "WARC-Payload-Digest": warc.sha1_label(b"gone"), "WARC-Refers-To": "<urn:0>", "Content-Type": warc.HTTP}, b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    raw = b"".join(parts)
    source = tmp_path / "in"
    source.mkdir()
    (source / ("x.warc" if packed == "plain" else "x.warc.gz")).write_bytes({"members": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(raw), "plain": raw}[packed])
    out = f"file://{tmp_path}/out"
    warc.deduplicate(spark, f"file://{source}", out)
    rows = {r.headers["WARC-Record-ID"]: r for r in warc.read_warc(spark, out).collect()}
    made = {k: rows[warc.fresh_id(f"<urn:{k}>")] for k in "i1234"}
    assert len(rows) == 5 and bytes(made["i"].block) == b"software: x\r\n"
    assert made["2"].headers["WARC-Type"] == "response" and bytes(made["2"].block) == body
    for k in "13":
        assert made[k].headers["WARC-Type"] == "revisit" and made[k].headers["WARC-Refers-To"] == warc.fresh_id("<urn:2>") and made[k].headers["WARC-Refers-To-Target-URI"] == "http://b/"
        assert made[k].payload_bytes == 1500 and made[k].payload_digest == hashlib.sha1(b"\0\xff" * 750).hexdigest() and bytes(made[k].block).endswith(b"\r\n\r\n")
    assert made["4"].headers["WARC-Refers-To"] == "<urn:0>"  # nothing here has its payload


def test_only_committed_archives_count(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    writer = warc.WarcWriter({"path": folder})
    batch = pa.RecordBatch.from_arrays([pa.array([[("WARC-Type", "resource")]], pa.map_(pa.string(), pa.string())), pa.array([b"abc"])], names=["headers", "block"])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    writer.commit([kept, None])
    assert warc.read_warc(spark, folder).count() == 2
    writer.abort([lost])
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


def test_cut_archives_are_errors():
    raw = warc.record_bytes({"WARC-Type": "resource"}, b"abc" * 100)
    assert len(list(warc.records_of(io.BytesIO(raw * 3)))) == 3
    for n in (50, len(raw) - 2, len(raw) + 20):
        with pytest.raises(EOFError):
            list(warc.records_of(io.BytesIO((raw * 2)[:n])))
