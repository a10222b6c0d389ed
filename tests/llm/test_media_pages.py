import hashlib
import random
import re
import struct
import zlib

import pytest

from tallyspark.llm import media
from tallyspark.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<![foo[x]]>a", [("text", "a")]),
        ("<html><head><title>t</title><body><p>hello</p>", [("text", "hello")]),
        ("<head><title>t</title>text<p>x", [("text", "text"), ("text", "x")]),
        ("<figure><img src=a><figcaption>cap<p>more</figure>after", [("image", "a", "cap more"), ("text", "after")]),
        ("<figure><figcaption>cap</figcaption><img src=a alt=z></figure>b", [("image", "a", "cap"), ("text", "b")]),
        ("<figure><img src=a><figcaption>cap", [("image", "a", "cap")]),
        ("<figure><img src=a><figcaption>c</figcaption></article><img src=b>x", [("image", "a", "c"), ("image", "b", None), ("text", "x")]),
        ("<figcaption>lone</figcaption>x", [("text", "lone"), ("text", "x")]),
        ("<p>a<script>b</script>c", [("text", "ac")]),
        ("", []),
        ("<![", [("text", "<![")]),
    ],
)
def test_html(html, want):
    got = [("text", x["text"]) if x["kind"] == "text" else (x["kind"], x["ref"], x["caption"]) for x in media.parse_html(html)]
    assert got == want
    assert [x["position"] for x in media.parse_html(html)] == list(range(len(want)))


def test_no_html_stops_the_parser():
    rng = random.Random(2)
    parts = ["<", ">", "<!", "<![", "]]>", "-->", "<!--", "<head>", "</head>", "<figure>", "</figure>", "<figcaption>", "<img src=x>", "<script>", "</script>", "<title>", "&", "&#", "text ", '"', "<?", "\0", "<body>", "<template>"]
    for _ in range(5000):
        media.parse_html("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))))
    assert media.parse_html(None) is None


def test_pages_in_reading_order(spark, sf_dir):
    """Against the article's paragraphs, cut out by patterns."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    items = {}
    for r in QUERIES["interleaved_pages"](spark, sf_dir).collect():
        items.setdefault(r.page_id, {})[r.position] = r.text
    plain = lambda s: " ".join(re.sub("<[^>]*>", "", s).split())
    checked = 0
    for k, html in pages.items():
        got = [items[k][i] for i in range(len(items[k]))]
        want = [plain(x) for x in re.findall(r"<p>([^&]*?)</p>", html.split("<article>")[-1]) if plain(x) and "<br>" not in x and "<p>" not in x]
        assert [x for x in got if x in set(want)] == want or len(set(want)) < len(want)
        checked += len(want)
    assert checked > len(pages)


def test_op7_against_recomputed_bytes(spark, sf_dir):
    """Each column from the text alone: the image is taken apart with zlib, the feature recomputed pixel by pixel."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    stored = {r.digest: r.media for r in media.media_table(media.text_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()}
    rows = QUERIES["op7_interleaved_media"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = stored[hashlib.sha256(raw).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.position, r.caption) == (len(image), hashlib.sha256(image).hexdigest(), 1, str(r.doc_id))
        at = image.index(b"IDAT")
        pixels = zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]])
        assert b"".join(pixels[i + 1 : i + 65] for i in range(0, len(pixels), 65)) == payload
        height = len(payload) // 64
        mean = sum(payload) / len(payload)
        edges = [height * i // 8 for i in range(9)]
        bits = 0
        for a, b in zip(edges, edges[1:]):
            a, b = (a, b) if b > a else (min(a, height - 1), min(a, height - 1) + 1)
            for x in range(0, 64, 8):
                block = [payload[64 * y + x : 64 * y + x + 8] for y in range(a, b)]
                bits = bits * 2 + (sum(map(sum, block)) / (8 * len(block)) > mean + 1e-9)
        assert r.feature == f"{height}x64:{mean:.3f}:{bits:016x}"


def test_few_pages_at_a_time_are_python_objects():
    """A batch of many pages gives what its pages give one by one, in a small part of the memory that their items take as Python objects."""
    import tracemalloc

    import pyarrow as pa

    pages = [None, "", *["<p>some words</p><img src='a.png' alt='b'>" * 500] * 200]
    texts = pa.array(pages)
    want = [media.parse_html(x) for x in pages[:3]]
    tracemalloc.start()
    got = media.parsed_pages(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(pages) and peak < 40e6
    assert [[{k: v for k, v in i.items() if v is not None} for i in x] if x is not None else None for x in got[:3].to_pylist()] == [[{k: v for k, v in i.items() if v is not None} for i in x] if x is not None else None for x in want]
