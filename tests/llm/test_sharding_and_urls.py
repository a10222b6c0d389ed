import zlib

from tallyspark.llm import sharding, url_filter


def docs(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text é {i}" * (i % 7)) for i in range(600)] + [(None, None), (5, None), (5, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_slots_sizes_and_growth(spark):
    d = sharding.document_sizes(docs(spark))
    rows = sharding.number_slots(sharding.assign_shards(d, "doc_id", sharding.balanced_tree(24)), "doc_id", ["text_crc32"], rows_per_bucket=50).collect()
    assert len(rows) == 603
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 5 < sum(r.grown_shard == 24 for r in rows) < 80
    assert {r.size for r in rows if r.doc_id is None} == {8} and next(r for r in rows if r.doc_id == 3).text_crc32 == zlib.crc32(b"same")
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1


def test_only_the_changed_subtree_moves(spark):
    tree = sharding.balanced_tree(12)
    region = tree.children[0]
    heavier = sharding.replace(tree, children=(sharding.replace(region, children=(sharding.replace(region.children[0], weight=5.0), *region.children[1:])), *tree.children[1:]))
    df = spark.range(2000).select(sharding.shard_of(sharding.F.col("id"), tree).alias("a"), sharding.shard_of(sharding.F.col("id"), heavier).alias("b"))
    inside = {c.shard for rack in region.children for c in rack.children}
    moved = [(r.a, r.b) for r in df.collect() if r.a != r.b]
    assert moved and all(a in inside and b in {c.shard for c in region.children[0].children} for a, b in moved)


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.example.NET/en/x?q", "https://example.net/de", "ftp://x.example.com/de/1#f", "no scheme", None, "http://org/fr/", "http://notorg/fr/", "http://é.Net?x", "://", "http://q.net#/en/", "http://org/fr/?a://b"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, spark.createDataFrame([], "host string, bad boolean")).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de", "net/", "block"), 2: ("x.example.com", "/de/1", "example.com/de/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("org", "/fr/", "org/fr/", "allow"), 6: ("notorg", "/fr/", None, "allow"), 7: ("é.net", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("q.net", "", None, "allow"), 10: ("org", "/fr/", "org/fr/", "allow"),
    }


def test_reputation_shrinks(spark):
    rows = [("bad.x.com", True)] * 40 + [("one.y.com", True)] + [(f"h{i}.z.com", i % 10 == 0) for i in range(60)] + [("new.x.com", None)] + [("good.z.com", False)] * 30
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.x.com"].lower > 0.5 > got["one.y.com"].lower and got["good.z.com"].mean < 0.1
    assert got["one.y.com"].mean < 0.9 and got["new.x.com"].mean > got["good.z.com"].mean and got["new.x.com"].n == 0
    pages = spark.createDataFrame([(1, "http://bad.x.com/"), (2, "http://good.z.com/")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, spark.createDataFrame(rows, "host string, bad boolean")).collect()} == {1: "block", 2: "allow"}
