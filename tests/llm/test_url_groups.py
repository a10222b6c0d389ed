import duckdb
from pyspark.sql import functions as F

from tallyspark.llm import url_filter
from tallyspark.llm.queries import ORACLE_SQL


def test_groups_of_hosts(spark):
    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("user:pw@x.shop.com:8080", "shop.com", "com"), ("shop.com:", "shop.com", "com"), ("com", "com", "com"), ("", "", ""), ("co.uk", "co.uk", "co.uk")]
    df = spark.createDataFrame(rows, "host string, domain string, suffix string")
    host = url_filter.bare_host(F.col("host"))
    assert df.where((url_filter.registered_domain(host) != F.col("domain")) | (url_filter.host_suffix(host) != F.col("suffix"))).isEmpty()


def test_against_sql_with_ports_users_and_long_suffixes(spark):
    """Odd hosts, repeated rows, null urls, unlabelled pages and clashing columns."""
    hosts = ["a.shop.co.uk", "b.shop.co.uk:80", "me@c.other.co.uk", "d.plain.de", "e.plain.de:8080", "f.lone.fr", "g.good.es"]
    pages = [(i, f"http://{hosts[i % 7]}/en/{i}", "x") for i in range(140)] + [(5, "http://d.plain.de/en/5", "x")] * 3 + [(500, None, "x"), (501, "nothing", "x"), (502, "https://NET/a?b#c", "x"), (503, "https://example.net/en/3", "x")]
    labels = [(i, 0 if i % 7 < 3 and i % 5 else 1, 1 if i % 31 == 0 else 0) for i in range(140) if i % 3]
    p, m = spark.createDataFrame(pages, "page_id long, url string, host string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, url_filter.filter_urls(p, url_filter.page_outcomes(p, m)).drop("bad_lower").collect()), key=repr)
    con = duckdb.connect()
    for name, df in (("pages", p.toPandas()), ("labels", m.toPandas())):
        con.register(name, df)
    assert got == sorted(con.sql(ORACLE_SQL["op3_url_reputation"]).fetchall(), key=repr)
    assert {r[4] for r in got} == {"allow", "block"} and len(got) == len(pages)
