"""The operators' queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, katz, media, minmax_dedup, mixing, pii, quality, sentencepiece_codec, sharding, spelling_variants, token_alignment, url_filter, warc
from .common import table


#: Where the public tokenizers' files are; pass another path to the operators themselves.
SENTENCEPIECE_MODEL, BYTE_MODEL = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the surrogates: the session's own, else one for the synthetic tables, which hold nobody's data."""
    return spark.conf.get("spark.tallyspark.surrogateKey", "key of the synthetic tables")


def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts back from the ids of op 1."""
    encoded = op1_sentencepiece(spark, sf_dir).select("doc_id", "ids")
    return sentencepiece_codec.decode_documents(encoded, SENTENCEPIECE_MODEL).select("doc_id", "text")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count="n_replaced")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("bad_lower")


#: Shares of the expected tokens by domain, at as many expected tokens as there are.
TARGET_SHARES = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGET_SHARES)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sequences = media.interleaved(media.text_pages(docs))
    features = media.described(media.media_table(media.text_payloads(docs)))
    return media.resolve(sequences, features, "doc_id").where("kind = 'image'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the pages table, an item a row."""
    sequences = media.interleaved(table(spark, sf_dir, "pages"))
    return sequences.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.document_sizes(table(spark, sf_dir, "documents"))
    placed = sharding.number_slots(sharding.assign_shards(docs, "doc_id", sharding.balanced_tree(24)), "doc_id", ["text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op6_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(table(spark, sf_dir, "documents"), BYTE_MODEL, SENTENCEPIECE_MODEL)


def op12_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece, "op2_surrogates": op2_surrogates, "op3_url_reputation": op3_url_reputation, "op4_soft_mixing": op4_soft_mixing, "op5_katz": op5_katz,
    "op6_rotation_codes": op6_rotation_codes, "op7_interleaved_media": op7_interleaved_media, "op8_hash_tree": op8_hash_tree, "op9_quality_pu": op9_quality_pu, "op10_minmax": op10_minmax,
    "op11_token_alignment": op11_token_alignment, "op12_revisits": op12_revisits, "op13_spelling_variants": op13_spelling_variants,
    "decoded_documents": decoded_documents, "interleaved_pages": interleaved_pages,
}

#: Components of links (a, b, both ways) among nodes: each node with the smallest id that it reaches.
_COMPONENTS = """reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT l.b, r.root FROM reach AS r JOIN links AS l ON l.a = r.node),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

TWO_LABELS = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)
_OP3 = """WITH page AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path, try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint) AS doc_id FROM pages),
  marked AS (SELECT doc_id, max(cast(quality = 0 OR toxic = 1 AS int)) AS bad FROM labels GROUP BY 1),
  counted AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM page AS p LEFT JOIN marked AS m ON m.doc_id = p.doc_id GROUP BY host),
  host AS (SELECT host, n, k, array_to_string(parts[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain, array_to_string(parts[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix FROM (SELECT *, array_to_string(parts[-2:], '.') IN ({TWO_LABELS}) AS two FROM counted) AS c),
  overall AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m FROM host),
  domain AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM host GROUP BY 1), suffix AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domain GROUP BY 1),
  t1 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * power(cast(k AS double) / n - m, 2) / (m * (1 - m))) AS s FROM suffix, overall WHERE n > 0),
  s1 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 10.0 ELSE (1 - least(greatest((s - g) / (n - g), 0.001), 0.5)) / least(greatest((s - g) / (n - g), 0.001), 0.5) END AS v FROM t1),
  d2 AS (SELECT d.domain, d.n, d.k, (o.m * s1.v + x.k - d.k) / (s1.v + x.n - d.n) AS m FROM domain AS d JOIN suffix AS x ON x.suffix = d.suffix, overall AS o, s1),
  t2 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * power(cast(k AS double) / n - m, 2) / (m * (1 - m))) AS s FROM d2 WHERE n > 0),
  s2 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 10.0 ELSE (1 - least(greatest((s - g) / (n - g), 0.001), 0.5)) / least(greatest((s - g) / (n - g), 0.001), 0.5) END AS v FROM t2),
  h3 AS (SELECT h.host, h.n, h.k, (d.m * s2.v + d.k - h.k) / (s2.v + d.n - h.n) AS m FROM host AS h JOIN d2 AS d ON d.domain = h.domain, s2),
  t3 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * power(cast(k AS double) / n - m, 2) / (m * (1 - m))) AS s FROM h3 WHERE n > 0),
  s3 AS (SELECT CASE WHEN g = 0 OR n <= g THEN 10.0 ELSE (1 - least(greatest((s - g) / (n - g), 0.001), 0.5)) / least(greatest((s - g) / (n - g), 0.001), 0.5) END AS v FROM t3),
  lower AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_lower FROM (SELECT host, m * v + k AS a, (1 - m) * v + n - k AS b FROM h3, s3) AS x)
SELECT page_id, host, path, rule, coalesce(CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' END, CASE WHEN bad_lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM (
  SELECT page_id, p.host, path, bad_lower, CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (p.host = 'org' OR p.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM page AS p LEFT JOIN lower AS l ON l.host = p.host) AS y""".replace("{TWO_LABELS}", TWO_LABELS)

_OP6 = f"""WITH RECURSIVE vec AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec AS a JOIN vec AS b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
links AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair), nodes AS (SELECT vec_id AS node FROM embeddings), {_COMPONENTS}
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings AS e JOIN component AS c ON c.node = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) AS k ON k.a = e.vec_id"""

_OP10 = f"""WITH RECURSIVE word AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM word) AS x),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pair AS (SELECT a, b FROM common JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair), nodes AS (SELECT doc_id AS node FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents AS d JOIN component AS c ON c.node = d.doc_id LEFT JOIN size AS s ON s.doc_id = d.doc_id"""

_OP12 = """WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages), sized AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest FROM page),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM sized), told AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM largest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM told"""

#: Fitted models, tokenizers, token search, crc32, keyed hashes of Spark's own and compressed media have no SQL form; they are tested by brute force.
ORACLE_SQL: dict[str, str] = {"decoded_documents": "SELECT doc_id, text FROM documents", "op3_url_reputation": _OP3, "op6_rotation_codes": _OP6, "op10_minmax": _OP10, "op12_revisits": _OP12}
