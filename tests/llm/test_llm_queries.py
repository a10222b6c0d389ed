"""The operators' queries against their SQL, and all of them for their rows and columns."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyspark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op3_url_reputation": "page_id host path rule verdict", "op5_katz": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_rotation_codes": "vec_id n_links component_id kept",
    "op7_interleaved_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature position caption", "op8_hash_tree": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_quality_pu": "doc_id held_out score predicted", "op10_minmax": "doc_id n_shingles component_id kept",
    "op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_revisits": "page_id payload_bytes payload_digest record_type refers_to",
}
TABLE = {"op3_url_reputation": "pages", "op12_revisits": "pages", "op6_rotation_codes": "embeddings"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    if name == "interleaved_pages":  # an item a row
        assert set(got.page_id) == {r[0] for r in con.sql("select page_id from pages").fetchall()}
        return
    if name == "op13_spelling_variants":  # a word a row
        assert list(got.columns) == ["word", "form", "root", "n", "n_near", "form_n"] and len(got) > 100
        return
    assert len(got) == con.sql(f"select count(*) from {TABLE.get(name, 'documents')}").fetchall()[0][0]
    assert set(COLUMNS.get(name, "doc_id").split()) <= set(got.columns)
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        key, columns = want.columns[0], list(want.columns)
        assert sorted(got.columns) == sorted(columns)
        rows = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df.sort_values(key)[columns].itertuples(index=False, name=None)]
        assert rows(got) == rows(want)
