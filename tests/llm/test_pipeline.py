import corpus_pipeline
from tallyspark.llm import minmax_dedup, sentencepiece_codec


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{k}")
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns, name
            assert docs.count() <= rows
            rows = docs.count()
            assert docs.where("n_chars <> length(text)").isEmpty()
        if k == 1:
            assert minmax_dedup.near_duplicates(docs).where("not kept").isEmpty()
    assert docs.count() == rows
    assert docs.columns == sentencepiece_codec.ENCODED.names and docs.where("not lossless").isEmpty()


def test_run_on_no_rows(spark, tmp_path):
    for t, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, and columns named like inner ones."""
    long = " ".join(f"Word{i % 997} of the long text." for i in range(4000))
    good = "This is an ordinary paragraph of prose, with commas and a full stop. It goes on for a while, and then it ends."
    rows = [(1, good), (1, good), (2, good), (None, good), (3, None), (4, ""), (5, long), (5, "Mrs Smith wrote to a@b.com about the ordinary paragraph. " + good), (6, long + " x"), (None, None), (7, "﷐ odd ﷑ marks, and Mr Smith.")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, has string, k string, quality string, copies string, t string, id string"
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *[f"{c}{n}" for c in "hkqcti"]) for n, (i, t) in enumerate(rows)], kind)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (4, None, None), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:3]:  # the classifier may reject any of so few
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
    left = sorted(((r.doc_id or 0, r.text or "") for r in docs.collect()))
    assert [i for i, _ in left] == [0, 0, 1, 3, 4, 5, 5, 7]
    assert not any("Smith" in t or "a@b.com" in t for _, t in left)
    assert docs.where("has not like 'h%' or k not like 'k%' or quality not like 'q%' or copies not like 'c%' or t not like 't%' or id not like 'i%'").isEmpty()
    for name, stage in [corpus_pipeline.STAGES[0], *corpus_pipeline.STAGES[3:]]:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= 8 and (name == "SentencePiece encoding" or out.columns == docs.columns)
