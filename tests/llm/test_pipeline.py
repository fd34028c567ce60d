"""The stages one after another, as the driver runs them."""

import corpus_pipeline


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before, name
            before = docs.count()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def test_clean_documents_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, data).select("doc_id").collect()}
    clean = [r.doc_id for r in labels.where("toxic = 0").collect()]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
