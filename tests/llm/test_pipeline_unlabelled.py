"""The language stage keeps clean documents where no language can be learned."""

import corpus_pipeline
from lorebank.llm import language


def test_a_table_without_labels_keeps_its_documents(spark, tmp_path):
    texts = [None, "", "12 34", "A short clean text.", "日本語", "é"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in enumerate(texts)], schema)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    long = spark.createDataFrame([(9, "word " * language.SAMPLE_BYTES, "en", "s", 1)], schema)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, long, "").collect()] == [9]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "bench " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [3, 4, 5]
