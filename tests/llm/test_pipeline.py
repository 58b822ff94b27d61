import corpus_pipeline
from lorebank.llm import decontaminate, simhash


def test_stages_on_planted_documents(spark, tmp_path):
    rng_words = [f"word{k}" for k in range(4000)]
    base = " ".join(rng_words)
    near = " ".join([*rng_words[:2000], "changed", *rng_words[2001:]])
    bench = " ".join(f"bench{k}" for k in range(20))
    rows = [(0, None), (1, "12 34"), (2, base), (3, f"  {base}"), (4, near), (5, bench + " tail"), (6, "A short clean text."), (7, "")]
    assert bin(simhash.fingerprint(base) ^ simhash.fingerprint(near)).count("1") <= 4
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        left.append(sorted(r.doc_id for r in docs.collect()))
    assert left == [[2, 3, 4, 5, 6], [3, 4, 5, 6], [3, 5, 6], [3, 6]]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in out.collect()}) == [3, 6]


def test_whole_table_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    bad = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    components = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert out and not out & bad and len(out) <= len(components)


def test_an_empty_table_passes_through(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_equals_a_plain_version(spark, sf):
    """All stages over a whole table against plain Python, from texts to the ids of the pieces."""
    import zlib

    import numpy as np
    from test_decontaminate import plain as plain_hits
    from test_packing import plain_tokenizer
    from test_simhash import slow_components, slow_fingerprint

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(k, t) for k, t in rows if t and any(c.isalpha() for c in t)]
    groups = {}
    for k, t in rows:
        groups.setdefault("".join(t.split()), []).append((-len(t), k, t))
    rows = sorted((k, t) for _, k, t in map(min, groups.values()))
    first = slow_components([slow_fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    rows = [(k, t) for k, t in rows if not plain_hits(t, items)[3]]
    tokenizer, want = plain_tokenizer(), set()
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(k, at, zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)
