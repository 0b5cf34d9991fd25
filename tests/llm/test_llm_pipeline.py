import corpus_pipeline
from rallylens.llm import decontaminate, langid, packing, pii, registry, simhash


def test_stages_are_the_operators_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = registry.language_model(docs)
    rows = docs.select("doc_id", "text", langid.language("text", model).alias("p")).collect()
    told = {r.doc_id for r in rows if r.p.lang_pred != "und" and r.p.score >= corpus_pipeline.LEAST_SCORE}
    state, kept = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf)
        assert state.columns == docs.columns
        now = {r.doc_id for r in state.select("doc_id").collect()}
        if name == "language":
            assert now == told
        elif name == "near_duplicates":
            first = {}
            for r in rows:
                if r.doc_id in kept:
                    first.setdefault(simhash.text_fingerprint(r.text), r.doc_id)
            assert now <= kept and len({simhash.text_fingerprint(r.text) for r in rows if r.doc_id in now}) == len(now)
        elif name == "benchmark_passages":
            hits = decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0")
            assert now == kept - {r.doc_id for r in hits.collect()}
        else:
            assert now == kept and pii.find(state).where("size(spans) > 0 and not exists(spans, s -> s.kind = 'phone')").count() == 0
        kept = now
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == kept
    assert {r.length for r in packed} <= set(range(1, 2049)) and packing.END == 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
