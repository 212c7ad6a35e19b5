from collections import Counter

import corpus_pipeline as C
from loadspark.llm import mixing, near_dedup, quality_classifier, secret_scan


def test_stages(spark, sf, documents):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "near-duplicates", "secret scan", "source mix", "sentence pieces"]
    good = C.keep_good(spark, documents, sf)
    assert good.columns == documents.columns
    model = quality_classifier.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    want = quality_classifier.classify(documents, model).where("predicted = 1")
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect())
    single = C.drop_copies(spark, documents, sf)
    kept = near_dedup.near_duplicates(documents).where("kept")
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in kept.select("doc_id").collect())
    masked = C.mask_secrets(spark, documents, sf)
    assert masked.columns == documents.columns and masked.count() == documents.count()
    again = secret_scan.scan(masked, secret_scan.train(documents)).collect()
    assert all(s["kind"] > 2 for r in again for s in r["spans"])
    mixed = C.mix_sources(spark, documents, sf)
    assert mixed.columns == documents.columns
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= mixing.MOST


def test_run(spark, sf, documents):
    out = C.run(spark, sf).collect()
    assert out and all(r["round_trip"] for r in out)
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in documents.collect()}


def test_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for name, stage in C.STAGES:
            stage(spark, docs, sf).collect()
