"""The pipeline's stages on whole small tables, and on odd and empty ones."""

from collections import Counter

import corpus_pipeline
from tideline.llm.common import kept


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(kept(f(spark, out[-1], folder), f"test-{name}"))
    return out


def test_stages_keep_columns_and_take_effect(spark, sf_more):
    docs, good, known, single, masked, packed = stages(spark, sf_more)
    for step in (good, known, single, masked):
        assert step.columns == docs.columns
    counts = [x.count() for x in (docs, good, known, single, masked)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] and counts[2] > counts[3] == counts[4]
    assert single.select("text").distinct().count() == counts[3]
    assert masked.where("text like '%[SECRET]%'").count() > 0
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in masked.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf_more}/labels.parquet")
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    wrong, all_good = lost.where("quality = 1").count(), labels.where("quality = 1").count()
    assert wrong <= 0.03 * all_good


def test_run_equals_its_stages(spark, sf):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = stages(spark, sf)[-1].select(key).collect()
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select(key).collect())) == Counter(map(tuple, want))


def test_odd_and_empty_tables(spark, odd_dir, empty_dir):
    corpus_pipeline.run(spark, odd_dir).collect()
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_language_stage_drops_unlearned_languages_and_keeps_labelled_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = ["съешь же ещё этих мягких французских булок да выпей чаю", "xkqj zzvw qqpt hhgf bnmk lkjh wwxz qqjj vvkz", "いろはにほへと ちりぬるを わかよたれそ"]
    extra = spark.createDataFrame([(-i - 1, t, None, "odd", len(t)) for i, t in enumerate(odd)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, docs.union(extra), sf).select("doc_id").collect()}
    assert not got & {-1, -2, -3}
    clean = {r["doc_id"] for r in docs.where("lang is not null and length(text) > 100").select("doc_id").collect()}
    assert len(clean) > 100 and len(clean & got) >= 0.99 * len(clean)
