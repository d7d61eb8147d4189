"""The pipeline's stages: each one's decisions hold in what it gives on."""

from collections import Counter

import corpus_pipeline
from dqspark.llm import decontam, toxicity
from test_neardup import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs
        if i < 4:
            assert docs.columns == columns
    given = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fitted(given, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.scored(given, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean
    rows = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    leaders = {c for (n, c) in plain_components(rows, 5, 80)}
    assert Counter(r.doc_id for r in kept["minhash near-dedup"].collect()) == Counter(leaders)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r.key for r in decontam.contaminated(kept["minhash near-dedup"], items).collect()}
    assert {r.doc_id for r in kept["benchmark decontamination"].collect()} == leaders - held
    mixed = kept["mixing to target weights"].collect()
    assert {r.doc_id for r in mixed} <= leaders - held and max(Counter(r.doc_id for r in mixed).values()) <= 3
    final = docs.collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in mixed)
    sizes = Counter(r.shard for r in final).values()
    assert max(sizes) - min(sizes) <= 1


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
