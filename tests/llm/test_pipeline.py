from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributo.llm import mixing, secrets

from . import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = corpus_pipeline._written(spark, stage(spark, docs, sf_dir), name)
        seen[name] = before, docs
        if name != "mixing":
            assert docs.columns == columns
    before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in seen["toxicity"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(before) - set(after)
    assert sum(labels.get(d, 1) for d in gone) >= 0.9 * len(gone)
    before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in seen["near_dedup"])
    assert set(after) == {d for d, (_, c, _) in brute.components(list(before.items()), 5, 80).items() if c == d}
    before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in seen["decontamination"])
    items = [" ".join(brute.words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, t in before.items() if any(i in " ".join(brute.words(t)) for i in items)}
    assert leaks <= set(before) - set(after)
    before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in seen["secrets"])
    assert after == {d: secrets.redact(t) for d, t in before.items()} and not any(brute.base_secrets(t) for t in after.values())
    before, after = seen["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() and all(texts[r.doc_id] == r.text and len(brute.words(r.text)) == r.n_tokens for r in after.collect())
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {d: n for d, n in plan.items() if n}


def test_run_and_repeated_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "source", "text", "n_tokens", "weight", "draw", "place"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    twice = docs.unionByName(docs)
    assert corpus_pipeline.near_dedup(spark, twice, sf_dir).groupBy("doc_id").count().where(F.col("count") > 1).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_nothing_in_nothing_out(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    nulls = docs.limit(1).select(*[F.lit(None).cast(k).alias(c) for c, k in docs.dtypes])
    assert stage(spark, nulls, sf_dir).count() <= 1
