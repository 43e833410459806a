"""Very frequent keys: adaptive execution splits the joins on them, as both sides are tables."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from evlog.llm import codes, secrets

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_a_secret_that_most_documents_have(shuffled):
    def text(i):
        return f"token = hot{'x' * 20}1" if i % 4 else f"token = {hashlib.sha256(str(i).encode()).hexdigest()}"

    docs = shuffled.createDataFrame([(i, text(i), f"s{i % 5}") for i in range(20_000)], "doc_id long, text string, source string").repartition(8)
    rows, plan = final_plan(secrets.scan(docs))
    assert "SortMergeJoin(skew=true)" in plan and len(rows) == 20_000
    assert {(f.n_owners, f.verdict) for r in rows if r.doc_id % 4 for f in r.findings} == {(5, "example")}


def test_a_label_that_most_vectors_have(shuffled, monkeypatch):
    monkeypatch.setattr(codes, "MAX_BROADCAST_LABELS", 0)
    coded = shuffled.range(60_000).select("id", F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(-1).alias("label"),
                                          F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit(2).cast("long").alias("error"))
    rows, plan = final_plan(codes.with_label_error(coded.repartition(8)))
    assert "SortMergeJoin(skew=true)" in plan and len(rows) == 60_000
    assert {r.label_error for r in rows if r.label == -1} == {2 * 57_000}
