"""Operator 1 finds the same leaks however its items are dealt over indexes."""

import random

import pytest

from fixtures import SF
from sessionlens.llm import decontaminate


@pytest.mark.parametrize("shard", [7, 60])
def test_shards_change_nothing(spark, monkeypatch, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    rng = random.Random(1)
    some = [r["text"] for r in items.collect()]
    near = [(1000 + k, " ".join(w for w in some[k].split() if rng.random() > 0.05)) for k in range(40)]  # borderline passages
    docs = docs.union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.leaks(docs, items).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
    assert rows() == whole and len(whole) > 10
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.leaks(docs, items.repartition(3)).collect()) == whole
