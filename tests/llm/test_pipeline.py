"""The whole pipeline: each stage's decisions against plain loops over its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_content import similar_roots
from tidemark.llm import queries


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert sorted(numbers) == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, rows, results = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        results[name] = docs.collect()
        docs = spark.createDataFrame(results[name], docs.schema)
        assert docs.columns[:len(names)] == names
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = results["quality classifier"]
    clean = [r["doc_id"] for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] and not labels[r["doc_id"]]["toxic"]]
    assert len({r["doc_id"] for r in good} & set(clean)) >= 0.97 * len(clean)
    root = similar_roots({r["doc_id"]: r["text"] for r in good})
    assert {r["doc_id"] for r in results["near-dedup"]} == set(root.values()) and len(results["near-dedup"]) == len(set(root.values()))
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in results["near-dedup"]:
        if any(t in r["text"] for t in items):
            assert r["doc_id"] not in {x["doc_id"] for x in results["decontamination"]}
    copies = Counter(r["doc_id"] for r in results["mixing"])
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in results["decontamination"]}
    assert Counter(r["doc_id"] for r in results["sharding"]) == copies and {r["shard"] for r in results["sharding"]} == set(range(8))


def test_stages_take_messy_and_empty_tables(spark, sf, messy, nothing):
    for start in (messy, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert set(start.columns) <= set(docs.columns)
