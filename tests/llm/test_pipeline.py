"""The pipeline's stages, each on what the one before has kept, against plain versions."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_plain import brute_classes, plain_targets
from veilsight.llm import queries, quality_classifier, store, toxicity
from veilsight.llm.arrays import utf8
from veilsight.llm.training import fold

SF, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The labelled documents of a small scale, with rows of every odd kind put in."""
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet").join(spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    good = docs.join(spark.read.parquet(f"{LABELLED}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").select(docs.columns).limit(3).collect()
    odd = [r.asDict() | {"doc_id": 10**6 + i} for i, r in enumerate(good)]
    odd += [good[0].asDict() | {"doc_id": None}, good[1].asDict(), good[1].asDict() | {"source": None, "lang": None, "doc_id": 10**6 + 5}]
    odd += [good[2].asDict() | {"doc_id": 10**6 + 6 + i, "text": t} for i, t in enumerate([None, "", " \n "])]
    docs.unionByName(spark.createDataFrame([tuple(o[c] for c in docs.columns) for o in odd], docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{LABELLED}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def bag(rows, columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def test_stages_match_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{corpus}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def ran(name, docs):
        out = store.table(stage[name](spark, docs, corpus), f"test-{name}")
        return out, out.collect()

    before = docs.collect()
    scores = lambda model, rows: np.concatenate([model.probabilities(*utf8(pa.array([r.text or ""]))) for r in rows])
    # toxicity, then quality: every document scored on its own
    model = toxicity.train(docs, labels, keep=fold("doc_id", 5) != 0)
    docs, after = ran("toxicity", docs)
    assert bag(after, columns) == bag([r for r, p in zip(before, scores(model, before), strict=True) if p < toxicity.THRESHOLD], columns) and 0 < len(after) < len(before)
    model = quality_classifier.train(docs, labels, keep=fold("doc_id", 4) != 2)
    before, (docs, after) = after, ran("quality_classifier", docs)
    at = model.classes.index(1)
    assert bag(after, columns) == bag([r for r, p in zip(before, scores(model, before), strict=True) if p[at] >= quality_classifier.THRESHOLD], columns) and len(after) < len(before)
    # near copies: one of each class stays, documents without words all do
    before, (docs, after) = after, ran("ngram_jaccard_join", docs)
    classes = [c for (_, n, c), many in brute_classes([(r.doc_id, r.text) for r in before]).items() for _ in range(many) if n]
    worded = [r for r in after if (r.text or "").strip(" \n\t")]
    assert collections.Counter(r.doc_id for r in worded) == collections.Counter(set(classes))
    assert len(after) - len(worded) == sum(not (r.text or "").strip(" \n\t") for r in before)
    # mixing: totals near the plain targets, no document more often than twice, all columns as they were
    before, (docs, after) = after, ran("mixing", docs)
    words = lambda r: len((r.text or "").split())
    sizes = collections.Counter()
    for r in before:
        sizes[r.source] += words(r)
    taken = collections.Counter()
    for r in after:
        taken[r.source] += words(r)
    most = max(words(r) for r in before)
    assert all(abs(taken[s] - float(t)) <= most for s, t in plain_targets(dict(sizes)).items())
    assert not bag(after, columns) - bag(before * 2, columns)
    # packing: every copy's pieces, no bin over its room, no cluster twice in a bin
    bins = stage["best_fit_packing"](spark, docs, corpus).collect()
    room, clusters = collections.Counter(), collections.Counter()
    for b in bins:
        room[b.bin] += b["size"]
        clusters[b.bin, b.cluster] += b.cluster is not None
    assert sum(b["size"] for b in bins) == sum(words(r) for r in after) and max(room.values()) <= 4096 and max(clusters.values()) == 1
    assert len({(b.doc_id, b.copy, b.source, b["size"], b.cluster) for b in bins if b.piece == 0}) <= len(after) == sum(b.piece == 0 for b in bins)


def test_run_is_the_stages(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 0 and {"doc_id", "bin", "size"} <= set(out.columns)


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() == 0


def test_queries_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    out = queries.QUERIES["op8_jaccard_join"](spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert out.where(F.col("component_id") > F.col("doc_id")).isEmpty()
