"""Bounded, repeatable training samples for the learned operators, and training away from the driver.

A sample is bounded by rows alone: the first ones in the order of a hash of their id, whole and whatever
their lengths.  The task that learns holds these texts once; their features are made in runs of bounded size.

Training runs in one task on an executor, which reads the sample from a written table; the driver gets the
model alone.  A lost executor costs that task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """text and label of documents that the first ``rows`` usable labels speak of, with their order.

    Labels other than 0 and 1, null texts and null ids are left out."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("training"))
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .orderBy(order, "doc_id", "label")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # `known` holds at most `rows` pairs of numbers, whatever the input's size
    return texts.join(F.broadcast(known), "doc_id").select(F.struct(order.alias("o"), F.col("doc_id").cast("string").alias("d"), F.xxhash64("text").alias("t"), F.col("label").alias("l")).alias("place"), "text", "label")


def crossed(texts: list[str], labels: list, fit: Callable, say: Callable) -> np.ndarray:
    """What models learned from each half of a sample say of the other half's texts."""
    half = np.arange(len(texts)) % 2  # a sample comes in hash order
    pick = lambda rows, k: [x for x, h in zip(rows, half, strict=True) if h == k]
    said = [say(fit(pick(texts, 1 - k), pick(labels, 1 - k)), pick(texts, k)) for k in range(2)]
    out = np.zeros((len(texts), *said[0].shape[1:]))
    for k in range(2):
        out[half == k] = said[k]
    return out


def fitted(sample: DataFrame, rows: int, fit: Callable[[list[str], list], object]):
    """What ``fit`` makes of the sample's first ``rows`` texts and labels (columns place, text, label)."""
    # the place of the last of them, from places alone
    end = sample.select("place").orderBy("place").limit(rows).agg(F.max("place").alias("place"), F.count("*").alias("n")).first()
    if not end["n"]:
        return fit([], [])
    last, end = end["n"], end["place"]
    within = sample.where(F.col("place") <= F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(end, sample.schema["place"].dataType.fields, strict=True)]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = sorted((tuple(p.values()), t, y) for b in batches for p, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))[:last]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows_], [y for _, _, y in rows_]))], pa.binary())], ["model"])

    made = store.table(within.repartition(1).mapInArrow(learn, "model binary"), "model")
    model = pickle.loads(made.first()[0])
    store.drop(made)
    return model
