"""Quality classifier: supervised subword embeddings with a softmax output.

``train`` learns from a bounded sample of labelled documents, ``score`` adds the
probability of label 1 to each row of a DataFrame.  Labels, language, source and id are
never inputs of a score: it is a function of the whole text.

Edge cases: a null or empty text gets the score of a text without features; null labels,
and labels other than 0 and 1, teach nothing; equal texts get equal scores; without any
usable label every score is 0.5; all columns of the input are kept, and a column
named like the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .arrays import utf8
from .subword import SubwordModel, fit, sharpen
from .training import crossed, fitted, labelled

#: Most labelled documents that the model is trained on.
TRAIN_ROWS = 6000
THRESHOLD = 0.7
EPOCHS = 10


def fit_texts(texts: list[str], labels: list[int]) -> SubwordModel:
    """Learns from all texts, with a temperature from what models of one half say of the other."""
    learn = lambda x, y: fit(x, y, epochs=EPOCHS)
    model = learn(texts, labels)
    if len(model.classes) == 2:
        sharpen(model, crossed(texts, labels, learn, lambda m, x: m.log_odds(x, model.classes)), labels)
        model.temperature = float(np.clip(model.temperature, 0.5, 2.0))
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS) -> SubwordModel:
    """``keep`` (a condition over ``labels``) says which labels may be learned."""
    sample = store.table(labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, rows), "sample")
    model = fitted(sample, rows, fit_texts)
    store.drop(sample)
    return model


def score(docs: DataFrame, model: SubwordModel, column: str = "score", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the table's buckets

    @F.arrow_udf("double")
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for part in parts:
            data, offsets = utf8(part)
            if 1 in m.classes and len(m.classes) > 1:
                yield pa.array(m.probabilities(data, offsets)[:, m.classes.index(1)], pa.float64())
            else:
                yield pa.array(np.full(len(part), 0.5 if not m.classes else float(m.classes[0])), pa.float64())

    return docs.withColumn(column, probability(F.col(text)))


def keep_good(docs: DataFrame, model: SubwordModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at least ``threshold``, with their columns as they were."""
    names = docs.columns
    return score(docs, model, "_quality_score").where(F.col("_quality_score") >= threshold).select(*names)
