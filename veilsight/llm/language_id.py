"""Language identification: averaged hashed subword embeddings with a linear softmax.

Learned from the text and the non-null language of a bounded sample of documents;
language, source and id are never inputs of a prediction.  Probabilities are calibrated
by a temperature fitted on what models of half of the documents say of the other half, and a prediction whose probability is below the
calibrated threshold is marked as rejected.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected;
equal texts get equal predictions; without any labelled text everything is ``und``; all
columns of the input are kept.
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
from .training import crossed, fitted

#: Most documents that the model is trained on.
TRAIN_ROWS = 6000


def fit_texts(texts: list[str], langs: list[str]) -> SubwordModel:
    """Learns from all texts; temperature and threshold from what models of one half say of the other."""
    learn = lambda x, y: fit(x, y, lower=True, epochs=3)
    model = learn(texts, langs)
    if len(model.classes) > 1:
        sharpen(model, crossed(texts, langs, learn, lambda m, x: m.log_odds(x, model.classes)), langs)
    return model


def train(docs: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS) -> SubwordModel:
    """``keep`` is a condition over ``docs`` that says which rows may be learned from."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    usable = docs.where(F.lit(True) if keep is None else keep).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the hash that the sample ends at, from hashes alone; texts leave their tasks only below it
    last = usable.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    place = F.struct(order.alias("o"), F.col("doc_id").cast("string").alias("d"), F.xxhash64("text").alias("t"), F.col("lang").alias("l"))
    picked = usable.where(order <= F.lit(last)).select(place.alias("place"), "text", F.col("lang").alias("label"))
    sample = store.table(picked, "sample")
    model = fitted(sample, rows, fit_texts)
    store.drop(sample)
    return model


def predict(docs: DataFrame, model: SubwordModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets times languages
    kind = "struct<lang_pred:string,score:double>"

    @F.arrow_udf(kind)
    def guess(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.classes, "und"], object)
        for part in parts:
            data, offsets = utf8(part)
            if m.classes:
                p = m.probabilities(data, offsets)
                best, top = p.argmax(axis=1), p.max(axis=1)
            else:
                best, top = np.zeros(len(part), np.intp), np.zeros(len(part))
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(top, pa.float64())], ["lang_pred", "score"])

    with_guess = docs.withColumn("_guess", guess(F.col(text)))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.classes))
    return (
        with_guess.withColumn("lang_pred", F.when(lettered, F.col("_guess.lang_pred")).otherwise("und"))
        .withColumn("score", F.when(lettered, F.col("_guess.score")).otherwise(F.lit(0.0)))
        .withColumn("rejected", ~lettered | (F.col("score") < F.lit(float(model.threshold))))
        .drop("_guess")
    )
