"""Quality classifier: supervised subword embeddings (hashed words and character n-grams, averaged, softmax), trained by stochastic gradient descent.

Fitted on at most ``fit_rows`` labelled documents of each class, chosen by a hash of the id. A tenth of them sets the temperature; the class shares of all
labelled rows are put back by a shift of the bias, as the sample holds the classes evenly. Every text is scored whole; the score is the probability of
label 1. Case is kept: shouting and mixed-in symbols are signs of poor text.

Defined cases: a null or empty text has a zero vector and so gets the score of the bias; rows without label teach nothing; without both labels every score
is the label's share (0.5 without any); several labels of one document count as their largest; with fewer than 100 rows in
the sample none is held back and scores have no temperature; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import subword
from fieldloom.llm.language import first_of_label, sample_by_label

SHAPE = subword.Shape(buckets=1 << 15, dim=16, grams=(3, 4), lower=False)


def marks_of(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, label) of the rows to learn from."""
    return labels.where(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def texts_of(docs: DataFrame) -> DataFrame:
    """(id, text, lang) with whole texts, null ones empty."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int) -> tuple[list, dict]:
    """A bounded sample (label, text, id, lang) and the number of labelled rows of each label. Labels are thinned before the texts are joined to them."""
    marks = marks_of(labels, label, learn)
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    rows = sample_by_label(marks.select("label", F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("text")), per_label)
    if not rows:
        return [], counts
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in rows], "id long, label int")  # bounded by per_label
    found = texts_of(docs).join(F.broadcast(wanted), "id").select("label", F.xxhash64("id", "text").alias("at"), "id", "text", "lang")
    found = first_of_label(found, per_label).collect()  # an id may have many texts
    return sorted(found, key=lambda r: (r["label"], str(r["id"]), r["text"])), counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, fit_rows: int = 1_500) -> subword.Model | float:
    """The model; a plain share where one label or none is there. Brings at most ``2 * fit_rows`` texts to the driver."""
    rows, counts = sampled(docs, labels, label, F.lit(True) if learn is None else learn, fit_rows)
    total = sum(counts.values())
    if len({r["label"] for r in rows}) < 2:
        return float(counts.get(1, 0)) / total if total else 0.5
    order = np.random.default_rng(3).permutation(len(rows))
    texts, targets = np.array([rows[i]["text"] for i in order], dtype=object), np.array([rows[i]["label"] for i in order])
    held = np.arange(len(rows)) % 10 == 0 if len(rows) >= 100 else np.zeros(len(rows), bool)
    model = subword.train(list(texts[~held]), targets[~held], [0, 1], SHAPE, epochs=8)
    if held.any():
        subword.calibrate(model, subword.Scorer(model).vectors(list(texts[held])), targets[held], np.geomspace(0.5, 4, 31))
    seen = np.array([(targets == k).mean() for k in (0, 1)])
    true = np.array([counts.get(k, 0) / total for k in (0, 1)])
    model.bias = model.bias + model.slope * np.log(np.maximum(true, 1e-6) / seen)
    return model


def _score(model: subword.Model, p: np.ndarray, texts: list) -> dict:
    return {"score": p[:, 1]}


def score(docs: DataFrame, model: subword.Model | float, text: str = "text") -> DataFrame:
    """``docs`` (its ``text`` column left out) with the score of label 1."""
    columns = [c for c in docs.columns if c not in (text, "score")]
    named = docs.select(*columns, F.col(text).alias("text"))
    if isinstance(model, float):
        return named.select(*columns, F.lit(model).alias("score"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named.drop("text").schema.fields), "score double"])
    return named.mapInArrow(subword.scoring(model, columns, _score, {"score": pa.float64()}), schema)
