"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent, with calibrated rejection.

The model is fitted on a sample of the labelled rows, at most ``fit_rows`` of each language, taken by a hash of id and text, so reruns agree. Nine tenths are
trained on; the rest set the temperature of the scores and the rejection threshold: the score under which at most ``reject_share`` of the rightly
identified rows lie. Every text is scored whole.

Defined cases: a text that is null or holds no letter is ``und`` with score 0 and is rejected; rows without a language teach nothing; without any labelled
row all texts are ``und``; with fewer than 50 rows in the sample none is held back, so scores have no temperature and nothing that has a letter is rejected; repeated rows score alike; an empty table gives an empty result; extra columns are kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import subword
from fieldloom.llm.common import parts_for

UNKNOWN = "und"
SHAPE = subword.Shape(buckets=1 << 14, dim=16, grams=(1, 2, 3), lower=True)
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None, by: str = "doc_id", fit_rows: int = 600, reject_share: float = 0.001
) -> subword.Model | None:
    """The model, or None if no row can be learned from. Brings at most ``fit_rows`` rows of each language, times the number of languages, to the driver."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    rows = sample_by_label(rows.select(F.col(lang).alias("label"), F.col(text).alias("text"), F.col(by).alias("id")), fit_rows)
    rows = [r for r in rows if has_letter(r.text)]
    labels = sorted({r.label for r in rows})
    if not labels:
        return None
    targets = np.array([labels.index(r.label) for r in rows])
    held = np.arange(len(rows)) % 10 == 0
    if len(rows) < 50:
        held[:] = False
    texts = np.array([r.text for r in rows], dtype=object)
    model = subword.train(list(texts[~held]), targets[~held], labels, SHAPE, epochs=5)
    if held.any():
        # Short texts must be judged as well, so the held-out texts are also cut to their first hundred characters.
        check, truth = [*texts[held], *(t[:100] for t in texts[held])], np.concatenate([targets[held], targets[held]])
        vectors = subword.Scorer(model).vectors(check)
        subword.calibrate(model, vectors, truth)
        p = model.softmax(vectors)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        model.reject_below = float(right[int(len(right) * reject_share)]) * 0.9 if len(right) else 0.0
    return model


def sample_by_label(rows: DataFrame, per_label: int) -> list:
    """Up to ``per_label`` rows of each label (columns label, text, id) by a hash of id and text; no more than these reach the driver."""
    ranked = rows.select("label", F.xxhash64(F.col("id").cast("string"), "text").alias("at"), "id", "text")
    counts = rows.groupBy("label").count().collect()  # one row a label
    wanted = None
    for r in counts:
        # A hash threshold lets a little more than the wanted rows pass, evenly over all partitions; nothing is ordered as a whole.
        share = min(1.0, 1.3 * (per_label + 20) / r["count"])
        here = (F.col("label") == F.lit(r["label"])) & (F.pmod(F.col("at"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        wanted = here if wanted is None else wanted | here
    if wanted is None:
        return []
    return sorted(first_of_label(ranked.where(wanted), per_label).collect(), key=_place)


def _place(row) -> tuple:
    return row["at"], str(row["id"]), row["text"] or ""


def first_of_label(rows: DataFrame, per_label: int) -> DataFrame:
    """The ``per_label`` first rows of each label (columns label, at, id, text and others) in the order of at, id and text. Rows that repeat id and text
    pass a threshold together, so each partition is cut to its first rows, and then what is left of a label is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                mine = held.setdefault(row["label"], [])
                mine.append(row)
                if len(mine) >= 2 * per_label:
                    held[row["label"]] = sorted(mine, key=_place)[:per_label]
        for mine in held.values():
            yield pa.RecordBatch.from_pylist(sorted(mine, key=_place)[:per_label], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).repartition(parts_for(rows.sparkSession), "label").mapInArrow(run, rows.schema)


def _identify(model: subword.Model | None, p: np.ndarray, texts: list) -> dict:
    lettered = [has_letter(t) for t in texts]
    best, top = p.argmax(axis=1), p.max(axis=1)
    return {
        "lang_pred": [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)],
        "score": [float(s) if ok else 0.0 for s, ok in zip(top, lettered, strict=True)],
        "rejected": [not ok or s < model.reject_below for s, ok in zip(top, lettered, strict=True)],
    }


KINDS = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}


def identify(docs: DataFrame, model: subword.Model | None, text: str = "text") -> DataFrame:
    """``docs`` (its ``text`` column left out) with lang_pred, score and rejected. Batches are small, so long texts never meet in great numbers."""
    columns = [c for c in docs.columns if c not in (text, *KINDS)]
    named = docs.select(*columns, F.col(text).alias("text"))
    if model is None:
        return named.drop("text").select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.drop("text").schema.fields)
    schema += (", " if schema else "") + "lang_pred string, score double, rejected boolean"
    return named.mapInArrow(subword.scoring(model, columns, _identify, KINDS), schema)


def keep_identified(docs: DataFrame, model: subword.Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is identified with enough confidence."""
    if model is None:
        return docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = subword.Scorer(model)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            made = _identify(model, model.softmax(scorer.vectors(texts)), texts)
            yield batch.filter(pa.array([not r for r in made["rejected"]]))

    return docs.mapInArrow(run, docs.schema)
