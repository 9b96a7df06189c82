"""Toxicity: a convolutional text classifier in numpy with hashed word embeddings, several filter widths and max pooling; thresholds by language.

A text is a row of word ids. Words are hashed (crc32 of the lower-cased word); every hash that occurs in at least three training texts has a vector, all
others share a vector of zeros, so that words never seen cannot speak for either class through a chance collision. Filters of widths 1, 2 and 3 slide over the word vectors, each keeps its
highest answer, and a logistic layer reads these. Training backpropagates through the winning windows only, with Adagrad steps.

The network's weights and its vocabulary are learned from a sample of at most ``fit_rows`` labelled documents of each class, chosen by a hash of the id,
less a fifth. Temperature and thresholds come from every labelled row that the weights did not see, the classes weighed by their share in all labelled rows.
A language's threshold is the lowest score at which its precision is at least ``precision`` (0.7 where a language has too few rows). The language picks a
threshold only and is no input of the score. Texts are scored whole, in overlapping stretches of bounded length.

Defined cases: a null or empty text pools to zero and gets the score of the bias; without both labels every score is the label's share (0.5 without any);
with fewer than 100 rows in the sample none is held back: scores have no temperature and every language has the threshold 0.7; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import written
from fieldloom.llm.quality import marks_of, sampled, texts_of

WIDTHS = (1, 2, 3)
_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Network:
    hashes: np.ndarray  # sorted; the vector of hashes[i] is table[i + 1]
    table: np.ndarray  # row 0, zeros, stands for unknown words and for padding
    filters: list[np.ndarray]  # for each width: (width * dim) x n
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.7


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class WordIds:
    """Rows of the table for the words of a text, kept for up to ``room`` words."""

    def __init__(self, hashes: np.ndarray, room: int = 200_000):
        self.hashes, self.room, self.known = hashes, room, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        if len(self.known) > self.room:
            self.known.clear()
        get = self.known.get
        return np.fromiter((i if (i := get(w)) is not None else self._new(w) for w in found), np.int32, len(found))

    def _new(self, word: str) -> int:
        h = word_hash(word)
        i = int(np.searchsorted(self.hashes, h))
        i = self.known[word] = i + 1 if i < len(self.hashes) and self.hashes[i] == h else 0
        return i


def vocabulary(texts: list[str], least: int = 3) -> np.ndarray:
    """Hashes of the words in at least ``least`` of the texts; of all words if there are fewer texts than 50."""
    seen: Counter = Counter()
    for text in texts:
        seen.update({word_hash(w) for w in tokens(text)})
    few = len(texts) < 50
    return np.array(sorted(h for h, k in seen.items() if few or k >= least), np.int64)


def _padded(ids: np.ndarray) -> np.ndarray:
    return ids if len(ids) >= max(WIDTHS) else np.concatenate([ids, np.zeros(max(WIDTHS) - len(ids), ids.dtype)])


def pooled(net: Network, ids: np.ndarray, stretch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Highest answer of every filter over the whole text and the window that gave it."""
    ids = _padded(ids)
    best = np.full(sum(f.shape[1] for f in net.filters), -np.inf, np.float32)
    where = np.zeros(len(best), np.int64)
    for start in range(0, max(1, len(ids) - 2), stretch):
        part = ids[start : start + stretch + max(WIDTHS) - 1]
        vectors, at = net.table[part], 0
        for width, f, shift in zip(WIDTHS, net.filters, net.shifts, strict=True):
            if len(part) >= width:
                dim = vectors.shape[1]
                answer = vectors[: len(part) - width + 1] @ f[:dim]
                for j in range(1, width):
                    answer += vectors[j : len(part) - width + 1 + j] @ f[j * dim : (j + 1) * dim]
                answer += shift
                top = answer.argmax(axis=0)
                high = answer[top, np.arange(f.shape[1])]
                mine = slice(at, at + f.shape[1])
                better = high > best[mine]
                best[mine] = np.where(better, high, best[mine])
                where[mine] = np.where(better, top + start, where[mine])
            at += f.shape[1]
    return np.maximum(best, 0), where


def answer(net: Network, ids: np.ndarray) -> float:
    """What the text adds to the bias; nothing if it has no words."""
    return float(pooled(net, ids)[0] @ net.out) if len(ids) else 0.0


def logit(net: Network, ids: np.ndarray) -> float:
    return answer(net, ids) + net.bias


def probability(net: Network, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z / net.slope, -30, 30)))


def train(texts: list[np.ndarray], targets: np.ndarray, hashes: np.ndarray, dim: int = 16, n: int = 12, epochs: int = 8, seed: int = 5) -> Network:
    """Adagrad, one document a step; gradients flow through the windows that won the pooling."""
    rate = 0.05
    random = np.random.default_rng(seed)
    net = Network(
        hashes,
        random.normal(0, 0.1, (len(hashes) + 1, dim)).astype(np.float32),
        [random.normal(0, 0.3 / np.sqrt(w), (w * dim, n)).astype(np.float32) for w in WIDTHS],
        [np.zeros(n, np.float32) for _ in WIDTHS],
        random.normal(0, 0.1, n * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    net.table[0] = 0
    seen = [np.full(a.shape, 1e-3, np.float32) for a in (net.table, *net.filters, *net.shifts, net.out)]
    seen_bias = 1e-3
    for _ in range(epochs):
        for k in random.permutation(len(texts)):
            ids = _padded(texts[k])
            top, where = pooled(net, ids)
            error = 1 / (1 + np.exp(-np.clip(top @ net.out + net.bias, -30, 30))) - targets[k]
            back = error * net.out * (top > 0)
            step = error * top
            seen[-1] += step**2
            net.out -= rate * step / np.sqrt(seen[-1])
            seen_bias += error**2
            net.bias -= rate * error / np.sqrt(seen_bias)
            at = 0
            for w, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                mine = back[at : at + n]
                words = ids[where[at : at + n][:, None] + np.arange(width)]  # n x width
                vectors = net.table[words].reshape(n, width * dim)
                grad = (vectors * mine[:, None]).T
                down = (f * mine).T.reshape(n * width, dim)
                seen[1 + w] += grad**2
                f -= rate * grad / np.sqrt(seen[1 + w])
                seen[1 + len(WIDTHS) + w] += mine**2
                net.shifts[w] -= rate * mine / np.sqrt(seen[1 + len(WIDTHS) + w])
                flat = words.ravel()
                used, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(used), dim), np.float32)
                np.add.at(total, inverse, down)
                seen[0][used] += total**2
                net.table[used] -= rate * total / np.sqrt(seen[0][used])
                net.table[0] = 0
                at += n
    return net


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, fit_rows: int = 2_000, precision: float = 0.95
) -> Network | float:
    """The network; a plain share where one label or none is there. Brings at most ``2 * fit_rows`` texts to the driver. ``learn`` is a condition on doc_id."""
    rows, counts = sampled(docs, labels, label, F.lit(True) if learn is None else learn, fit_rows)
    total = sum(counts.values())
    if len({r["label"] for r in rows}) < 2:
        return float(counts.get(1, 0)) / total if total else 0.5
    order = np.random.default_rng(3).permutation(len(rows))
    targets = np.array([rows[i]["label"] for i in order])
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 100 else np.zeros(len(rows), bool)
    hashes = vocabulary([rows[i]["text"] for i, h in zip(order, held, strict=True) if not h])
    to_ids = WordIds(hashes)
    texts = [to_ids(rows[i]["text"]) for i in order]
    net = train([t for t, h in zip(texts, held, strict=True) if not h], targets[~held], hashes)
    # The sample holds the classes more evenly than the labels do; the odds of all labelled rows are put back.
    seen, true = targets.mean(), counts.get(1, 0) / total
    shift = float(np.log(true / (1 - true)) - np.log(seen / (1 - seen)))
    if not held.any():
        net.bias += shift
        return net
    trained = [(rows[i]["id"], rows[i]["at"]) for i, h in zip(order, held, strict=True) if not h]
    learn = F.lit(True) if learn is None else learn
    answers = written(answered(docs.where(learn), marks_of(labels, label, learn), net, trained), "toxicity")
    left = {r["label"]: r["count"] for r in answers.groupBy("label").count().collect()}
    weights = {k: counts[k] / n for k, n in left.items()}
    if len(left) == 2:
        net.slope = temperature(answers, weights, net.bias, shift)
    net.bias += net.slope * shift
    return calibrate_thresholds(net, answers, weights, precision)


def answered(docs: DataFrame, marks: DataFrame, net: Network, trained: list[tuple]) -> DataFrame:
    """(label, lang, answer) of every labelled row of ``docs`` but those trained on, which are given by id and hash of id and text.

    Texts are read where they lie: answers, and not texts, move to their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = WordIds(net.hashes)
        for batch in batches:
            found = pa.array([answer(net, to_ids(t)) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "at", "lang")), found], ["id", "at", "lang", "answer"])

    learned = docs.sparkSession.createDataFrame(trained, "id long, at long")  # bounded by the sample
    texts = texts_of(docs).withColumn("at", F.xxhash64("id", "text")).where(F.col("id").isNotNull())
    answers = texts.mapInArrow(run, "id long, at long, lang string, answer double")
    rows = answers.join(marks.select(F.col("doc_id").cast("long").alias("id"), "label"), "id")
    return rows.join(F.broadcast(learned), ["id", "at"], "left_anti").select("label", "lang", "answer")


def _weight(weights: dict) -> Column:
    return F.when(F.col("label") == 1, F.lit(float(weights.get(1, 0)))).otherwise(F.lit(float(weights.get(0, 0))))


def temperature(answers: DataFrame, weights: dict, bias: float, shift: float) -> float:
    """The slope of least log loss over all ``answers``."""
    slopes = np.geomspace(0.5, 4, 31).tolist()
    sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    margins = [sign * ((F.col("answer") + bias) / s + shift) for s in slopes]
    losses = [F.sum(_weight(weights) * (F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))))).alias(f"s{i}") for i, m in enumerate(margins)]
    return float(slopes[int(np.argmin(list(answers.agg(*losses).first())))])


def calibrate_thresholds(net: Network, answers: DataFrame, weights: dict, precision: float, least: int = 20, step: float = 1 / 64) -> Network:
    """Set a threshold for each language from rows that were not trained on: all of them, counted by answer and summed from the highest down.

    Answers are summed within bins of ``step``, and these over the bins of a language, 128,000 at most: its rows do not meet in one task."""
    level = F.floor(F.least(F.greatest(F.col("answer") / net.slope, F.lit(-1e3)), F.lit(1e3)) / step)
    points = answers.groupBy("lang", level.alias("level"), "answer").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = points.groupBy("lang", "level").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    levels = levels.select(
        F.col("lang").alias("_lang"),
        F.col("level").alias("_level"),
        F.coalesce(F.sum("toxic").over(above), F.lit(0)).alias("_toxic"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"),
    )
    inside = Window.partitionBy("lang", "level").orderBy(F.desc("answer")).rowsBetween(Window.unboundedPreceding, 0)
    summed = points.join(levels, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("level") == F.col("_level")))
    right, all_ = F.col("_toxic") + F.sum("toxic").over(inside), F.col("_n") + F.sum("n").over(inside)
    hits, misses = right * float(weights.get(1, 0)), (all_ - right) * float(weights.get(0, 0))
    reached = summed.withColumn("good", (right > 0) & (hits >= precision * (hits + misses)))
    found = reached.groupBy("lang").agg(F.min(F.when(F.col("good"), F.col("answer"))).alias("answer"), F.sum("n").alias("n"))
    for r in found.collect():  # one row a language
        if r["n"] >= least and r["answer"] is not None:
            net.thresholds[r["lang"]] = float(probability(net, np.array([r["answer"] + net.bias]))[0])
    return net


def scoring(net: Network, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = WordIds(net.hashes)
        for batch in batches:
            z = np.array([logit(net, to_ids(t)) for t in batch.column("text").to_pylist()], dtype=np.float64)
            p = probability(net, z)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p, pa.float64())], [*columns, "score"])

    return run


def score(docs: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """``docs`` (its ``text`` column left out) with the probability of toxicity."""
    columns = [c for c in docs.columns if c not in (text, "score")]
    named = docs.select(*columns, F.col(text).alias("text"))
    if isinstance(net, float):
        return named.select(*columns, F.lit(net).alias("score"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named.drop("text").schema.fields), "score double"])
    return named.mapInArrow(scoring(net, columns), schema)


def flagged(scored: DataFrame, net: Network | float, lang: str = "lang") -> DataFrame:
    """Adds ``toxic``: the score reaches the threshold of the row's language, or the common one."""
    limit = F.lit(0.7 if isinstance(net, float) else net.threshold)
    for name, value in ({} if isinstance(net, float) else net.thresholds).items():
        limit = F.when(F.col(lang).eqNullSafe(F.lit(name)), F.lit(value)).otherwise(limit)
    return scored.withColumn("toxic", F.col("score") >= limit)
