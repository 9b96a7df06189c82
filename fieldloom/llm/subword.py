"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A document is the mean of the vectors of its features: each word, and each character n-gram of ``<word>``, hashed into one table of vectors. The sum of a
word's vectors is kept in a bounded store, so a text costs one lookup a word. Training sees a sample of labelled rows, bounded by a parameter of the
callers; scoring runs on every whole text inside Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from fieldloom.llm.common import mix64

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Shape:
    """What a feature is: character n-grams of these lengths, hashed into ``buckets`` vectors of ``dim`` numbers; lower-casing is optional."""

    buckets: int = 1 << 15
    dim: int = 16
    grams: tuple[int, ...] = (1, 2, 3)
    lower: bool = True


class Features:
    """Feature ids of words, found for many words at once."""

    def __init__(self, shape: Shape):
        self.shape = shape

    def of(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, feature ids), once for the whole words and once for each length of n-grams; word numbers ascend."""
        marked = [f"<{w}>" for w in words]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(code)) - np.repeat(ends - lengths, lengths)
        left = np.repeat(ends, lengths) - np.arange(len(code))
        whole = mix64(np.add.reduceat(mix64(code + (place.astype(np.uint64) << np.uint64(21))), ends - lengths)) if len(words) else code
        buckets = np.uint64(self.shape.buckets)
        yield np.arange(len(words)), (whole % buckets).astype(np.int64)
        for n in self.shape.grams:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = mix64(h ^ code[at + j])
            yield owner[at], (h % buckets).astype(np.int64)

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _WORD.findall(text.lower() if self.shape.lower else text)


@dataclass
class Model:
    shape: Shape
    labels: list
    table: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x labels
    bias: np.ndarray
    slope: float = 1.0  # divides the logits: temperature of the calibration
    reject_below: float = 0.0
    extra: dict = field(default_factory=dict)

    def softmax(self, vectors: np.ndarray) -> np.ndarray:
        z = (vectors @ self.weights + self.bias) / self.slope
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Mean feature vectors of whole texts; a word's summed vector and feature count are kept for up to ``room`` words."""

    def __init__(self, model: Model, room: int = 200_000):
        self.model, self.features, self.room = model, Features(model.shape), room
        self.sums = np.zeros((room, model.shape.dim + 1), np.float32)
        self.at: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        first, dim = len(self.at), self.model.shape.dim
        self.at.update(zip(words, range(first, first + len(words)), strict=True))
        made = self.sums[first : first + len(words)]
        made[:] = 0
        for owner, ids in self.features.of(words):
            if len(ids):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                made[owner[starts], :dim] += np.add.reduceat(self.model.table[ids], starts, axis=0)
                made[owner[starts], dim] += np.diff(np.append(starts, len(ids)))

    def vectors(self, texts: list[str | None], piece: int = 50_000) -> np.ndarray:
        dim = self.model.shape.dim
        out = np.zeros((len(texts), dim), np.float64)
        for k, text in enumerate(texts):
            tokens, total = self.features.split(text), np.zeros(dim + 1)
            for start in range(0, len(tokens), piece):
                part, at = tokens[start : start + piece], self.at
                new = [w for w in set(part) if w not in at]
                if len(at) + len(new) > self.room:
                    at.clear()
                    new = list(set(part))
                if new:
                    self._learn(new)
                total += self.sums[[at[w] for w in part]].sum(axis=0, dtype=np.float64)
            if total[-1]:
                out[k] = total[:-1] / total[-1]
        return out


def train(texts: list[str], targets: np.ndarray, labels: list, shape: Shape, epochs: int = 6, rate: float = 0.5, most: int = 400, seed: int = 7) -> Model:
    """Fit by stochastic gradient descent, one document a step, the rate falling linearly to zero.

    Of each training text up to ``most`` features, drawn anew in every epoch, enter a step; scoring uses them all.
    """
    random = np.random.default_rng(seed)
    features = Features(shape)
    docs = []
    for text in texts:
        tokens = features.split(text)
        if len(tokens) > 2_000:
            tokens = [tokens[i] for i in random.integers(0, len(tokens), 2_000)]
        docs.append(np.concatenate([ids for _, ids in features.of(tokens)]) if tokens else np.zeros(0, np.int64))
    n = len(labels)
    table = random.uniform(-1, 1, (shape.buckets, shape.dim)) / shape.dim
    weights, bias = np.zeros((shape.dim, n)), np.zeros(n)
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in random.permutation(len(docs)):
            done += 1
            ids = docs[k]
            if not len(ids):
                continue
            if len(ids) > most:
                ids = ids[random.integers(0, len(ids), most)]
            step = rate * (1 - done / steps)
            v = table[ids].mean(axis=0)
            z = v @ weights + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[targets[k]] -= 1
            back = weights @ error
            weights -= step * np.outer(v, error)
            bias -= step * 0.1 * error
            np.add.at(table, ids, -step * back / len(ids))
    return Model(shape, list(labels), table.astype(np.float32), weights, bias)


def calibrate(model: Model, vectors: np.ndarray, targets: np.ndarray, slopes=np.geomspace(0.25, 8, 41)) -> Model:
    """Choose the temperature with the least log loss on rows that were not trained on."""
    losses = []
    for slope in slopes:
        model.slope = float(slope)
        p = model.softmax(vectors)[np.arange(len(targets)), targets]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.slope = float(slopes[int(np.argmin(losses))]) if len(targets) else 1.0
    return model


def scoring(model: Model, columns: list[str], result: Callable[[Model, np.ndarray, list], dict], kinds: dict[str, pa.DataType]):
    """A function for ``mapInArrow``: the named columns of each row and what ``result`` makes of (model, probabilities, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = result(model, model.softmax(scorer.vectors(texts)), texts)
            arrays = [batch.column(c) for c in columns] + [pa.array(made[k], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *kinds])

    return run
