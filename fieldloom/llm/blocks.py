"""Finding repeated keys over all documents with numpy inside Spark tasks.

A task hashes what it reads and sends, for each bucket of hash values, one packed array with every value once. Values that are frequent anywhere meet as
one entry a batch, so a passage that a third of all documents share weighs no more than any other. The number of buckets follows the shuffle partitions;
batches are bounded in bytes. Rows name their document by id, so nothing depends on how the input was split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from fieldloom.llm.common import mix64

#: Bytes of text that are hashed and sorted at once; a longer document is a batch of its own.
BATCH = 8 << 20


def inverse_odd(x: int) -> int:
    """The number that times ``x`` is 1 modulo 2**64."""
    inverse = x
    for _ in range(6):
        inverse = inverse * (2 - x * inverse) % (1 << 64)
    return inverse


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out[:n]


class Rolling:
    """Polynomial hashes modulo 2**64 of runs in a sequence of numbers, from prefix sums: run [i, j) hashes to (P[j] - P[i]) / base**i."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.BASE, n), powers(inverse_odd(self.BASE), n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Hashes of the runs of ``width`` values at ``starts``, their bits spread."""
        return mix64((prefix[starts + width] - prefix[starts]) * self.down[starts])


def as_numbers(blob) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def batched(rows: Iterator[tuple], weight, most: int = BATCH) -> Iterator[list]:
    """Lists of rows of a bounded total weight."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


def bucket_floor(buckets: int) -> np.ndarray:
    """The least key of each bucket."""
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=object).astype(np.uint64)

