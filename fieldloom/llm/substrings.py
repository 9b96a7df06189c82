"""Substring dedup over words: every window of ``window`` words that starts earlier anywhere else goes, found through difference-cover anchors.

Positions whose remainder modulo a period lies in a difference cover are anchors: for any two positions there is a shift under one period that takes both
to anchors. Two equal windows therefore share, at equal depth, an anchor whose next ``window - period + 1`` words lie inside both. Only anchors are
hashed and compared over all documents; each one that repeats is extended to the windows that contain it, and these are compared as a whole.

1. Tasks hash the words after each anchor and send each value once a batch, with the part its document belongs to, in one array a bucket.
2. Values that repeat go back to those parts. A part (the documents of one hash value of id and text) hashes the windows around its repeated anchors and
   sends each distinct one once, with its first place; the others are known to be repeats there and then.
3. Of equal windows the first place in the order of (doc_id, hash of the text, start) stays, all others go back to their parts, which cut the words they cover.

Texts are dealt to their parts once, and both uses read that exchange. A window that is frequent everywhere is one entry a batch or part.

Words are compared by 64-bit polynomial hashes of their bytes (words of more than ``LONG_WORD`` bytes, among which such hashes have known collisions, by
BLAKE2), windows by 64-bit hashes of these. Defined cases: null and empty texts have no words; a null id counts as the smallest; rows that repeat an id and
text are one document and give equal rows; rows of one id with different texts, null ids included, are documents of their own in the order of their texts'
hashes; windows longer than a document do not exist; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.blocks import Rolling, as_numbers, batched, bucket_floor
from fieldloom.llm.common import parts_for

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

NULL_ID = -(1 << 63)
STRETCH = 2 << 20
LONG_WORD = 256


def period_for(window: int, least: int = 8) -> int:
    """The longest period that leaves at least ``least`` words after an anchor."""
    return max([v for v in COVERS if window - v + 1 >= least], default=1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    solid = np.ones(len(data) + 2, bool)
    solid[[0, -1]] = False
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


class Words:
    """Words of a text and their hashes, found in stretches of bounded length."""

    def __init__(self, stretch: int = STRETCH):
        self.rolling, self.stretch = Rolling(), stretch

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text or b"", np.uint8)
        starts, ends = word_bounds(data)
        hashes = np.zeros(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + self.stretch, "right")))
            base = starts[first]
            prefix = self.rolling.prefix(data[base : ends[last - 1]].astype(np.uint64) + np.uint64(1))
            at = starts[first:last] - base
            hashes[first:last] = self.rolling.runs(prefix, at, ends[first:last] - starts[first:last])
            first = last
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return hashes, starts, ends


def window_hashes(rolling: Rolling, hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return rolling.runs(rolling.prefix(hashes), starts, width)


def anchors(n: int, window: int, period: int) -> np.ndarray:
    """Positions of the cover from which the rest of a window fits into a text of ``n`` words."""
    if n < window:
        return np.zeros(0, np.int64)
    at = np.arange(n - (window - period))
    return at[np.isin(at % period, COVERS[period])]


def dealt(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """(id, doc, tie, text, part): the text as bytes, its hash, and the part that id and text belong to; rows of one id are spread."""
    doc = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), doc.alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc", "tie"), F.lit(parts)).cast("int"))


KEYS = "bucket int, part int, keys binary, owners binary, twice binary"
_KEYS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("twice", pa.binary())])


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table; the table is searched, never sorted again."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def by_owner(keys: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its keys) for each owner."""
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(keys)]
    yield from ((int(owners[a]), keys[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def send_keys(keys: np.ndarray, parts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One batch's keys: each once to its bucket with the part of its owner; a key that the batch holds several times is marked, and goes straight to the
    parts of all its owners (bucket -1 - part)."""
    order = np.argsort(keys, kind="stable")
    keys, parts = keys[order], parts[order].astype(np.int32)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lone = new & np.append(new[1:], True)
    marked = keys[new & ~lone]
    rows: list[tuple] = []
    floor = bucket_floor(buckets)
    own, own_parts = keys[lone], parts[lone]
    edges, marked_edges = np.append(np.searchsorted(own, floor), len(own)), np.append(np.searchsorted(marked, floor), len(marked))
    for b in range(buckets):
        mine, twice = slice(edges[b], edges[b + 1]), marked[marked_edges[b] : marked_edges[b + 1]]
        if mine.stop > mine.start or len(twice):
            rows.append((b, -1, own[mine].tobytes(), own_parts[mine].tobytes(), twice.tobytes()))
    rows.extend((-1 - part, part, np.unique(k).tobytes(), b"", b"") for part, k in by_owner(keys[~lone], parts[~lone]))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KEYS)], schema=_KEYS)


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, dict]]:
    """Consecutive rows with one value of ``column``, as lists by name; rows arrive sorted by it."""
    held: dict | None = None
    at = None
    for batch in batches:
        values = batch.to_pydict()
        for k, v in enumerate(values[column]):
            if held is None or v != at:
                if held is not None:
                    yield at, held
                at, held = v, {name: [] for name in values}
            for name, column_values in values.items():
                held[name].append(column_values[k])
    if held is not None:
        yield at, held


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, keys) of all keys that occur more than once."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary())])
    for bucket, rows in runs_of(batches, "bucket"):
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["keys"], pa.binary())], schema=schema)
            continue
        keys, marked = (np.concatenate([as_numbers(k) for k in rows[c]]) for c in ("keys", "twice"))
        owners = np.concatenate([np.frombuffer(o, np.int32) for o in rows["owners"]])
        every, counts = np.unique(np.concatenate([keys, marked, marked]), return_counts=True)
        again = among(keys, every[counts > 1])
        back = [(p, k.tobytes()) for p, k in by_owner(keys[again], owners[again])]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in back], pa.int32()), pa.array([k for _, k in back], pa.binary())], schema=schema)


def settled(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together and in a row; buckets are dealt evenly."""
    return rows.repartition(parts_for(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def rows_of(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(doc, tie, text) of the rows of a part."""
    return zip(*(table.column(c).to_pylist() for c in ("doc", "tie", "text")), strict=True)


def names_of(table: pa.Table) -> dict[tuple[int, int, bytes], int]:
    """The number of each different row of a part in the order of id, hash and text: the same whenever the part is read."""
    return {row: i for i, row in enumerate(sorted(set(rows_of(table))))}


#: ``docs`` and ``ties`` order the documents everywhere, ``names`` tell them apart in their part.
WINDOWS = "bucket int, part int, keys binary, docs binary, ties binary, names binary, starts binary"
_WINDOWS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in ("keys", "docs", "ties", "names", "starts")]])


def send_windows(part: int, keys: np.ndarray, docs: np.ndarray, ties: np.ndarray, names: np.ndarray, starts: np.ndarray, buckets: int) -> pa.Table:
    """A part's windows: the first of equal ones to its bucket, the others straight back."""
    order = np.lexsort((starts, names, keys))
    keys, docs, ties, names, starts = (x[order] for x in (keys, docs, ties, names, starts))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    rows: list[tuple] = []
    if not first.all():
        rows.append((-1 - part, part, b"", b"", b"", names[~first].tobytes(), starts[~first].tobytes()))
    keys, docs, ties, names, starts = (x[first] for x in (keys, docs, ties, names, starts))
    edges = np.append(np.searchsorted(keys, bucket_floor(buckets)), len(keys))
    for b in range(buckets):
        if edges[b + 1] > edges[b]:
            mine = slice(edges[b], edges[b + 1])
            rows.append((b, part, *(x[mine].tobytes() for x in (keys, docs, ties, names, starts))))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_WINDOWS)], schema=_WINDOWS)


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, names, starts) of all windows but the first of each kind."""
    schema = pa.schema([("part", pa.int32()), ("names", pa.binary()), ("starts", pa.binary())])
    for bucket, rows in runs_of(batches, "bucket"):
        back = list(zip(rows["part"], rows["names"], rows["starts"], strict=True))
        if bucket >= 0:
            keys = np.concatenate([as_numbers(k) for k in rows["keys"]])
            docs, ties = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("docs", "ties"))
            names, starts = (np.concatenate([np.frombuffer(x, np.int32) for x in rows[c]]) for c in ("names", "starts"))
            edges = np.cumsum([0, *(len(k) // 8 for k in rows["keys"])]).tolist()
            order = np.lexsort((starts, names, ties, docs, keys))
            later = np.zeros(len(keys), bool)
            later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
            back = []
            for part, x, y in zip(rows["part"], edges, edges[1:], strict=False):
                if (mine := later[x:y]).any():
                    back.append((part, names[x:y][mine].tobytes(), starts[x:y][mine].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in back], f.type) for i, f in enumerate(schema)], schema=schema)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``width`` from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def drop_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, and ``kept``, its remaining words joined by single spaces. ``stretch`` bytes are hashed at once."""
    buckets = parts_for(docs.sparkSession)
    period, parts = period_for(window), 4 * buckets  # texts in smaller groups than keys: every bucket answers every part with one row
    depth = window - period + 1
    rows = dealt(docs, doc_id, text, parts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling = Words(stretch), Rolling()
        pairs = (r for b in batches for r in zip(b.column("part").to_pylist(), (t.as_py() for t in b.column("text")), strict=True))
        for group in batched(pairs, lambda r: len(r[1])):
            keys, owners = [], []
            for part, t in group:
                hashes = words(t)[0]
                at = anchors(len(hashes), window, period)
                if len(at):
                    keys.append(window_hashes(rolling, hashes, at, depth))
                    owners.append(np.full(len(at), part, np.int32))
            if keys:
                yield send_keys(np.concatenate(keys), np.concatenate(owners), buckets)

    def extend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        again = np.unique(np.concatenate([as_numbers(k) for k in right.column("keys").to_pylist()] or [np.zeros(0, np.uint64)]))
        words, rolling = Words(stretch), Rolling()
        found: list[list] = [[], [], [], [], []]
        for (doc, tie, t), name in names_of(left).items() if len(again) else ():
            hashes = words(t)[0]
            at = anchors(len(hashes), window, period)
            at = at[among(window_hashes(rolling, hashes, at, depth), again)] if len(at) else at
            if len(at):
                near = np.zeros(len(hashes) + 1, np.int64)  # window starts from which the anchor is less than a period away
                np.add.at(near, np.maximum(at - period + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[: len(hashes) - window + 1] > 0)
                found[0].append(window_hashes(rolling, hashes, starts, window))
                for held, value in ((found[1], np.int64(doc)), (found[2], np.int64(tie)), (found[3], np.int32(name))):
                    held.append(np.full(len(starts), value))
                found[4].append(starts.astype(np.int32))
        if not found[0]:
            return _WINDOWS.empty_table()
        return send_windows(key[0].as_py(), *(np.concatenate(f) for f in found), buckets)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        marked, starts = (np.concatenate([np.frombuffer(v, np.int32) for v in right.column(c).to_pylist()] or [np.zeros(0, np.int32)]) for c in ("names", "starts"))
        order = np.argsort(marked, kind="stable")
        marked, starts = marked[order], starts[order].astype(np.int64)
        names = names_of(left)
        out: list[list] = [[], [], [], []]
        for i, row in zip(left.column("id").to_pylist(), rows_of(left), strict=True):
            t = row[2]
            begin, end = word_bounds(np.frombuffer(t, np.uint8))
            mine = starts[slice(*np.searchsorted(marked, [names[row], names[row] + 1]))]
            gone = covered(len(begin), mine, window)
            keep = np.flatnonzero(~gone)
            kept = b" ".join(t[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True))
            for column, value in zip(out, (i, len(begin), int(gone.sum()), kept.decode("utf-8")), strict=True):
                column.append(value)
        kinds = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(out, kinds, strict=True)], names=[n for n, _ in kinds])

    marks = settled(rows.select("part", "text").mapInArrow(find, KEYS), buckets).mapInArrow(repeated_keys, "part int, keys binary")
    texts = rows.groupBy("part")
    windows = texts.cogroup(marks.groupBy("part")).applyInArrow(extend, WINDOWS)
    later = settled(windows, buckets).mapInArrow(later_windows, "part int, names binary, starts binary")
    result = texts.cogroup(later.groupBy("part")).applyInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept string")
    return result.withColumnRenamed("id", doc_id)
