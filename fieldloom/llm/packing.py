"""Token ids packed into rows of fixed length: best-fit-decreasing with a segment tree over the capacities left, overlong documents split without loss.

Each task encodes the documents of its input split one after another and packs them in groups of about ``group_tokens`` tokens, so a task holds a few
megabytes whatever its input, nothing is shuffled, and a lost task is repeated on the same split with the same rows. Only the last rows of a group can
be left partly empty.

A row has ``ids`` (a line of the matrix, ``length`` little-endian numbers), ``n_tokens``, ``cu_seqlens`` (0 and the running ends of its segments),
``position_resets`` (where positions start again at 0), and for each segment the document and the token of it at which the segment begins, from which
``unpack`` puts the documents together again.

Defined cases: null and empty texts give no tokens (and with an end-of-text id just that id, in a segment of their own); repeated rows are packed as often
as they come; a null id stays null; texts are ordinary text even where they spell a special token; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public word-splitting pattern of the byte-level vocabulary and its end-of-text id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

SCHEMA = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_starts array<bigint>"
_ARROW = pa.schema(
    [
        ("ids", pa.binary()),
        ("n_tokens", pa.int32()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int64())),
    ]
)

_CLOSE_SPACE = re.compile(r"(?:\A|\s) | (?:\s|\Z)")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Pieces(dict):
    """Encoded pieces of text between single spaces, kept up to ``room``."""

    def __init__(self, encode, prefix: str, dtype, room: int):
        super().__init__()
        self.encode, self.prefix, self.dtype, self.room = encode, prefix, dtype, room

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(self.prefix + piece), self.dtype).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts from a file of byte-pair ranks.

    The pattern never joins what stands before a single space with what follows it, so texts are encoded piece by piece and frequent pieces only once.
    """

    def __init__(self, path: str, room: int = 400_000):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 65535 else np.dtype("<u4")
        self.first = _Pieces(self.coder.encode_ordinary, "", self.dtype, room // 10)
        self.rest = _Pieces(self.coder.encode_ordinary, " ", self.dtype, room)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = _SINGLE_SPACE.split(text) if _CLOSE_SPACE.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


class Capacities:
    """A segment tree over capacities 0..length that says which are left in some bin; finds the smallest that is at least a given length."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.some = bytearray(2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def put(self, left: int, bin_: int) -> None:
        held = self.bins.setdefault(left, [])
        held.append(bin_)
        if len(held) == 1:
            i = left + self.size
            while i and not self.some[i]:
                self.some[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the best fit, removed from the tree; None if nothing is large enough."""
        i, some = need + self.size, self.some
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):  # up, until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        left = i - self.size
        held = self.bins[left]
        bin_ = held.pop()
        if not held:
            while i and not (i < self.size and (some[2 * i] or some[2 * i + 1])):
                some[i] = 0
                i >>= 1
        return left, bin_


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers, each of total ``length`` at most; longest items first, each into the fullest bin that still takes it."""
    free, bins = Capacities(length), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[item])
        if found is None:
            bins.append([item])
            left, bin_ = length, len(bins) - 1
        else:
            left, bin_ = found
            bins[bin_].append(item)
        if left > lengths[item]:
            free.put(left - lengths[item], bin_)
    return bins


def _rows(segments: list[tuple], length: int, dtype: np.dtype, pad: int) -> pa.RecordBatch:
    """Rows packed from (doc_id, start, bytes)."""
    wide = dtype.itemsize
    sizes = [len(s[2]) // wide for s in segments]
    blank = np.full(length, pad, dtype).tobytes()
    columns: list[list] = [[] for _ in _ARROW]
    for members in best_fit_decreasing(sizes, length):
        ends = np.cumsum([0, *(sizes[m] for m in members)]).tolist()
        columns[0].append(b"".join(segments[m][2] for m in members) + blank[ends[-1] * wide :])
        columns[1].append(ends[-1])
        columns[2].append(ends)
        columns[3].append(ends[:-1])
        columns[4].append([segments[m][0] for m in members])
        columns[5].append([segments[m][1] for m in members])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(
    docs: DataFrame, length: int = 2048, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int | None = END_OF_TEXT, group_tokens: int = 1 << 20
) -> DataFrame:
    """The packed rows of all documents, with a ``pack_id`` and the ``row_length`` of the matrix. ``tokenizer`` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        wide, pad = encode.dtype.itemsize, end or 0
        tail = b"" if end is None else np.array([end], encode.dtype).tobytes()
        group, held = [], 0
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(words.as_py()) + tail
                for start in range(0, len(ids), length * wide):
                    part = ids[start : start + length * wide]
                    group.append((doc, start // wide, part))
                    held += len(part) // wide
                    if held >= group_tokens:
                        yield _rows(group, length, encode.dtype, pad)
                        group, held = [], 0
        if group:
            yield _rows(group, length, encode.dtype, pad)

    packed = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)
    return packed.select(F.monotonically_increasing_id().alias("pack_id"), *[f.name for f in _ARROW], F.lit(length).alias("row_length"))


def position_ids(position_resets: list[int], n_tokens: int, length: int) -> np.ndarray:
    """Positions of one row: counted from each reset on, zero in the padding."""
    out = np.arange(length, dtype=np.int32)
    starts = np.zeros(length, np.int32)
    starts[position_resets] = position_resets
    out -= np.maximum.accumulate(starts)
    out[n_tokens:] = 0
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Store the matrix for a loader: ids and position ids as little-endian binary lines, and the cumulative segment lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("position_resets", "n_tokens", "row_length")), strict=True)
            places = pa.array([position_ids(*row).astype("<u4").tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pack_id", "ids", "cu_seqlens")), places], ["pack_id", "ids", "cu_seqlens", "position_ids"])

    packed.mapInArrow(run, "pack_id bigint, ids binary, cu_seqlens array<int>, position_ids binary").write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The segments again, as (doc_id, doc_start, ids binary): joined in the order of doc_start they are the documents."""
    wide = F.octet_length("ids") / F.col("row_length")
    parts = packed.select("ids", "cu_seqlens", "row_length", F.arrays_zip("doc_ids", "doc_starts", "position_resets").alias("parts"), F.size("doc_ids").alias("n"))
    rows = parts.select("ids", "cu_seqlens", wide.cast("int").alias("wide"), F.posexplode("parts").alias("k", "part"))
    start, stop = F.col("part.position_resets"), F.element_at("cu_seqlens", F.col("k") + 2)
    return rows.select(
        F.col("part.doc_ids").alias("doc_id"),
        F.col("part.doc_starts").alias("doc_start"),
        F.substring(F.col("ids"), start * F.col("wide") + 1, (stop - start) * F.col("wide")).alias("ids"),
    )
