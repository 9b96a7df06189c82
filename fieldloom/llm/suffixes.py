"""Removal of long byte strings that occur more than once: a hash-compared suffix sort around shared anchors.

Every byte covered by a ``width``-byte string that also starts anywhere else goes. Sorting all suffixes of a corpus would move it several times over, so
only suffixes that can matter are sorted:

1. Of the 32-byte grams inside each window of ``width`` bytes the one with the smallest hash is an anchor, so equal windows have equal anchors at equal
   depth. One gram in about 185 is one. Tasks send anchor hashes to buckets, each once a batch, with its count; those that repeat go back to the parts
   (documents of one hash value of id and text) that own them.
2. A part cuts the context of each repeated anchor: the windows it is chosen for, and no more. Equal contexts are sent once and known to be repeats.
3. A bucket sorts the contexts of an anchor twice, as suffixes from the anchor on and as reversed prefixes before it. Two suffixes are compared by the
   binary search for their common extension on prefix polynomial hashes, in the rounds of a mergesort; the extensions of neighbours are checked on the
   bytes. A window at depth d repeats if two contexts agree on d bytes before the anchor and ``width - d`` from it: both are cuts of the sorted orders.
4. Runs of repeated windows go back to their parts, which remove the bytes they cover.

An anchor with more than ``hot`` places is not gathered: the windows of its different contexts are hashed one by one (128 bits) and meet as keys, each
distinct one once a part. This gives the same result for groups of any size.

Defined cases: null and empty texts have no bytes; matches never cross documents; every row is a document of its own, whether its id is null, shared with
other texts or repeated with its text, so that equal rows are two starts of their strings as copies are; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.blocks import Rolling, as_numbers, batched, bucket_floor
from fieldloom.llm.common import mix64, parts_for
from fieldloom.llm.substrings import covered, dealt, names_of, rows_of, runs_of, settled

GRAM = 32
HOT = 2_000
STRETCH = 1 << 18
#: Bytes of contexts that are sorted at once; a group of up to ``HOT`` contexts stays together.
TOGETHER = 1 << 19


def window_minima(numbers: np.ndarray, width: int) -> np.ndarray:
    """Least number of every run of ``width`` numbers, from the minima towards both sides within blocks of that width."""
    n = len(numbers)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = numbers
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Positions chosen in one text, their gram hashes, and the range of window starts that each is chosen for."""

    def __init__(self, width: int, stretch: int = STRETCH):
        self.width, self.stretch, self.rolling = width, stretch, Rolling()

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, span = len(data), self.width - GRAM + 1
        starts = n - self.width + 1
        if starts <= 0:
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint64), none, none
        chosen, hashes = [], []
        for base in range(0, starts, self.stretch):
            piece = data[base : base + self.stretch + self.width - 1]
            prefix = self.rolling.prefix(piece.astype(np.uint64) + np.uint64(1))
            h = self.rolling.runs(prefix, np.arange(len(piece) - GRAM + 1), GRAM)
            # High bits of the hash, then the place from the right: of equal hashes the rightmost is the least number.
            place = np.uint64((1 << 20) - 1) - np.arange(len(h), dtype=np.uint64)
            least = window_minima((h & ~np.uint64((1 << 20) - 1)) | place, span)
            at = (np.uint64((1 << 20) - 1) - (least & np.uint64((1 << 20) - 1))).astype(np.int64)
            chosen.append(at + base)
            hashes.append(mix64(h[at]))  # minima lie at the low end of the numbers; mixed once more they fall evenly into the buckets
        at, h = np.concatenate(chosen), np.concatenate(hashes)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        return at[new], h[new], new, np.append(new[1:], len(at)) - 1


KEYS = "bucket int, keys binary, owners binary, counts binary"
_KEYS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def send_keys(keys: np.ndarray, parts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Each key of a batch once for each part that owns it, with the number of its anchors there: a row per bucket."""
    order = np.lexsort((parts, keys))  # buckets are ranges of keys
    keys, parts = keys[order], parts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys))).astype(np.int32)
    keys, parts = keys[first], parts[first].astype(np.int32)
    edges = np.append(np.searchsorted(keys, bucket_floor(buckets)), len(keys)).tolist()
    rows = [(k, keys[a:b].tobytes(), parts[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return _packed(rows, _KEYS)


_AGAIN = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])


def repeated(hot: int):
    """(part, keys, hot) of the keys with several anchors; ``hot`` says which have so many that their contexts are not gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, "bucket"):
            keys = np.concatenate([as_numbers(k) for k in rows["keys"]])
            owners, counts = (np.concatenate([np.frombuffer(x, np.int32) for x in rows[c]]) for c in ("owners", "counts"))
            _, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, counts)[inverse]
            again = total > 1
            order = np.lexsort((keys[again], owners[again]))
            keys, owners, many = keys[again][order], owners[again][order], (total[again] > hot)[order]
            new = np.ones(len(keys), bool)  # a key once a part, however many batches sent it
            new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners, many = keys[new], owners[new], many[new]
            cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(keys)]
            back = [(int(owners[a]), keys[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield _packed(back, _AGAIN)

    return run


CONTEXTS = "bucket int, part int, kind int, keys binary, docs binary, places binary, depths binary, sizes binary, bytes binary, again binary"
_CONTEXTS = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32())]
    + [(n, pa.binary()) for n in ("keys", "docs", "places", "depths", "sizes", "bytes", "again")]
)
_RUNS = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])


def merge_sorted(order: np.ndarray, groups: np.ndarray, before) -> np.ndarray:
    """A mergesort in rounds, every merge of a round at once: each element finds its place in the other run by binary search.

    ``order`` lists elements with equal ``groups`` together; ``before(a, b)`` says which elements a come before elements b of the same group.
    """
    n = len(order)
    edge = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if n else np.zeros(0, np.int64)
    first = np.repeat(edge, np.diff(np.append(edge, n)))
    last = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    largest = int((last - first).max()) if n else 0
    place, run = np.arange(n), 1
    while run < largest:
        inside = place - first
        mine = inside // (2 * run) * (2 * run)
        left = inside - mine < run
        lo = first + np.where(left, np.minimum(mine + run, last - first), mine)
        hi = first + np.minimum(np.where(left, mine + 2 * run, mine + run), last - first)
        base = lo.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            other = order[mid]
            me = order[place[active]]
            # Elements of the left run go first among equals.
            ahead = np.where(left[active], before(other, me), ~before(me, other))
            lo[active] = np.where(ahead, mid + 1, lo[active])
            hi[active] = np.where(ahead, hi[active], mid)
            active = active[lo[active] < hi[active]]
        to = first + mine + (inside - mine - np.where(left, 0, run)) + (lo - base)
        merged = np.empty_like(order)
        merged[to] = order
        order, run = merged, 2 * run
    return order


class Sides:
    """Suffixes (or reversed prefixes) of many contexts in one buffer, compared by prefix hashes; the hashes of a context begin at its own start, so the
    powers they need are as many as a context has bytes."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, rolling: Rolling):
        """``sizes``: bytes of the contexts that fill the buffer one after another; suffix i lies in context i."""
        self.buffer, self.starts, self.lengths, self.rolling = np.append(buffer, 0), starts, lengths, rolling
        begin = np.cumsum(sizes) - sizes
        self.offset = starts - begin
        self.prefix = np.zeros(len(buffer) + 1, np.uint64)
        inside = np.arange(len(buffer), dtype=np.int32) - np.repeat(begin, sizes).astype(np.int32)
        rolling.reach(int(sizes.max(initial=0)) + 1)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * rolling.up[inside], out=self.prefix[1:])

    def _hash(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[self.starts[a] + n] - self.prefix[self.starts[a]]) * self.rolling.down[self.offset[a]])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, by binary search on hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.lengths[a], self.lengths[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._hash(a, mid) == self._hash(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = self.common(a, b)
        end = (k >= self.lengths[a]) | (k >= self.lengths[b])
        x = self.buffer[np.where(end, len(self.buffer) - 1, self.starts[a] + k)]
        y = self.buffer[np.where(end, len(self.buffer) - 1, self.starts[b] + k)]
        return np.where(end, self.lengths[a] < self.lengths[b], x < y)

    def checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extensions confirmed on the bytes; a hash collision shortens them to what is equal."""
        k = self.common(a, b)
        ends = np.cumsum(k)
        offset = np.arange(int(k.sum())) - np.repeat(ends - k, k)
        unlike = self.buffer[np.repeat(self.starts[a], k) + offset] != self.buffer[np.repeat(self.starts[b], k) + offset]
        if unlike.any():
            who = np.repeat(np.arange(len(k)), k)[unlike]
            np.minimum.at(k, who, offset[unlike])
        return k


def sorted_sides(
    buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, sizes: np.ndarray | None = None, rolling: Rolling | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes in order within their groups, and the confirmed common extension of each with the one before (-1 at a group's start)."""
    if sizes is None:  # all lie in one text
        sizes, starts, groups = np.array([len(buffer)]), starts, groups
        sides = Sides(buffer, np.zeros(1, np.int64), np.zeros(1, np.int64), sizes, rolling or Rolling())
        sides.starts, sides.lengths, sides.offset = starts, lengths, starts
    else:
        sides = Sides(buffer, starts, lengths, sizes, rolling or Rolling())
    order = merge_sorted(np.arange(len(starts)), groups, sides.before)
    common = np.full(len(order), -1, np.int64)
    follow = np.flatnonzero(groups[order][1:] == groups[order][:-1]) + 1
    common[follow] = sides.checked(order[follow - 1], order[follow])
    return order, common


def repeated_depths(
    groups: np.ndarray, texts: list[bytes], depths: np.ndarray, counts: np.ndarray, again: np.ndarray, width: int, rolling: Rolling | None = None
) -> np.ndarray:
    """For contexts sorted by group a table (context x depth) of the windows that occur more than once.

    ``depths`` is the place of the anchor in its context, ``counts`` the number of windows, the first of which starts with the context.
    """
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    begin = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    rolling = rolling or Rolling()
    right, right_common = sorted_sides(buffer, begin + depths, sizes - depths, groups, sizes, rolling)
    # Every context is reversed in its own place, so that contexts keep their order.
    back = np.repeat(2 * begin + sizes - 1, sizes) - np.arange(len(buffer))
    left, left_common = sorted_sides(buffer[back], begin + sizes - depths, depths, groups, sizes, rolling)
    out = np.zeros((n, int(depths.max()) + 1), bool)
    for d in range(out.shape[1]):
        has = np.flatnonzero((d <= depths) & (d > depths - counts))
        if not len(has):
            continue
        ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
        ahead[right] = np.cumsum(right_common < width - d)
        behind[left] = np.cumsum(left_common < d)
        both = ahead[has] * np.int64(n + 1) + behind[has]
        _, inverse, times = np.unique(both, return_inverse=True, return_counts=True)
        out[has, d] = (times[inverse] > 1) | again[has]
    return out


def found_runs(width: int):
    """(part, docs, starts, counts): runs of window starts that repeat; ``docs`` are names of rows in their part."""
    rolling = Rolling()

    def gathered(rows: dict) -> Iterator[tuple]:
        source, keys, docs, places, depths, texts, again = [], [], [], [], [], [], []
        for i, part in enumerate(rows["part"]):
            k = as_numbers(rows["keys"][i])
            source.append(np.full(len(k), part, np.int64))
            keys.append(k)
            for held, name in ((docs, "docs"), (places, "places"), (depths, "depths")):
                held.append(np.frombuffer(rows[name][i], np.int64))
            again.append(np.frombuffer(rows["again"][i], bool))
            ends = np.cumsum(np.frombuffer(rows["sizes"][i], np.int64)).tolist()
            texts.extend(rows["bytes"][i][a:b] for a, b in zip([0, *ends], ends, strict=False))
        source, keys, docs, places, depths, again = (np.concatenate(x) for x in (source, keys, docs, places, depths, again))
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.diff(keys[order])) + 1
        pieces: list[np.ndarray] = []
        lengths, held = np.fromiter(map(len, texts), np.int64, len(texts)), 0
        for piece in np.split(order, edges):  # groups are sorted together up to a bounded number of bytes
            more = int(lengths[piece].sum())
            if pieces and held + more > TOGETHER:
                yield from solved(np.concatenate(pieces), source, keys, docs, places, depths, texts, again)
                pieces, held = [], 0
            pieces.append(piece)
            held += more
        if pieces:
            yield from solved(np.concatenate(pieces), source, keys, docs, places, depths, texts, again)

    def solved(pick, source, keys, docs, places, depths, texts, again) -> Iterator[tuple]:
        chosen = [texts[i] for i in pick.tolist()]
        counts = np.fromiter(map(len, chosen), np.int64, len(chosen)) - width + 1
        at = depths[pick]
        table = repeated_depths(keys[pick], chosen, at, counts, again[pick], width, rolling)
        # A window at depth d starts d bytes before the anchor: flipped, columns run in the order of the starts.
        flipped = np.zeros((len(pick), table.shape[1] + 2), np.int8)
        flipped[:, 1:-1] = table[:, ::-1]
        change = np.diff(flipped, axis=1)
        row, begin = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        starts = places[pick][row] + begin - (table.shape[1] - 1)
        by = source[pick][row]
        for part in np.unique(by):
            m = by == part
            yield (int(part), docs[pick][row][m].tobytes(), starts[m].tobytes(), (end - begin)[m].tobytes())

    def single(rows: dict) -> Iterator[tuple]:
        """Windows of hot anchors: 16-byte hashes, each once a part."""
        first = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in rows["keys"]]
        every = np.concatenate(first)
        _, inverse, times = np.unique(every, axis=0, return_inverse=True, return_counts=True)
        inverse, at = inverse.ravel(), 0
        for i, part in enumerate(rows["part"]):
            m = (times[inverse[at : at + len(first[i])]] > 1) & ~np.frombuffer(rows["again"][i], bool)
            at += len(first[i])
            if m.any():
                docs, places = (np.frombuffer(rows[c][i], np.int64)[m] for c in ("docs", "places"))
                yield (part, docs.tobytes(), places.tobytes(), np.ones(len(docs), np.int64).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in runs_of(batches, "bucket"):
            if bucket < 0:  # known in its part already
                yield _packed(list(zip(rows["part"], rows["docs"], rows["places"], rows["sizes"], strict=True)), _RUNS)
                continue
            for kind, solve in ((0, gathered), (1, single)):
                mine = {c: [v for v, k in zip(values, rows["kind"], strict=True) if k == kind] for c, values in rows.items()}
                if mine["part"]:
                    yield _packed(list(solve(mine)), _RUNS)

    return run


def remove_repeats(docs: DataFrame, width: int = 400, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, stretch: int = STRETCH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and ``kept``, its remaining bytes. ``stretch`` bytes are searched for anchors at once."""
    if width < GRAM:
        raise ValueError(f"strings must have {GRAM} bytes or more")
    buckets = parts_for(docs.sparkSession)
    parts = 4 * buckets  # texts in smaller groups than keys: every part sends every bucket one row
    rows = dealt(docs, doc_id, text, parts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width, stretch)
        pairs = (r for b in batches for r in zip(b.column("part").to_pylist(), (t.as_py() for t in b.column("text")), strict=True))
        for group in batched(pairs, lambda r: len(r[1])):
            keys, owners = [], []
            for part, t in group:
                h = anchors(np.frombuffer(t, np.uint8))[1]
                keys.append(h)
                owners.append(np.full(len(h), part, np.int32))
            keys = np.concatenate(keys)
            if len(keys):
                yield send_keys(keys, np.concatenate(owners), buckets)

    def contexts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        marked = np.concatenate([as_numbers(k) for k in right.column("keys").to_pylist()] or [np.zeros(0, np.uint64)])
        is_hot = np.concatenate([np.frombuffer(h, bool) for h in right.column("hot").to_pylist()] or [np.zeros(0, bool)])
        order = np.argsort(marked)
        marked, is_hot = marked[order], is_hot[order]
        anchors = Anchors(width, stretch)
        seen: dict = {}  # (key, depth, context) -> its entry
        hot_ones: dict = {}  # the same of hot anchors
        names = names_of(left) if len(marked) else {}
        for row in rows_of(left) if len(marked) else ():
            doc, t = names[row], row[2]
            at, h, first, last = anchors(np.frombuffer(t, np.uint8))
            where = np.minimum(np.searchsorted(marked, h), len(marked) - 1)
            for i in np.flatnonzero(marked[where] == h).tolist():
                a, begin, end = int(at[i]), int(first[i]), int(last[i]) + 1
                held = hot_ones if is_hot[where[i]] else seen
                held.setdefault((int(h[i]), a - begin, t[begin : end - 1 + width]), []).append((doc, a, begin, end - begin))
        lone: dict = {}  # hash of a window of a hot anchor -> its places in different contexts
        for (_, _, context), held in hot_ones.items():
            for p in range(held[0][3]):
                lone.setdefault(hashlib.md5(context[p : p + width]).digest(), []).append((held[0][0], held[0][2] + p, len(held) > 1))
        out: list[tuple] = []
        local = [(doc, begin, n) for kind in (seen, hot_ones) for held in kind.values() if len(held) > 1 for doc, _, begin, n in held]
        local += [(doc, p, 1) for held in lone.values() if len(held) > 1 for doc, p, _ in held]
        if local:
            numbers = [np.array(c, np.int64).tobytes() for c in zip(*local, strict=True)]
            out.append((-1 - part, part, 0, b"", numbers[0], numbers[1], b"", numbers[2], b"", b""))
        floor = bucket_floor(buckets)
        entries: dict[int, list] = {}
        for (h, depth, context), held in seen.items():
            entries.setdefault(int(np.searchsorted(floor, np.uint64(h), "right")) - 1, []).append((h, held[0][0], held[0][1], depth, context, len(held) > 1))
        for bucket, mine in entries.items():
            columns = list(zip(*mine, strict=True))
            numbers = [np.array(c, np.int64).tobytes() for c in (*columns[1:4], [len(c) for c in columns[4]])]
            out.append((bucket, part, 0, np.array(columns[0], np.uint64).tobytes(), *numbers, b"".join(columns[4]), np.array(columns[5], bool).tobytes()))
        single: dict[int, list] = {}
        for digest, held in lone.items():
            single.setdefault(int.from_bytes(digest[:4], "little") * buckets >> 32, []).append((digest, *held[0][:2], len(held) > 1 or held[0][2]))
        for bucket, mine in single.items():
            columns = list(zip(*mine, strict=True))
            docs_, places = (np.array(c, np.int64).tobytes() for c in columns[1:3])
            out.append((bucket, part, 1, b"".join(columns[0]), docs_, places, b"", b"", b"", np.array(columns[3], bool).tobytes()))
        return pa.Table.from_batches([_packed(out, _CONTEXTS)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = []
        for c in ("docs", "starts", "counts"):
            columns.append(np.concatenate([np.frombuffer(v, np.int64) for v in right.column(c).to_pylist()] or [np.zeros(0, np.int64)]))
        order = np.argsort(columns[0], kind="stable")
        docs_, starts, counts = (c[order] for c in columns)
        out: list[list] = [[], [], [], [], []]
        names = names_of(left)
        for i, row in zip(left.column("id").to_pylist(), rows_of(left), strict=True):
            doc, t = names[row], row[2]
            mine = slice(*np.searchsorted(docs_, [doc, doc + 1]))
            gone = covered(len(t), starts[mine], counts[mine] + width - 1) if mine.stop > mine.start else np.zeros(len(t), bool)
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if spans else t
            for column, value in zip(out, (i, len(t), int(gone.sum()), spans, kept), strict=True):
                column.append(value)
        kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(out, kinds, strict=True)], names=[n for n, _ in kinds])

    marks = settled(rows.select("part", "text").mapInArrow(find, KEYS), buckets).mapInArrow(repeated(hot), "part int, keys binary, hot binary")
    texts = rows.groupBy("part")
    cuts = texts.cogroup(marks.groupBy("part")).applyInArrow(contexts, CONTEXTS)
    runs = settled(cuts, buckets).mapInArrow(found_runs(width), "part int, docs binary, starts binary, counts binary")
    result = texts.cogroup(runs.groupBy("part")).applyInArrow(cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return result.withColumnRenamed("id", doc_id)
