"""Encode texts to the ids of a piece vocabulary (byte-pair merges by piece score, bytes for unknown characters) and decode them again.

Texts are cut into words where no piece can reach across (before a run of spaces, and between two characters that stand side by side in no piece). The
different words of a batch lie in one flat array of symbols and are merged together: a round finds the least pair rank of each word, merges all its places
from left to right at once, as far as no merge makes a pair that would have come first, and compacts the array; it ends when no pair is left. That is the
order in which merging one best pair after another, the leftmost of equals, goes on within a word, and words do not touch each other. Words already merged are
looked up in a bounded store. A word of more than ``LONG`` symbols is merged by a heap in the same order, as rounds would grow with its square.

Whole texts are encoded row by row where they are: no shuffle, and memory is bounded by a batch of rows. A null text is the empty text, which has the end id
alone; repeated rows and extra columns pass through; a column named ``ids`` (encoding) or ``decoded`` (decoding) is replaced. An empty table gives no rows.

Only models without text normalisation are supported (identity, spaces kept, one space put before the text); others are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NEVER = np.iinfo(np.int64).max
#: Code points lie above the ids in the numbers of symbols that are no piece.
CHARS = 0x110000
#: Symbols of a word from which on a heap merges it; words kept in the store of a task; characters of texts that are merged together.
LONG, STORE, BATCH = 4_096, 1 << 19, 2 << 20


class Table:
    """Whole numbers to whole numbers (-1 where unknown), looked up many at once: open addressing in a sparse array."""

    def __init__(self, given: dict[int, int]):
        size = 1 << max(10, (16 * len(given)).bit_length())
        self.shift, self.mask = 64 - size.bit_length() + 1, size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, values = np.array([*given], np.int64), np.array([*given.values()], np.int64)
        at = self._at(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Pieces:
    """A vocabulary as arrays: which two symbols merge to which piece, and in which order."""

    def __init__(self, model: bytes):
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        if given.normalize("　 a  ﬁ ") != f"{SPACE}　{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only models that keep texts as they are, with a space before, are supported")
        self.n = given.vocab_size()
        self.end, self.unknown = given.eos_id(), given.unk_id()
        names = [given.id_to_piece(i) for i in range(self.n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(self.n) if given.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte pieces are supported")
        self.silent = {i for i in range(self.n) if given.is_control(i)}
        apart = {*self.byte_id.values(), *self.silent, self.unknown}
        normal = {p: i for i, p in enumerate(names) if i not in apart}
        if any(given.is_unused(i) for i in range(self.n)):
            raise ValueError("models with unused pieces are not supported")
        scores = sorted({given.get_score(i) for i in normal.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        rank = {i: place[given.get_score(i)] for i in normal.values()}
        self.symbol_of = np.arange(self.n, self.n + CHARS, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i

        def symbol(p: str) -> int | None:
            return int(self.symbol_of[ord(p)]) if len(p) == 1 else normal.get(p)

        pairs, near = {}, set()
        for p, i in normal.items():
            near.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.n + CHARS) + b] = i
        self.pairs = Table(pairs)
        self.rank = np.full(self.n + 1, NEVER)  # the last stands for no piece
        self.rank[[*rank]] = [*rank.values()]
        self.near = Table({ord(a) * CHARS + ord(b): 1 for a, b in near})
        self.splits = not any(a != SPACE and b == SPACE for a, b in near)
        self.surface = [b"" if i in self.silent else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        for byte, i in self.byte_id.items():
            self.surface[i] = bytes([byte])
        self.bytes_ids = frozenset(self.byte_id.values())
        self.begins = frozenset(i for p, i in normal.items() if p[0] == SPACE)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours merge to, -1 where they do not."""
        return self.pairs[a * (self.n + CHARS) + b]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rank[self.joined(a, b)]

    def borders(self, codes: np.ndarray) -> np.ndarray:
        """Marks the characters at which no piece can reach back to the character before."""
        out = np.ones(len(codes), bool)
        out[1:] = self.near[codes[:-1] * CHARS + codes[1:]] < 0
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, spaces written as their piece."""
        text = SPACE + text.replace(" ", SPACE) if text else ""
        return _WORDS.findall(text) if self.splits else [text] * bool(text)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the words that begin where ``first`` is set; returns symbols and the new marks."""
        done_s, done_w = [], []
        word = np.cumsum(first) - 1
        total = int(word[-1]) + 1 if len(word) else 0
        rank = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NEVER
            if over.any():
                done_s.append(symbols[over])
                done_w.append(word[over])
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
                continue
            # places of the least rank, every second one of a chain of them
            hit = np.flatnonzero(rank == least)
            chain = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(chain)[np.cumsum(chain) - 1]) % 2 == 0]
            new = self.joined(symbols[hit], symbols[hit + 1])
            # up to the first whose new neighbours would merge before the next place
            left, right = symbols[np.maximum(hit - 1, 0)].copy(), symbols[np.minimum(hit + 2, len(symbols) - 1)]
            close = np.flatnonzero(np.diff(hit) == 2) + 1
            left[close] = new[close - 1]
            cut = (hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit]) & (self.ranks(left, new) <= rank[hit])
            cut |= (hit + 2 < len(word)) & (word[np.minimum(hit + 2, len(word) - 1)] == word[hit]) & (self.ranks(new, right) <= rank[hit])
            earlier = np.cumsum(cut) - cut
            opens = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            stays = earlier == earlier[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
            hit, new = hit[stays], new[stays]
            symbols[hit] = new
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at = place[hit]
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again + 1 < len(word)]
            rank[at[at + 1 >= len(word)]] = NEVER
            same = word[again] == word[again + 1]
            rank[again[~same]] = NEVER
            again = again[same]
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        symbols, word = np.concatenate([*done_s, symbols]), np.concatenate([*done_w, word])
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        marks = np.ones(len(word), bool)
        marks[1:] = word[1:] != word[:-1]
        assert int(marks.sum()) == total
        return symbols, marks

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one word of any length, with a heap of pairs."""
        n, after, before = len(symbols), [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            places = [i for i in places if i >= 0 and after[i] >= 0]
            if places:
                a, b = (np.array([symbols[j] for j in js], np.int64) for js in (places, [after[i] for i in places]))
                for i, r in zip(places, self.ranks(a, b).tolist()):
                    if r != NEVER:
                        heapq.heappush(heap, (r, i, symbols[i], symbols[after[i]]))

        offer(list(range(n)))
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i] = int(self.joined(np.array([a]), np.array([b]))[0])
            symbols[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([before[i], i])
        return [s for s in symbols if s >= 0]

    def encode_words(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        codes = np.frombuffer("".join(given).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in given], np.int64)
        starts = np.cumsum(lengths) - lengths
        first = self.borders(codes) if len(codes) else np.zeros(0, bool)
        first[starts] = True
        owner = np.repeat(np.arange(len(given)), lengths)
        symbols = self.symbol_of[codes]
        cuts = np.flatnonzero(first)
        sizes = np.diff(np.append(cuts, len(codes)))
        out_s, out_o, short = [], [], np.repeat(sizes <= LONG, sizes)
        for c, n in zip(cuts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            merged = np.array(self.merge_long(symbols[c : c + n].tolist()), np.int64)
            out_s.append(merged)
            out_o.append(np.full(len(merged), c))
        at = np.flatnonzero(short)
        if len(at):
            merged, marks = self.merge(symbols[at], first[at])
            out_s.append(merged)
            out_o.append(cuts[sizes <= LONG][np.cumsum(marks) - 1])
        merged, origin = np.concatenate(out_s), np.concatenate(out_o)
        order = np.argsort(origin, kind="stable")
        merged, origin = merged[order], origin[order]
        unknown = np.flatnonzero(merged >= self.n)
        if len(unknown):
            spelled = [[self.byte_id[x] for x in chr(s - self.n).encode()] for s in merged[unknown].tolist()]
            sizes = np.ones(len(merged), np.int64)
            sizes[unknown] = [len(s) for s in spelled]
            origin, at = np.repeat(origin, sizes), np.cumsum(sizes) - sizes
            wide = np.zeros(len(origin), np.int64)
            wide[at] = merged
            wide[np.concatenate([np.arange(i, i + len(s)) for i, s in zip(at[unknown], spelled)])] = [x for s in spelled for x in s]
            merged = wide
        return merged.astype(np.int32), np.bincount(owner[origin], minlength=len(given))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: a space put before is taken away, bytes that are no character become U+FFFD each, ids outside the vocabulary fail."""
        while ids and ids[-1] in self.silent:
            ids = ids[:-1]
        if not self.silent.isdisjoint(ids):
            return self._spelled(ids)
        surface = self.surface
        whole = b"".join([surface[i] for i in ids])
        try:
            return (whole[1:] if ids and ids[0] in self.begins else whole).decode()
        except UnicodeDecodeError:
            return self._spelled(ids)

    def decoded(self, ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Texts of runs of ids."""
        return pa.array([self.decode(ids[e - n : e].tolist()) for e, n in zip(ends.tolist(), sizes.tolist())], pa.string())

    def _spelled(self, ids: list[int]) -> str:
        out, held, start = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.bytes_ids:
                held += self.surface[i]
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
                start = False
            if i is None or i in self.silent:  # invisible, but ends a run of bytes
                continue
            piece = self.surface[i].decode()
            out.append(piece[1:] if start and i in self.begins else piece)
            start = False
        return "".join(out)


def _characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@lru_cache(maxsize=2)
def loaded(model: bytes) -> Pieces:
    return Pieces(model)


class Store:
    """Ids of words met before, dropped as a whole when they are too many. The first word stands for the end of a text."""

    def __init__(self, pieces: Pieces, most: int = STORE):
        self.pieces, self.most = pieces, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes = np.array([self.pieces.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        ids, sizes = self.pieces.encode_words(fresh)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, each with the end id, and how many each has."""
        split = [self.pieces.words(t or "") for t in texts]
        if len(self.known) > self.most:
            self._clear()
        known = self.known
        fresh = list(set(chain.from_iterable(split)).difference(known))
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable([*words, ""] for words in split)), np.int64)
        sizes = self.sizes[at]
        begin = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[at] - begin, sizes) + np.arange(int(sizes.sum()))]
        words = np.array([len(words) + 1 for words in split], np.int64)
        return ids, np.add.reduceat(sizes, np.cumsum(words) - words) if len(words) else words


def pieces_of(batch: pa.RecordBatch, most: int, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of ``column``; a longer row stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // most
    for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(run)) + 1):
        if len(cut):
            yield batch.slice(cut[0], len(cut))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], [*kept, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema if f.name != name], T.StructField(name, kind)])


def model_bytes(path: str) -> bytes:
    """The model file, read once by the driver; it travels with the tasks (half a megabyte for 32,000 pieces)."""
    return Path(path).read_bytes()


def encode(docs: DataFrame, model: bytes, text: str = "text", round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids``: the piece ids of the whole text and the end id. ``round_trip`` puts the text that ``decode`` makes of them in the place of
    the given text, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        store = Store(pieces)
        for batch in batches:
            for part in pieces_of(batch, BATCH, text):
                ids, sizes = store.encode(part.column(text).to_pylist())
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                if round_trip:
                    part = part.set_column(part.schema.get_field_index(text), text, pieces.decoded(ids, ends, sizes))
                yield _with(part, "ids", lists)

    return docs.mapInArrow(run, _schema(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of the ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(ids)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                yield _with(part, "decoded", pieces.decoded(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes), sizes))

    return encoded.mapInArrow(run, _schema(encoded, "decoded", T.StringType()))
