"""Near copies by HyperMinHash: compressed registers, banding, collision-corrected estimates, verification on full sets, connected components.

A document is the set of its word shingles, each hashed to 64 bits. The first 7 bits choose one of 128 registers, which keeps of its smallest remaining
hash the number of leading zeros and 10 bits of mantissa. Equal sets are one class from here on, so exact copies never meet as pairs.

1. Bands of four registers are hashed; classes that share a band are candidates. A bucket is split into blocks of about a thousand members, and pairs of
   blocks are compared, so no group is gathered whole. Pairs must pass a bound on the set sizes and an estimate, freed of the expected chance collisions,
   of no less than five standard deviations under the threshold.
2. A first round verifies, for every member of a bucket, its likeliest earlier partner; that is a forest for each pair of blocks, not all pairs. The links found are joined to
   components. A second round looks again only at buckets that had further pairs and members of different components; the full sets come along, and what
   lies in different components is verified there and then. After it every pair that passed has been verified or lies within one component. A round
   sends each member of a bucket once for each block of it: m rows for a bucket within one block, about m * m / 1,024 for a larger one of m members, whose
   m * m / 2 pairs of registers are all compared. In the second round each of these rows carries its full set. Exact copies are one class and do not count.
3. Verification counts the common members of the full sets.

With 32 bands a pair at the threshold of 0.8 shares none with probability (1 - 0.8**4)**32 = 5e-8; closer pairs even less often.

Defined cases: texts without words have an empty set, are linked with nothing and kept; texts of fewer words than a shingle are one shingle; rows that
share an id are judged by their texts, each for itself, and rows that share id and text alike (``near_copies`` marks all of them, ``keep_one`` keeps one); a
null id counts as the smallest; an empty table gives an empty result; extra columns are kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import mix64, parts_for, written
from fieldloom.llm.substrings import NULL_ID, Words

REGISTERS, BANDS, MANTISSA = 128, 32, 10
BLOCK = 1024
PAIRS = 1 << 13


def lowered(text: bytes | None) -> bytes:
    """A-Z in lower case, other bytes as they are."""
    data = np.frombuffer(text or b"", np.uint8)
    return (data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)).tobytes()


def shingles(words: Words, text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    hashes = words(lowered(text))[0]
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(size, len(hashes))
    return np.unique(words.rolling.runs(words.rolling.prefix(hashes), np.arange(len(hashes) - width + 1), width))


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """128 numbers: 0 for an empty register, else (leading zeros + 1) and ten bits of mantissa of its smallest hash."""
    out = np.zeros(REGISTERS, np.uint16)
    bucket = (sorted_hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (sorted_hashes[first] & np.uint64((1 << 57) - 1)).astype(np.float64) + 1
    mantissa, exponent = np.frexp(rest)
    zeros = np.clip(58 - exponent, 0, 57)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) + np.minimum((mantissa - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that two registers of unlike sets of n and m members agree: same leading zeros, same mantissa."""
    edge = 2.0 ** -np.arange(0, 58)

    def share(k):
        over = np.exp(-np.outer(k / REGISTERS, edge))  # the smallest hash is above the edge
        return np.diff(over, axis=1, append=1.0)

    return (share(n) * share(m)).sum(axis=1) / (1 << MANTISSA)


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(passes, estimate) for pairs of register rows."""
    some = (a != 0) | (b != 0)
    union = some.sum(axis=1)
    same = ((a == b) & some).sum(axis=1)
    by_chance = chance(n, m)
    estimate = (same / np.maximum(union, 1) - by_chance) / (1 - by_chance)
    small, large = np.minimum(n, m), np.maximum(n, m)
    spread = np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1))
    return (estimate >= threshold - 5 * spread) & (small >= threshold * large - 1e-9), estimate


SKETCH = "id bigint, doc bigint, body bigint, n bigint, h1 bigint, h2 bigint, regs binary"


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ns, h1, h2, regs = [], [], [], []
            for t in batch.column("text"):
                found = shingles(words, t.as_py(), size)
                ns.append(len(found))
                h1.append(int(mix64(found ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix64(found ^ np.uint64(0xB5297A4D)).sum(dtype=np.uint64).astype(np.int64)))
                regs.append(registers(found).tobytes())
            ids = batch.column("id")
            columns = [ids, ids.fill_null(NULL_ID), batch.column("body"), pa.array(ns, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc", "body", "n", "h1", "h2", "regs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), _body(text).alias("body"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def _body(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.col(text).cast("binary"))


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) for each band of registers that is not empty."""
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.stack([np.frombuffer(r.as_py(), np.uint16) for r in batch.column("regs")])
        packed = np.ascontiguousarray(regs).view(np.uint64)  # four registers each
        keys = mix64(packed ^ salt).astype(np.int64)
        nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
        used = (packed != 0).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[used]), pa.array(nodes[used])], ["key", "node"])


FOUND = "kind int, key bigint, a bigint, b bigint"


def compare(threshold: float, percent: int, forest: bool):
    """For ``mapInArrow`` over rows sorted by (key, p, q). Kinds of rows given: 0 a pair, 1 a key with further pairs, 2 a node of some pair.

    In the round of forests pairs are to be verified; in the other they are links, verified on the full sets that come with the rows, and no more of them
    than join the members. A pair that shares several bands counts in the first of these buckets only.
    """
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

    def first_shared(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        """Whether the bucket of ``key`` belongs to the first band that the rows of registers share."""
        x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
        band = ((x == y) & (x != 0)).argmax(axis=1)
        return mix64(x[np.arange(len(x)), band] ^ salt[band]).astype(np.int64) == key

    def links(lo, hi, score, node, members) -> Iterator[tuple[int, int]]:
        head = {int(v): int(v) for v in node}
        sets = {int(v): np.frombuffer(m, np.uint64) for v, m in zip(node, members, strict=True)}

        def find(v: int) -> int:
            while head[v] != v:
                head[v] = head[head[v]]
                v = head[v]
            return v

        for k in np.argsort(-score, kind="stable").tolist():
            x, y = int(lo[k]), int(hi[k])
            if find(x) == find(y):
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                head[find(y)] = find(x)
                yield x, y

    def group(key: int, p: int, q: int, node, comp, n, blk, regs, members) -> Iterator[tuple]:
        if p == q:
            i, j = np.triu_indices(len(node), 1)
        else:
            x, y = np.flatnonzero(blk == p), np.flatnonzero(blk == q)
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        open_ = comp[i] != comp[j]
        i, j = i[open_], j[open_]
        kept_i, kept_j, score, mine = [], [], [], []
        for start in range(0, len(i), PAIRS):
            s = slice(start, start + PAIRS)
            ok, estimate = likely(regs[i[s]], regs[j[s]], n[i[s]], n[j[s]], threshold)
            kept_i.append(i[s][ok])
            kept_j.append(j[s][ok])
            score.append(estimate[ok])
            mine.append(first_shared(regs[kept_i[-1]], regs[kept_j[-1]], key))
        if not kept_i:
            return
        a, b, score, mine = (np.concatenate(x) for x in (kept_i, kept_j, score, mine))
        lo, hi = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        if not forest:
            yield from ((0, key, x, y) for x, y in links(lo[mine], hi[mine], score[mine], node, members))
        elif len(lo):
            order = np.lexsort((lo, -score, hi))
            best = order[np.flatnonzero(np.diff(hi[order], prepend=hi[order][0] - 1))]
            if len(best) < len(lo):
                yield (1, key, 0, 0)
            for v in np.unique(np.concatenate([lo[mine], hi[mine]])).tolist():
                yield (2, 0, v, 0)
            yield from ((0, key, x, y) for x, y in zip(lo[best].tolist(), hi[best].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def flush(table: pa.Table, all_of_it: bool) -> tuple[pa.RecordBatch, pa.Table]:
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *edges.tolist(), len(keys)]
            if not all_of_it:
                cuts = cuts[:-1]
            node, comp, n, blk = (table.column(c).to_numpy() for c in ("node", "comp", "n", "blk"))
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            members = [None] * len(keys) if forest else table.column("members").to_pylist()
            rows = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1:
                    s = slice(x, y)
                    rows.extend(group(*(int(v) for v in keys[x]), node[s], comp[s], n[s], blk[s], regs[s], members[s]))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(made, ["kind", "key", "a", "b"]), table.slice(cuts[-1])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            if len(rest) >= 2 * BLOCK:
                made, rest = flush(rest, False)
                yield made
        if rest is not None and len(rest):
            yield flush(rest, True)[0]

    return run


def candidate_pairs(rows: DataFrame, reps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Compare the members (key, node, comp, m) of buckets of m members, in pairs of blocks of bounded size. ``reps`` has n, regs and, but for the round of
    forests, members."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("node", "key"), blocks).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "node", "comp", "blk")
    rows = rows.join(reps, "node").repartition(parts_for(rows.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")
    columns = ["key", "p", "q", "node", "comp", "n", "blk", "regs", *(() if forest else ("members",))]
    return rows.select(*columns).mapInArrow(compare(percent / 100, percent, forest), FOUND)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches. Labels spread along links and jump to their label's label until nothing changes."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        said = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "comp")
        near = labels.union(said).groupBy("node").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = near.join(jump, "near").join(labels.withColumnRenamed("comp", "old"), "node")
        new = written(new.select("node", F.least("near", "far").alias("comp"), "old"), "labels")
        done = new.where("comp != old").isEmpty()
        labels = new.select("node", "comp")
        if done:
            return labels


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents are linked if ``percent`` or more of their shingles are common."""
    out = _marked(docs, size, percent, doc_id, text)
    named = F.when(F.col("first") != NULL_ID, F.col("first"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), named.alias("component_id"), "kept")


def _marked(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: id, body, n, first (the smallest id of its component) and kept. A node is a class, so an id may have several."""
    sketch = written(sketches(docs, size, doc_id, text), "sketches")
    same = ["n", "h1", "h2"]
    classes = sketch.where("n > 0").groupBy(same).agg(F.min(F.struct("doc", "body")).alias("head"), F.first("regs").alias("regs"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = sketch.select("id", "doc", "body", *same).join(classes.select(*same, "head", "node"), same, "left")
    members = written(members.select("id", "doc", "body", "n", "head", "node"), "members")
    reps = classes.select("node", "n", "regs")

    keys = reps.select("node", "regs").mapInArrow(bands, "key bigint, node bigint")
    many = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = written(keys.join(many, "key"), "buckets")
    found = written(candidate_pairs(rows.withColumn("comp", F.col("node")), reps, percent, True), "found")

    nodes = found.where("kind = 2").select(F.col("a").alias("node")).distinct()
    wanted = classes.join(nodes, "node").select("node", F.col("head.doc").alias("doc"), F.col("head.body").alias("body"))
    own = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("doc")
    texts = docs.select(own, _body(text).alias("body"), F.col(text).cast("binary").alias("text")).join(wanted, ["doc", "body"])
    texts = texts.dropDuplicates(["doc", "body"]).select("node", "text")
    sets = written(texts.mapInArrow(_sets(size), "node bigint, members binary"), "sets")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    links = written(verified(pairs, sets, percent), "links")
    labels = components(links)

    more = found.where("kind = 1").select("key").distinct()
    open_ = rows.join(more, "key", "left_semi").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    full = reps.join(sets, "node")
    rest = candidate_pairs(open_.join(mixed, "key", "left_semi"), full, percent, False).where("kind = 0").select("a", "b").distinct()
    rest = written(rest, "links")
    if not rest.isEmpty():
        labels = components(links.union(rest))

    heads = labels.join(classes.select("node", "head"), "node").groupBy("comp").agg(F.min("head").alias("top"))
    out = members.join(labels.join(heads, "comp").select("node", "top"), "node", "left").withColumn("top", F.coalesce("top", "head"))
    kept = F.col("top").isNull() | ((F.col("doc") == F.col("top.doc")) & (F.col("body") == F.col("top.body")))
    return out.select("id", "body", "n", F.coalesce("top.doc", "doc").alias("first"), kept.alias("kept"))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            made = pa.array([shingles(words, t.as_py(), size).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), made], ["node", "members"])

    return run


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but the first of each group of near copies, all columns unchanged. Of rows that repeat id and text one stays."""
    marked = written(_marked(docs, size, percent, doc_id, text), "marked")

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("dup_id"), F.col("body").alias("dup_body"))

    # The documents as one column each, so that no name of theirs meets one used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("own_id"), _body(text).alias("own_body"))
    same = F.col("own_id").eqNullSafe(F.col("dup_id")) & F.col("own_body").eqNullSafe(F.col("dup_body"))
    rows = rows.join(keys(marked.where(~F.col("kept"))).distinct(), same, "left_anti")
    again = written(keys(marked.where("kept AND n > 0")).groupBy("dup_id", "dup_body").count().where("count > 1").drop("count"), "again")
    if not again.isEmpty():
        once, often = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
        rows = once.unionByName(often.dropDuplicates(["own_id", "own_body"]))
    return rows.select("row.*")
