"""How document filters interact: for every order of application what each filter removes first, again, alone, and at what loss.

Flags of a document are bits of a mask, and everything asked for is a sum over masks, so documents are counted by (part, mask, labels) with partial sums and
all orders are evaluated on these few counts.

Exact repeats are found after a counting-Bloom prepass. Every task adds its texts' hashes to counters (two is the most that matters) and sends them, block
by block of the sketch, as sparse arrays; blocks are merged by block number. A text of which a counter is below two is certainly unique. Only the other
texts are shuffled, and grouped by the full text with partial minima of the ids. The merged sketch is broadcast as bits: ``per_text`` a document, up to
``most_bits`` (32 MB) in all; beyond that more unique texts pass the sketch and are shuffled, with the same result.

A null text is the empty text. Null ids are smaller than none and no id is smaller than they are, so such rows are never repeats. Rows that share id and text
are not repeats of each other; to tell rows that share an id only, 128 bits of hashes stand for the text. Label rows of one id count as one with the greater
values. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import parts_for, words, written

#: Counters of one block of the sketch; a text has all of its counters in one block.
BLOCK = 1 << 15
PROBES = 4
#: Texts of a task that are added up before their counters are sent.
TOGETHER = 1 << 20


def _probes(h: Column) -> list[Column]:
    """Places of a text's counters within its block, 15 bits each."""
    mixed = F.xxhash64(h)
    return [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BLOCK - 1)).alias(f"p{i}") for i in range(PROBES)]


def _counters(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Blocks and probes of some texts to a row per block: its counters that are not zero, and their values."""
    block = np.concatenate([b for b, _ in held])
    place = np.sort(np.concatenate([p for _, p in held]), 1)
    fresh = np.ones(place.shape, bool)  # a text that meets itself in a place counts once there
    fresh[:, 1:] = place[:, 1:] != place[:, :-1]
    key, n = np.unique((block[:, None] * BLOCK + place)[fresh], return_counts=True)
    blocks, starts = np.unique(key // BLOCK, return_index=True)
    places = np.split((key % BLOCK).astype(np.uint16), starts[1:])
    counts = np.split(np.minimum(n, 2).astype(np.uint8), starts[1:])
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int64()), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())],
        ["block", "places", "counts"],
    )


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((columns[0], np.stack(columns[1:], 1)))
            n += batch.num_rows
        if n >= TOGETHER:
            yield _counters(held)
            held, n = [], 0
    if n:
        yield _counters(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters sorted by block to the bits of those that reach two, 64 in a number."""
    block, counters, done = None, None, []

    def close():
        done.append((block, np.packbits(counters >= 2, bitorder="little").view(np.int64)))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([x for _, x in done], pa.list_(pa.int64()))], ["block", "bits"])
        done.clear()
        return out

    for batch in batches:
        for b, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if block is not None:
                    close()
                block, counters = b, np.zeros(BLOCK, np.uint8)
            at = np.frombuffer(places, np.uint16)
            counters[at] = np.minimum(counters[at] + np.frombuffer(counts, np.uint8), 2)
        if len(done) >= 256:
            yield flush()
    if block is not None:
        close()
        yield flush()


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """Merged sketch of the column ``h``: block and the bits of its counters that reached two."""
    parts = parts_for(hashes.sparkSession)
    sent = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), *_probes(F.col("h"))).mapInArrow(_sketched, "block bigint, places binary, counts binary")
    return sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merged, "block bigint, bits array<bigint>")


def possible_repeats(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """The rows whose hash ``h`` has no counter below two: all repeated texts and a few others."""
    bits = F.broadcast(merged.withColumnRenamed("block", "sketch_block").withColumnRenamed("bits", "sketch_bits"))
    both = rows.join(bits, F.pmod("h", F.lit(blocks)) == F.col("sketch_block"))
    for p in _probes(F.col("h")):
        both = both.where(F.getbit(F.get("sketch_bits", F.shiftrightunsigned(p, 6)), p.bitwiseAND(F.lit(63))) == 1)
    return both.select(*rows.columns)


def text_flags(text: Column) -> list[Column]:
    """Failures of the content filters A to D: short, repetitive, loud, with marks of markup or code."""
    found = words(text)
    n = F.size(found).cast("bigint")
    return [
        n < 200,
        100 * F.size(F.array_distinct(found)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, per_text: int = 16, most_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, part, mask, n): documents of an id and language that fail the same of the filters A (bit 0) to E (bit 4, a repeat of a smaller id's text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")]
    mask = sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(text_flags(F.col("text")))), F.lit(0))
    flagged = written(rows.select("doc_id", "part", *hashes, mask.alias("mask")), "flags")
    blocks = max(1, math.ceil(min(per_text * flagged.count(), most_bits) / BLOCK))
    merged = written(sketch(flagged.select("h"), blocks), "sketch")
    again = possible_repeats(rows.where("doc_id is not null").select("doc_id", "text", *hashes), merged, blocks)
    firsts = again.groupBy("text").agg(F.min("doc_id").alias("f_id"), F.first("h").alias("f_h"), F.first("h2").alias("f_h2")).drop("text")
    candidates = possible_repeats(flagged.where("doc_id is not null"), merged, blocks)
    same = [F.col("doc_id") == F.col("f_id"), F.col("h") == F.col("f_h"), F.col("h2") == F.col("f_h2")]
    repeats = candidates.join(firsts, same, "left_anti").select("doc_id", "part", "mask")
    # every row counts under its content flags; a repeat moves from there to the mask with E
    moved = F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("n"), F.lit(0).alias("e")), F.struct(F.lit(1).cast("bigint").alias("n"), F.lit(16).alias("e"))))
    shifts = repeats.select("doc_id", "part", "mask", moved.alias("x")).select("doc_id", "part", (F.col("mask") + F.col("x.e")).alias("mask"), F.col("x.n").alias("n"))
    every = flagged.select("doc_id", "part", "mask", F.lit(1).cast("bigint").alias("n")).unionByName(shifts)
    return every.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")


def counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counts by part and mask: documents, and those that are labelled good or toxic."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("bad"))
    both = flagged.join(marks, F.col("doc_id") == F.col("l_id"), "left")

    def of(mark: str) -> Column:
        return F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))

    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("bad").alias("toxic"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters (bit i is ``letters[i]``) and step, from ``counts``."""
    orders = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ","))
    rows = counted.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.pow(F.lit(2), F.instr(F.lit(letters), c) - 1).cast("int"))
    rows = rows.withColumn("bits", bits)
    rows = rows.withColumn("bit", F.element_at("bits", F.col("step"))).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("bigint")

    first = (F.lit(math.factorial(len(letters))) / F.bit_count("mask")).cast("bigint")  # the orders in which a failing filter comes before the others
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * first).otherwise(0)).cast("bigint").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interactions of the filters A to E over ``docs`` (doc_id, lang, text) and ``labels`` (doc_id, quality, toxic), by language."""
    return interactions(counts(masks(docs), labels), "ABCDE")
