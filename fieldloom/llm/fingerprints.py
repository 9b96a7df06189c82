"""Document fingerprints by winnowing, with DataFrame functions only.

Every ``K`` consecutive characters are hashed; of every ``WINDOW`` consecutive hashes the smallest is kept with its position, of equal ones the rightmost.
Two texts that share ``K + WINDOW - 1`` characters therefore share a fingerprint. A text with fewer hashes is one window; one shorter than ``K`` is one
hash of the whole text; an empty text has none.

An entry is one number, position * 2**32 + hash. Inside, hashes carry their position in the low bits, so the smallest number is the rightmost smallest
hash. A window's minimum is at most the minimum of an aligned block of half a window that the window holds, so per block only the few numbers at most as
large as the block minima around it can be minima (about one in thirteen); among these an entry is kept if the nearest smaller ones on both sides leave
room for a window. All of it happens inside a row, in stretches of bounded length.

An edited text (its last third replaced by the head of the next document) takes over what winnowing says about windows that lie wholly in one of the two
parts, and only the windows across the seam are hashed anew.

Documents are dealt into ranges of the order (descending id), whose first keys are found beforehand, one a range; the first document of a range goes to the
range before as well, so one exchange of the texts brings all neighbours together.

Defined cases: null text counts as empty; two empty fingerprints have likeness 1, an empty and another one 0; rows that repeat an id follow one another in
the order of their texts' hashes, wholly equal rows count as one document and give equal rows; a null id comes last; a single document is its own next.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fieldloom.llm.common import parts_for

K = 16
WINDOW = 64
BLOCK = WINDOW // 2
STRETCH = 2048
#: Candidates looked at on each side of a candidate before all that can lie within a window are.
NEAR = 8

_LOW = (1 << 31) - 1
_NONE = "array<bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty() -> Column:
    return F.array().cast(_NONE)


def _hash31(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(_LOW))


def _place(v: Column) -> Column:
    return F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))


def _entry(v: Column, shift: Column) -> Column:
    return (_place(v) + shift) * F.lit(1 << 32) + F.shiftright(v, 31)


def _kept(candidates: Column, n: Column) -> Column:
    """Those candidates that are the minimum of a window: the nearest smaller ones to both sides leave room for one."""

    def keep(x: Column, i: Column) -> Column:
        p = _place(x)

        def left(width: int) -> Column:
            some = F.slice(candidates, F.greatest(i - (width - 1), F.lit(1)), F.least(i, F.lit(width)))
            return F.coalesce(F.array_max(F.transform(F.filter(some, lambda y: y < x), _place)), F.lit(-1))

        def right(width: int) -> Column:
            some = F.slice(candidates, i + 2, F.lit(width))
            return F.coalesce(F.array_min(F.transform(F.filter(some, lambda y: y < x), _place)), n)

        def reach(width: int) -> Column:
            return right(width) - left(width) > F.lit(WINDOW)

        # Numbers further than a window do not matter; the near ones nearly always reach beyond it.
        before, after = F.get(candidates, i - NEAR), F.get(candidates, i + NEAR)
        beyond = F.coalesce(_place(before) <= p - WINDOW, i < NEAR) & F.coalesce(_place(after) >= p + WINDOW, F.lit(True))
        return reach(NEAR) & (beyond | reach(WINDOW))

    return F.filter(candidates, keep)


def _winnow(text: Column, shift: Column, alone: Column) -> Column:
    """Entries of one stretch; ``alone``: the stretch is a whole text, which is one window even if it is shorter than one."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))
    numbers = F.transform(grams, lambda g, i: F.shiftleft(_hash31(g), 31) + (F.lit(_LOW) - i))

    def of(v: Column) -> Column:
        n = F.size(v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.array_min(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        limits = _let(blocks, lambda m: F.transform(m, lambda x, b: F.greatest(F.get(m, b - 1), x, F.get(m, b + 1))))
        candidates = _let(limits, lambda t: F.filter(v, lambda x, i: x <= F.get(t, F.shiftright(i, BLOCK.bit_length() - 1))))
        several = _let(candidates, lambda c: _kept(c, n))
        whole = F.array(F.shiftleft(_hash31(text), 31) + F.lit(_LOW))
        picked = (
            F.when(n >= WINDOW, several)
            .when(~alone | (F.length(text) == 0), _empty())
            .when(n > 0, F.array(F.array_min(v)))
            .otherwise(whole)
        )
        return F.transform(picked, lambda x: _entry(x, shift))

    return _let(numbers, of)


def fingerprint(text: Column) -> Column:
    """Sorted entries of a whole text."""
    text = F.coalesce(text, F.lit(""))
    overlap = STRETCH + WINDOW + K - 2
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{overlap}}})).{{1,{STRETCH}}}"), F.lit(1))
    return _let(
        stretches,
        lambda parts: F.array_distinct(F.flatten(F.transform(parts, lambda s, j: _winnow(s, (j * STRETCH).cast("bigint"), F.size(parts) == 1)))),
    )


def _position(entry: Column) -> Column:
    return F.shiftright(entry, 32)


def _hash_of(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << 32) - 1))


def _inside(entries: Column, length: Column) -> Column:
    """Of a text's entries those that windows wholly within its first ``length`` characters select."""
    grams = length - (K - 1)
    last = F.filter(entries, lambda e: (_position(e) >= grams - WINDOW) & (_position(e) < grams))
    # The last of these windows selects the smallest hash in it, of equal ones the rightmost; what stands further right comes from later windows.
    end = F.array_min(F.transform(last, lambda e: F.struct(_hash_of(e).alias("hash"), (-_position(e)).alias("back"))))["back"]
    return F.when(grams >= WINDOW, _let(-end, lambda p: F.filter(entries, lambda e: _position(e) <= p))).otherwise(_empty())


def edited_fingerprint(text: Column, own: Column, cut: Column, piece: Column, other: Column) -> Column:
    """Entries of ``text[:cut] + piece``, where ``piece`` is the head of a text with the entries ``other``."""
    q = F.length(piece)
    side = WINDOW + K - 2
    start = F.greatest(cut - side, F.lit(0))
    seam = F.concat(F.substring(text, start + 1, cut - start), F.substring(piece, F.lit(1), F.lit(side)))
    across = _winnow(seam, start.cast("bigint"), cut + q < WINDOW + K - 1)
    moved = F.transform(_inside(other, q), lambda e: e + cut.cast("bigint") * F.lit(1 << 32))
    return F.sort_array(F.array_distinct(F.concat(_inside(own, cut), across, moved)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints."""
    x, y = F.array_distinct(F.transform(a, _hash_of)), F.array_distinct(F.transform(b, _hash_of))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def written_out(entries: Column) -> Column:
    """A fingerprint as text: hash:position pairs in the order of positions."""
    pair = lambda e: F.concat(F.lower(F.lpad(F.hex(_hash_of(e)), 8, "0")), F.lit(":"), _position(e).cast("string"))
    return F.array_join(F.transform(entries, pair), " ")


def _range_of(firsts: list[tuple[int, int]], me: Column, step: int = 64) -> Column:
    """The number of the range that a key (k, h) lies in, from the descending first keys of the ranges: first the step, then the place in it."""

    def bounds(keys: list[tuple[int, int]]) -> Column:
        return F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in keys])), "array<struct<k:bigint,h:bigint>>")

    def reached(keys: Column) -> Column:
        return F.size(F.filter(keys, lambda b: b >= me))

    return _let((reached(bounds(firsts[::step])) - 1) * step, lambda at: at + reached(F.slice(bounds(firsts), at + 1, F.lit(step))) - 1)


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its entries, the edited text and its entries, and the next document's entries."""
    parts = parts_for(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("k", F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    me = F.struct("k", "h")
    ranges = keyed.select("k", "h").repartitionByRange(4 * parts, F.col("k").desc(), F.col("h").desc())
    ends = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.max(me).alias("first")).collect()  # one row a range
    firsts = sorted(((r["first"]["k"], r["first"]["h"]) for r in ends), reverse=True)
    if not firsts:
        firsts = [(0, 0)]
    own = F.array(_range_of(firsts, me))
    first = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in firsts])), "array<struct<k:bigint,h:bigint>>")
    before = F.when(F.array_contains(first, me), F.transform(own, lambda p: F.pmod(p - 1, F.lit(len(firsts)))))
    spread = keyed.select("*", F.posexplode(F.concat(own, F.coalesce(before, F.array().cast("array<int>")))).alias("guest", "part"))

    marked = spread.repartition(parts, "part").withColumn("entries", fingerprint(F.col("text")))
    # In ascending order a document's next one stands before it; of equal rows only the last is passed on, to the documents that follow.
    order = W.Window.partitionBy("part").orderBy(F.col("guest").desc(), "k", "h")
    place = F.struct("guest", "k", "h")
    passed = marked.withColumn("passed", F.when(~F.lead(place).over(order).eqNullSafe(place), F.struct("text", "entries")))
    following = F.last("passed", ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    joined = passed.withColumn("following", following).where("guest = 0")

    n = F.length("text")
    cut = n - F.floor(n / 3).cast("int")
    joined = joined.select(
        "id",
        "text",
        n.cast("bigint").alias("n_chars"),
        "entries",
        cut.alias("cut"),
        F.substring(F.col("following.text"), F.lit(1), n - cut).alias("piece"),
        F.col("following.entries").alias("other"),
    )
    return joined.select(
        F.col("id").alias(doc_id),
        "n_chars",
        F.concat(F.substring(F.col("text"), F.lit(1), F.col("cut")), F.col("piece")).alias("edited"),
        "entries",
        edited_fingerprint(F.col("text"), F.col("entries"), F.col("cut"), F.col("piece"), F.col("other")).alias("edited_entries"),
        F.col("other").alias("next_entries"),
    )
