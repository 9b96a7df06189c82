"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key ``-ln(u) / quality``; the smallest keys of a source are taken first. A source's budget is spent on complete
epochs, then on documents in key order until the words run out; the document at the edge is taken in part, so the budget is met to the word.

No source is sorted as a whole. Keys are cut into 1,024 steps, the steps' sums say which of them holds the edge, that step is cut into 1,024 again, and
only the rows of the last step are ordered, in one task a source. Steps are even for quality 1, where one holds about a millionth of a source. Lower quality
moves keys to the last steps: the very last one holds a share exp(-13.86 * quality) of the documents, a quarter of those of quality 0.1, and all of it is
ordered if the budget ends there. All other rows see their step only, without a shuffle of their own.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last one; rows that repeat an id and size
share what they get equally, in whole words; an empty table gives an empty result; sources without words get target 0. Extra columns are kept, names
that start with ``mix_`` are used inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fieldloom.llm.common import words, written

STEPS = 1024


def lexical_quality(tokens: Column) -> Column:
    """A document's sampling weight in (0.1, 1.1]: one tenth plus the share of its words that are different."""
    return 0.1 + F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], epochs: float) -> DataFrame:
    """One row per source: source_size and target. Targets share all words by weight, none above ``epochs`` times its source's size."""
    per = sizes.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).cast("long").alias("source_size"))
    named = W.Window.orderBy(F.col("mix_source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        per.withColumn("mix_weight", F.element_at(table, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
        .withColumn("mix_cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight"))
    )
    # Sources reach their cap in the order of cap / weight. With those before it capped, a source leaves the rest this share a weight; the largest
    # of these shares is the one at which nobody is above the cap.
    order = W.Window.orderBy("mix_ratio", F.col("mix_source").asc_nulls_last())
    before, after = order.rowsBetween(W.Window.unboundedPreceding, -1), order.rowsBetween(0, W.Window.unboundedFollowing)
    whole = W.Window.orderBy(F.lit(0)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    per = per.withColumn(
        "mix_share",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / F.sum("mix_weight").over(after),
    )
    per = per.withColumn("target", F.least("mix_cap", F.max("mix_share").over(whole) * F.col("mix_weight")))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.floor(F.lit(float(epochs))))).otherwise(0)
    return per.withColumn("mix_full", full.cast("long")).select(
        "mix_source",
        "source_size",
        "target",
        "mix_full",
        F.round(F.col("target") - F.col("mix_full") * F.col("source_size")).cast("long").alias("mix_rest"),
    )


def _edge(steps: DataFrame, step: str) -> DataFrame:
    """For each source the step in which its remaining words run out, and the words left for that step (none: no such row)."""
    order = W.Window.partitionBy("mix_source").orderBy(step)
    left = F.col("mix_rest") - F.coalesce(F.sum("mix_words").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return (
        steps.withColumn("mix_left", left)
        .where((F.col("mix_left") > 0) & (F.col("mix_left") <= F.col("mix_words")))
        .select(F.col("mix_source").alias("mix_of"), F.col(step).alias(f"{step}_edge"), "mix_left")
    )


RESULTS = ("size", "source_size", "target", "taken")
OWN = "mix_own_"


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    epochs: float = 3,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes of the row, repeats counted).

    ``size`` and ``quality`` are expressions over ``docs``; ``quality`` must be positive. Weights go round over the sources in code point order. Columns of
    ``docs`` that are named like a result come back as ``mix_own_<name>``.
    """
    own = [OWN + c if c in RESULTS else c for c in docs.columns]
    rows = docs.select(*[F.col(c.removeprefix(OWN)).alias(c) for c in own], size.cast("long").alias("mix_size"), quality.cast("double").alias("mix_quality"))
    rows = rows.withColumn("mix_u", uniform(F.col(doc_id), seed)).withColumn("mix_key", -F.log("mix_u") / F.col("mix_quality"))
    place = (1 - F.exp(-F.col("mix_key"))) * STEPS
    rows = rows.withColumn("mix_step", F.least(F.floor(place), F.lit(STEPS - 1)).cast("int"))
    rows = rows.withColumn("mix_fine", F.floor((place - F.col("mix_step")) * STEPS).cast("int"))
    narrow = written(rows.select(F.col(doc_id).alias("mix_id"), F.col(source).alias("mix_source"), "mix_size", "mix_key", "mix_step", "mix_fine"), "mix")

    targets = written(source_targets(narrow, "mix_source", "mix_size", weights, epochs), "targets")
    sums = F.sum("mix_size").alias("mix_words")
    rest = targets.select(F.col("mix_source").alias("mix_of"), "mix_rest")
    same = F.col("mix_source").eqNullSafe(F.col("mix_of"))
    steps = narrow.groupBy("mix_source", "mix_step").agg(sums).join(rest, same).drop("mix_of")
    coarse = written(_edge(steps, "mix_step").withColumnRenamed("mix_left", "mix_rest"), "coarse")
    inside = narrow.join(coarse, same & (F.col("mix_step") == F.col("mix_step_edge"))).drop("mix_of", "mix_step_edge")
    fine = written(_edge(inside.groupBy("mix_source", "mix_rest", "mix_fine").agg(sums), "mix_fine"), "fine")

    edges = coarse.drop("mix_rest").join(fine.withColumnRenamed("mix_of", "mix_fine_of"), F.col("mix_of").eqNullSafe(F.col("mix_fine_of")))
    edges = edges.drop("mix_fine_of").withColumnRenamed("mix_of", "mix_edge_of")
    table = targets.withColumnRenamed("mix_source", "mix_of")
    table = written(table.join(edges, F.col("mix_of").eqNullSafe(F.col("mix_edge_of")), "left").drop("mix_edge_of"), "edges")

    here = (F.col("mix_step") == F.col("mix_step_edge")) & (F.col("mix_fine") == F.col("mix_fine_edge"))
    last = narrow.join(table, same & here).groupBy("mix_source", "mix_key", "mix_id", "mix_size", "mix_left").agg(F.count("*").alias("mix_copies"))
    order = W.Window.partitionBy("mix_source").orderBy("mix_key", "mix_id", "mix_size")
    ahead = F.coalesce(F.sum(F.col("mix_size") * F.col("mix_copies")).over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.greatest(F.col("mix_left") - ahead, F.lit(0)), F.col("mix_size") * F.col("mix_copies"))
    last = written(
        last.select(
            F.col("mix_source").alias("mix_last_of"),
            F.col("mix_id").alias("mix_last_id"),
            F.col("mix_key").alias("mix_last_key"),
            F.col("mix_size").alias("mix_last_size"),
            F.floor(part / F.col("mix_copies")).cast("long").alias("mix_part"),
        ),
        "last",
    )

    rows = rows.withColumn("mix_own", F.col(source)).join(table, F.col("mix_own").eqNullSafe(F.col("mix_of")))
    first = (F.col("mix_step") < F.col("mix_step_edge")) | ((F.col("mix_step") == F.col("mix_step_edge")) & (F.col("mix_fine") < F.col("mix_fine_edge")))
    edge = F.coalesce(here, F.lit(False))
    settled = rows.where(~edge).withColumn("mix_part", F.when(F.coalesce(first, F.lit(False)), F.col("mix_size")).otherwise(F.lit(0)).cast("long"))
    matched = F.col("mix_own").eqNullSafe(F.col("mix_last_of")) & F.col(doc_id).eqNullSafe(F.col("mix_last_id"))
    matched = matched & (F.col("mix_size") == F.col("mix_last_size")) & (F.col("mix_key") == F.col("mix_last_key"))
    open_ = rows.where(edge).join(last, matched)
    found = settled.unionByName(open_.select(settled.columns))
    taken = F.col("mix_full") * F.col("mix_size") + F.col("mix_part")
    return found.select(*own, F.col("mix_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` with the sizes in words and the lexical quality of the column ``text``."""
    docs = docs.withColumn("mix_words_of", words(F.col("text")))
    out = mix(docs, F.size("mix_words_of"), lexical_quality(F.col("mix_words_of")), **options)
    return out.drop("mix_words_of")


def repeated_documents(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: every document as often as it is taken; the copy that is taken in part keeps its first words, joined by single spaces."""
    own = [F.col(c).alias(c.removeprefix(OWN)) for c in mixed.columns if c not in RESULTS]
    rows = mixed.where(F.col("taken") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.least(F.col("size"), F.col("taken") - (F.col("mix_copy") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(words(F.col(text)), F.lit(1), left), " ")
    return rows.withColumn(text, F.when(left < F.col("size"), cut).otherwise(F.col(text))).select(own)
