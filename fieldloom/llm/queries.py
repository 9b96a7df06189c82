"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, dialogues, filters, fingerprints, language, mixing, nearcopies, packing, pieces, quality, substrings, suffixes, toxicity
from fieldloom.llm.common import fold, words, written
from fieldloom.llm.sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1)
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), net)
    marked = toxicity.flagged(scored, net)
    return marked.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, learn=fold("doc_id", 4) != 2)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("tokens"))
    sizes = tokens.select("doc_id", "source", F.size("tokens").alias("n"), mixing.lexical_quality(F.col("tokens")).alias("quality"))
    mixed = mixing.mix(written(sizes, "sizes"), F.col("n"), F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.written_out(F.col("entries")).alias("fingerprint"),
        fingerprints.written_out(F.col("edited_entries")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        fingerprints.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op11_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    both = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, round_trip=True)
    written_ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written_ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    plan, repaired = dialogues.repair(dialogues.damaged(turns))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(plan, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    digest = dialogues.digests(repaired)
    found = found.join(digest, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    totals = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(F.col("id").alias("conv_id"), *totals, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_tokens": op1_pack_tokens,
    "op2_near_copies": op2_near_copies,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language": op6_language,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_fingerprints": op9_fingerprints,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_piece_ids": op11_piece_ids,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLES: dict[str, str] = {name: text for name, text in SQL.items() if name in QUERIES}
