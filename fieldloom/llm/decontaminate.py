"""Benchmark decontamination with DataFrame functions only: a broadcast hash set of test windows, verified hits, removal of spans or documents.

Texts are lower-cased (A-Z only) and cut into words of digits, letters a-z and anything outside ASCII. A window is ``n`` consecutive words of a benchmark
item; an item of fewer words is one window, an item without words none. Documents are scanned in their own row: the hash of every run of ``n`` words
(and of the lengths that short items have) is looked up in the set, and a hit is confirmed on the words themselves. Nothing but hits leaves a row.

The set travels with the plan, so its size is counted first; a benchmark of more than ``set_limit`` windows is met by a shuffled join on the hash instead,
with the same result.

Defined cases: a null or empty text has no words and no hits; repeated rows are judged one by one; null item ids count as an item named ``null``; with an
empty benchmark nothing is hit; extra columns are kept, names that start with ``dec_`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import written

#: Fixed by the contract of the word rule.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
CASED_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SET_LIMIT = 50_000
_NO_HITS = "array<struct<pos:int,len:int,gram:string>>"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; for pure ASCII the quicker function does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(f"[^{GAP}]+"), F.lit(0)), F.array().cast("array<string>"))


def _run(tokens: Column, at: Column, length: int) -> Column:
    return F.slice(tokens, at + 1, F.lit(length))


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """Distinct (dec_item, dec_len, dec_gram, dec_hash) of all windows."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("dec_item"), normal_words(F.col(text)).alias("dec_words"))
    items = items.where(F.size("dec_words") > 0).withColumn("dec_len", F.least(F.size("dec_words"), F.lit(n)))
    starts = F.sequence(F.lit(0), F.size("dec_words") - F.col("dec_len"))
    runs = items.select("dec_item", "dec_len", F.explode(F.transform(starts, lambda i: F.slice("dec_words", i + 1, F.col("dec_len")))).alias("dec_run"))
    return runs.select("dec_item", "dec_len", F.array_join("dec_run", " ").alias("dec_gram"), F.xxhash64("dec_run").alias("dec_hash")).distinct()


def _starts(tokens: Column, length: int) -> Column:
    return F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits_by_set(docs: DataFrame, windows: list) -> DataFrame:
    """Adds dec_hits, each hit confirmed on its words, by sets that are literals of the plan."""
    sets = [
        (length, sorted({w.dec_hash for w in windows if w.dec_len == length}), sorted({w.dec_gram for w in windows if w.dec_len == length}))
        for length in sorted({w.dec_len for w in windows})
    ]
    if not sets:
        return docs.withColumn("dec_hits", F.array().cast(_NO_HITS))
    return docs.withColumn("dec_hits", _let(F.col("dec_words"), lambda tokens: F.concat(*[_confirmed(tokens, *s) for s in sets])))


def _confirmed(tokens: Column, length: int, hashes: list[int], grams: list[str]) -> Column:
    near = F.filter(_starts(tokens, length), lambda i: F.xxhash64(_run(tokens, i, length)).isin(hashes))
    runs = F.transform(near, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(_run(tokens, i, length), " ").alias("gram")))
    return F.filter(runs, lambda h: h["gram"].isin(grams)).cast(_NO_HITS)


def _hits_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark of any size: runs of words meet the windows in a shuffled join."""
    docs = written(docs.withColumn("dec_row", F.monotonically_increasing_id()), "runs")
    runs = [
        docs.select("dec_row", F.explode(_starts(F.col("dec_words"), n)).alias("pos"), "dec_words").select(
            "dec_row", "pos", F.lit(n).alias("len"), F.xxhash64(_run(F.col("dec_words"), F.col("pos"), n)).alias("hash"),
            F.array_join(_run(F.col("dec_words"), F.col("pos"), n), " ").alias("gram"),
        )
        for n in lengths
    ]
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    grams = windows.select("dec_len", "dec_gram", "dec_hash").distinct()
    hits = every.join(grams, (F.col("hash") == F.col("dec_hash")) & (F.col("gram") == F.col("dec_gram")) & (F.col("len") == F.col("dec_len")))
    hits = hits.groupBy("dec_row").agg(F.collect_list(F.struct("pos", "len", "gram")).cast(_NO_HITS).alias("dec_hits"))
    none = F.coalesce("dec_hits", F.array().cast(_NO_HITS))
    return docs.join(hits, "dec_row", "left").withColumn("dec_hits", none).drop("dec_row")


def find_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", set_limit: int = SET_LIMIT
) -> tuple[DataFrame, DataFrame, bool]:
    """``docs`` with dec_words and dec_hits; the benchmark's windows; whether they are few enough for a broadcast."""
    windows = written(benchmark_windows(benchmark, n, item_id, item_text), "windows")
    docs = docs.withColumn("dec_words", normal_words(F.col(text)))
    small = windows.count() <= set_limit
    if small:
        return _hits_by_set(docs, windows.select("dec_len", "dec_gram", "dec_hash").distinct().collect()), windows, True
    lengths = sorted(r.dec_len for r in windows.select("dec_len").distinct().collect())  # n values at most
    return _hits_by_join(docs, windows, lengths), windows, False


def hit_positions(hits: Column) -> Column:
    """The distinct positions of words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: its words, the words hit, the items whose windows occur in it (sorted as strings), and whether it is contaminated."""
    found, windows, small = find_hits(docs, benchmark, **options)
    found = found.select(
        F.col(doc_id),
        F.size("dec_words").cast("long").alias("n_words"),
        F.size(hit_positions(F.col("dec_hits"))).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("dec_hits", lambda h: h["gram"])).alias("dec_grams"),
    )
    found = written(found.withColumn("dec_row", F.monotonically_increasing_id()), "hits")
    items = windows.select("dec_item", "dec_gram").distinct()
    rows = found.where(F.size("dec_grams") > 0).select("dec_row", F.explode("dec_grams").alias("dec_gram"))
    items = rows.join(F.broadcast(items) if small else items, "dec_gram").groupBy("dec_row").agg(F.sort_array(F.collect_set("dec_item")).alias("items"))
    out = found.join(items, "dec_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(doc_id, "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, unchanged and in their own rows: no shuffle for a benchmark within the limit."""
    columns = docs.columns
    found, _, _ = find_hits(docs, benchmark, **options)
    return found.where(F.size("dec_hits") == 0).select(columns)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; the words inside hits are cut out together with what stands before each of them."""
    columns = docs.columns
    found, _, _ = find_hits(docs, benchmark, text=text, **options)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"[{CASED_GAP}]*[^{CASED_GAP}]+"), F.lit(0))
    tail = F.regexp_extract(F.col(text), f"[{CASED_GAP}]*$", 0)
    kept = _let(hit_positions(F.col("dec_hits")), lambda at: F.filter(pieces, lambda _, i: ~F.array_contains(at, i)))
    clean = F.when(F.size("dec_hits") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(columns)
