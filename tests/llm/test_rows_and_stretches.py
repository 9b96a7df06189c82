"""Rows that share an id, null ids included, and texts across the stretches in which they are worked on, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import mixing, nearcopies, packing, quality, substrings, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, most: int = 500) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


def shared() -> list[tuple]:
    a, b, c = words(120, 1), words(90, 2), words(60, 3)
    rows = [(1, a), (None, b + " " + a), (None, "hello world"), (None, c + " unique tail " + words(70, 4)), (None, c + " other tail " + words(70, 5))]
    rows += [(7, b), (7, b), (7, words(80, 6)), (8, words(80, 6)[:300]), (9, a[:250] + " x " + b[:250]), (None, "hello world"), (3, None), (3, ""), (4, "é" * 500), (5, "é" * 300)]
    rows += [(None, words(40, 100 + i)) for i in range(60)]
    return [(i, t) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "x", "y") for i, t in rows], "doc_id bigint, text string, doc bigint, tie string, part string").repartition(3)


def plain_bytes(rows: list[tuple], width: int) -> Counter:
    table = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[p : p + width] for _, b in table for p in range(len(b) - width + 1))
    out = Counter()
    for i, b in table:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if starts[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone) if not y)] += 1
    return out


@pytest.mark.parametrize("hot, stretch", [(2_000, 1 << 18), (1, 1 << 18), (2_000, 257)])
def test_suffix_dedup_of_shared_ids(spark, hot, stretch):
    rows = shared()
    got = suffixes.remove_repeats(frame(spark, rows), 120, hot=hot, stretch=stretch).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_bytes(rows, 120)


def hashes(spark, rows) -> dict:
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t or "",) for _, t in rows], "t string")
    return {r.t: r.h for r in texts.select("t", F.xxhash64(F.col("t").cast("binary")).alias("h")).collect()}


def plain_words(rows: list[tuple], window: int, tie: dict) -> Counter:
    """Rows in the order of id (null first), then of their texts' hashes; rows that repeat id and text get the same."""
    seen, done, out = set(), {}, Counter()
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        done[i, text] = (i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    for i, t in rows:
        out[done[i, t or ""]] += 1
    return out


@pytest.mark.parametrize("window, stretch", [(20, 2 << 20), (9, 97)])
def test_substring_dedup_of_shared_ids(spark, window, stretch):
    rows = shared()
    got = substrings.drop_repeats(frame(spark, rows), window, stretch=stretch).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain_words(rows, window, hashes(spark, rows))


def test_null_ids_are_spread(spark):
    rows = [(None, words(30, i)) for i in range(300)]
    parts = substrings.dealt(frame(spark, rows), "doc_id", "text", 16).groupBy("part").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 60


def test_long_words_with_equal_polynomials():
    """Thue-Morse words of 2,048 letters and their complements, whose polynomial hashes modulo 2**64 are equal for any base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    found, starts, ends = substrings.Words()(f"{one} {two} {one} short".encode())
    assert found[0] == found[2] != found[1] and len(set(found.tolist())) == 3 and list(ends - starts) == [2048, 2048, 2048, 5]


def test_contexts_compare_like_their_bytes():
    r = random.Random(12)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) for _ in range(200)]
    sizes = np.array([len(t) for t in texts])
    begin, depth = np.cumsum(sizes) - sizes, np.array([r.randrange(len(t)) for t in texts])
    groups = np.sort(np.array([r.randrange(5) for _ in texts]))
    order, common = suffixes.sorted_sides(np.frombuffer(b"".join(texts), np.uint8), begin + depth, sizes - depth, groups, sizes)
    tails = [(int(groups[i]), texts[i][depth[i] :]) for i in order]
    assert tails == sorted(tails)
    for k in range(1, len(tails)):
        if tails[k][0] == tails[k - 1][0]:
            a, b = tails[k - 1][1], tails[k][1]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [64, 512, 2048])
def test_rows_of_any_length_unpack(spark, tmp_path, length):
    texts = [(i, words(5 + 90 * i, i)) for i in range(12)] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    packed = packing.pack(docs, length=length)
    encode = packing.Encoder(packing.TOKENIZER)
    parts: dict = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.doc_start, bytes(r.ids)))
    for i, text in texts:
        ids = np.frombuffer(b"".join(p for _, p in sorted(parts[i])), "<u2").tolist()
        assert ids[-1] == packing.END_OF_TEXT and encode.coder.decode(ids[:-1]) == (text or "")
    packing.write_packed(packed, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(len(r.position_ids) == 4 * length and len(r.ids) == 2 * length for r in stored)


def test_columns_named_like_ours(spark):
    names = ["id", "label", "dup_id", "dup_body", "own_id", "row", "size", "target", "source_size", "taken", "score", "node", "lang"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, words(40, i % 9), f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(i, i % 2, i % 2, i) for i in range(30)], "doc_id bigint, quality int, toxic int, id int")
    kept = nearcopies.keep_one(docs, 5).collect()
    assert len(kept) == 9 and all(r.dup_id == f"dup_id{r.doc_id}" and r.row == f"row{r.doc_id}" for r in kept)
    mixed = mixing.repeated_documents(mixing.mix_documents(docs))
    assert mixed.columns == docs.columns and all(r["target"] == f"target{r.doc_id}" for r in mixed.collect())
    assert quality.score(docs, quality.fit(docs, marks)).where("score between 0 and 1").count() == 30
    assert toxicity.score(docs, toxicity.fit(docs, marks)).where("score between 0 and 1").count() == 30
