"""The training-data operators against brute force, round trips and held-out rows, and on nulls, repeats, ties and empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, fingerprints, language, mixing, nearcopies, packing, quality, substrings, suffixes, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, most: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


def rows() -> list[tuple]:
    """Texts with near and exact copies, shared passages, nulls, empty and long texts, other alphabets; columns with names used inside."""
    passage, base = words(60, 1), words(150, 2)
    texts = [base, base, base.replace("w1 ", "x ", 2), "intro " + passage + " end one", passage.upper() + " B", words(30, 3) + " " + passage, None, "", "  \n ", "Ünï 😀 wörd"]
    texts += [words(3000, 4), passage, "one two three", "one two three", "ONE two three", words(40, 5) * 3, "a " * 900, words(200, 6)]
    return [(i if i != 9 else None, t, "en" if i % 3 else None, None if i == 4 else f"s{i % 3}", None, 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def test_best_fit_matches_a_plain_search():
    r = random.Random(0)
    for _ in range(20):
        lengths, size = [r.randint(1, 64) for _ in range(r.randint(0, 120))], 64
        left: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [c for c in left if c >= n]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - n)
            else:
                left.append(size - n)
        bins = packing.best_fit_decreasing(lengths, size)
        assert sorted(size - sum(lengths[i] for i in b) for b in bins) == sorted(left)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


def test_packing_round_trip(docs, empty):
    import tiktoken

    encode = packing.Encoder(packing.TOKENIZER)
    assert isinstance(encode.coder, tiktoken.Encoding)
    for text in ("a  b", " a", "a \n b", "x\x1cy z", "it's 12 o'clock <|endoftext|>", words(50, 9)):
        assert np.frombuffer(encode(text), encode.dtype).tolist() == encode.coder.encode_ordinary(text)
    packed = packing.pack(docs, group_tokens=5_000)
    for r in packed.collect():
        assert len(r.ids) == 2048 * 2 and r.cu_seqlens[-1] == r.n_tokens <= 2048 and r.position_resets == r.cu_seqlens[:-1]
        where = packing.position_ids(r.position_resets, r.n_tokens, 2048)
        assert all(where[a] == 0 and where[b - 1] == b - a - 1 for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    parts: dict = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.doc_start, bytes(r.ids)))
    for doc, text, *_ in rows():
        ids = np.frombuffer(b"".join(p for _, p in sorted(parts[doc])), "<u2").tolist()
        assert ids[-1] == packing.END_OF_TEXT and encode.coder.decode(ids[:-1]) == (text or "")
    assert packing.pack(empty).count() == 0


def test_packed_files(docs, tmp_path):
    packing.write_packed(packing.pack(docs), str(tmp_path / "out"))
    stored = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert {"ids", "cu_seqlens", "position_ids"} <= set(stored.columns)
    assert all(len(r.position_ids) == 4 * 2048 for r in stored.collect())


def link(sets: dict, percent: int) -> dict:
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies(spark, docs, empty, size):
    base = words(300, 20, 5000).split()
    r = random.Random(4)
    near = []
    for i in range(60):  # a chain of copies, each a few words away from the one before
        for _ in range(3):
            base[r.randrange(len(base))] = f"n{i}"
        near.append((100 + i, " ".join(base), "en", "s", None, 1, "x"))
    full = docs.where("doc_id is not null").union(spark.createDataFrame(near, SCHEMA))
    sets = {}
    for row in full.collect():
        w = WORD.findall((row.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[row.doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    got, want = by_id(nearcopies.near_copies(full, size)), link(sets, 80)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)
    named = docs.where("doc_id is not null")
    own = link({r.doc_id: sets[r.doc_id] for r in named.collect()}, 80)
    kept = nearcopies.keep_one(named, size)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in own.items() if i == c}
    assert nearcopies.near_copies(empty, size).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    one, two, three = words(80, 31), words(80, 32), words(80, 33)
    table = [(3, one), (5, one), (5, two), (7, two + " tail"), (8, three), (8, three), (8, three.upper()), (9, None), (9, None), (None, words(80, 34)), (None, words(80, 35))]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, "x") for i, t in table], SCHEMA).repartition(3)
    kept = nearcopies.keep_one(docs, 5)
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == Counter({(3, one): 1, (5, two): 1, (8, three): 1, (9, ""): 2, (None, table[-2][1]): 1, (None, table[-1][1]): 1})
    assert Counter((r.doc_id, r.component_id, r.kept) for r in nearcopies.near_copies(docs, 5).collect() if r.doc_id in (3, 5, 7)) == Counter(
        {(3, 3, True): 1, (5, 3, False): 1, (5, 5, True): 1, (7, 5, False): 1}
    )


def test_estimate_of_registers():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        members = r.integers(0, 1 << 63, 6000, dtype=np.uint64) * 2
        both = int(share * 4000)
        a, b = np.sort(members[:4000]), np.sort(np.concatenate([members[:both], members[4000 : 8000 - both]]))
        true = both / (len(a) + len(b) - both)
        n = np.array([len(a)]), np.array([len(b)])
        _, estimate = nearcopies.likely(nearcopies.registers(a)[None], nearcopies.registers(b)[None], *n, 0.8)
        assert abs(estimate[0] - true) < 0.2


def brute_words(table: list, window: int) -> dict:
    seen, out = set(), {}
    for i, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [9, 20, 45])
def test_substring_dedup(docs, empty, window):
    got, want = by_id(substrings.drop_repeats(docs, window)), brute_words([(r[0], r[1]) for r in rows()], window)
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == want
    assert substrings.drop_repeats(empty, window).count() == 0


@pytest.mark.parametrize("period", [3, 7, 13, 31, 57])
def test_covers(period):
    cover = set(substrings.COVERS[period])
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize("hot", [2_000, 1])
def test_suffix_dedup(docs, empty, hot):
    width = 120
    table = [(r[0], (r[1] or "").encode()) for r in rows()]
    starts = Counter(b[p : p + width] for _, b in table for p in range(len(b) - width + 1))
    got = by_id(suffixes.remove_repeats(docs, width, hot=hot))
    for i, b in table:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if starts[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        want = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone) if not y))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want
    assert suffixes.remove_repeats(empty, width).count() == 0


def test_suffix_order():
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(600))
    buffer = np.frombuffer(text, np.uint8)
    starts = np.array([r.randrange(590) for _ in range(80)])
    groups = np.sort(np.array([r.randrange(4) for _ in range(80)]))
    order, common = suffixes.sorted_sides(buffer, starts, 600 - starts, groups)
    tails = [(int(groups[i]), text[starts[i] :]) for i in order]
    assert tails == sorted(tails)
    for k in range(1, 80):
        if groups[order[k]] == groups[order[k - 1]]:
            a, b = tails[k - 1][1], tails[k][1]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == n


def test_mix_meets_targets(spark, docs, empty):
    full = docs.union(spark.createDataFrame([(100 + i, words(5 + i % 7, i), "en", f"s{i % 3}", None, 1, "x") for i in range(300)], SCHEMA))
    mixed = mixing.mix_documents(full)
    got = mixed.collect()
    assert len(got) == full.count() and [r.taken for r in got] is not None
    per: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        entry = per.setdefault(r.source, [0, r.target, r.source_size, 0])
        entry[0] += r.taken
        entry[3] += r["size"]
    assert all(abs(t - target) <= 1 and size == total for t, target, size, total in per.values())
    assert abs(sum(e[1] for e in per.values()) - sum(e[3] for e in per.values())) < 1e-6
    again = {r.doc_id: r.taken for r in mixing.mix_documents(full.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    text = mixing.repeated_documents(mixed)
    assert text.columns == full.columns and {r["size"] for r in text.collect()} == {"x"}
    assert sum(len(WORD.findall(r.text)) for r in text.collect()) == sum(r.taken for r in got)
    assert mixing.mix_documents(empty).count() == 0


def test_repeated_rows_share_what_they_get(spark):
    table = spark.createDataFrame([(1, "a b c d", "s")] * 40 + [(2, "x y", "t")], "doc_id bigint, text string, source string")
    got = mixing.mix_documents(table).collect()
    assert len(got) == 41 and len({r.taken for r in got if r.doc_id == 1}) == 1


def test_winnowing(docs, empty):
    out = by_id(fingerprints.edited_pairs(docs).withColumn("fp", fingerprints.written_out(F.col("entries"))).withColumn("efp", fingerprints.written_out(F.col("edited_entries"))))
    table = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t for _, t in table]
    edited = [t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3] for i, t in enumerate(texts)]
    k, w = fingerprints.K, fingerprints.WINDOW
    grams = {s[j : j + k] for s in texts + edited for j in range(max(1, len(s) - k + 1))}
    frame = docs.sparkSession.createDataFrame([(g,) for g in grams], "g string")
    hashes = {r.g: r.h for r in frame.select("g", F.xxhash64("g").bitwiseAND(F.lit((1 << 31) - 1)).alias("h")).collect()}

    def plain(s: str) -> str:
        if not s:
            return ""
        h = [hashes[s[j : j + k]] for j in range(max(1, len(s) - k + 1))]
        kept = set()
        for a in range(max(1, len(h) - w + 1)):
            least = min(h[a : a + w])
            kept.add(max(j for j in range(a, min(len(h), a + w)) if h[j] == least))
        return " ".join(f"{h[j]:08x}:{j}" for j in sorted(kept))

    for (i, text), e in zip(table, edited):
        assert (out[i].edited, out[i].n_chars) == (e, len(text))
        assert out[i].fp == plain(text) and out[i].efp == plain(e)
    assert fingerprints.edited_pairs(empty).count() == 0


def test_ranges_of_keys(spark):
    r = random.Random(11)
    firsts = sorted({(r.randrange(40), r.randrange(-50, 50)) for _ in range(150)}, reverse=True)
    keys = [*firsts, *((r.randrange(firsts[0][0]), r.randrange(-50, 50)) for _ in range(200))]
    table = spark.createDataFrame([k for k in keys if k <= firsts[0]], "k bigint, h bigint")
    got = table.select("k", "h", fingerprints._range_of(firsts, F.struct("k", "h"), 7).alias("at")).collect()
    assert all(x.at == sum(f >= (x.k, x.h) for f in firsts) - 1 for x in got)


def test_repeated_documents_have_equal_fingerprints(spark):
    table = spark.createDataFrame([(1, words(80, 1)), (1, words(80, 1)), (1, "other"), (2, words(80, 1))], "doc_id bigint, text string")
    got = fingerprints.edited_pairs(table).collect()
    assert len(got) == 4 and len({str(r.entries) for r in got if r.n_chars > 5}) == 1


@pytest.mark.parametrize("limit", [50_000, 0])
def test_contamination(spark, docs, empty, limit):
    items = spark.createDataFrame([(1, words(60, 1)), (2, "Two Three!"), (3, None), (4, ""), (5, words(60, 1).upper())], "item_id bigint, text string")
    got = by_id(decontaminate.contamination(docs, items, set_limit=limit))
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = {}
    for r in items.collect():
        w = split.findall((r.text or "").translate(low))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(r.item_id))
    for i, text, *_ in rows():
        w = split.findall((text or "").translate(low))
        hit, found = set(), set()
        for p in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[p : p + n]) in windows and p + n <= len(w):
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))
    kept = decontaminate.drop_contaminated(docs, items, set_limit=limit)
    assert kept.columns == docs.columns and kept.count() == sum(r.n_hit == 0 for r in got.values())
    cut = decontaminate.cut_contaminated(docs, items, set_limit=limit)
    assert decontaminate.contamination(cut, items.where("item_id != 2")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def labelled(spark, n: int = 400):
    r = random.Random(8)
    text, marks = [], []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        body = [r.choice(("the", "and", "with", "this") if lang == "en" else ("der", "und", "mit", "dies")) + r.choice(("ing", "ly", "er")) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            body[r.randrange(40)] = "vile"
        text.append((i, " ".join(body), lang, "s", None, 1, "x"))
        marks.append((i, int(i % 4 != 0), int(bad)))
        if i % 4 == 0:
            text[-1] = (i, text[-1][1].upper() + "!!", *text[-1][2:])
    return spark.createDataFrame(text, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_classifiers(spark, docs, empty):
    text, marks = labelled(spark)
    held = F.col("doc_id") % 3 == 0
    net = toxicity.fit(text, marks, learn=~held)
    p = toxicity.score(text.where(held), net).join(marks, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in p]) > 0.95
    model = quality.fit(text, marks, learn=~held)
    p = quality.score(text.where(held), model).join(marks, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in p]) > 0.95
    tongue = language.fit(text, learn=~held)
    p = language.identify(text.where(held), tongue).collect()
    assert np.mean([r.lang == r.lang_pred for r in p]) > 0.95
    for scored in (toxicity.score(docs, net), quality.score(docs, model), language.identify(docs, tongue)):
        got = scored.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = by_id(language.identify(docs, tongue))
    assert all(blank[i].lang_pred == "und" and blank[i].rejected for i in (6, 7, 8))
    kept = language.keep_identified(docs, tongue)
    assert kept.columns == docs.columns and {6, 7, 8}.isdisjoint(r.doc_id for r in kept.collect())
    assert toxicity.score(empty, net).count() == quality.score(empty, model).count() == language.identify(empty, tongue).count() == 0
    assert quality.fit(empty, marks) == 0.5 or isinstance(quality.fit(empty, marks), float)
    assert language.fit(empty) is None and language.identify(docs, None).where("lang_pred = 'und'").count() == docs.count()


def test_samples_are_cut_before_the_driver(spark, monkeypatch):
    """Rows without an id, or with one id, do not come to the driver together."""
    text = [(None if i % 2 else 7, words(12, i), ("en", "de")[i % 4 // 2], "s", None, 1, "x") for i in range(1200)]
    docs = spark.createDataFrame(text, SCHEMA).repartition(5)
    marks = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, quality int")
    kind, seen = type(docs), []
    plain = kind.collect

    def counted(self):
        seen.append(plain(self))
        return seen[-1]

    monkeypatch.setattr(kind, "collect", counted)
    sample = language.sample_by_label(docs.select(F.col("lang").alias("label"), "text", F.col("doc_id").alias("id")), 20)
    assert Counter(r["label"] for r in sample) == {"en": 20, "de": 20}
    assert {r["id"] for r in sample} == {None, 7}
    found, _ = quality.sampled(docs, marks, "quality", F.lit(True), 20)
    assert len(found) == 20 and {r["id"] for r in found} == {7}
    assert max(map(len, seen)) <= 40


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    text, _ = labelled(spark, 200)
    text = text.drop("part", "size")
    text.withColumn("text", F.concat("text", F.lit(" "), F.sha2(F.col("doc_id").cast("string"), 256))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words(60, 1))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_toxicity_thresholds_come_from_all_rows_not_trained_on(spark):
    """Of 600 labelled rows 96 train the network; each language's threshold is the lowest score of the others with the wanted precision."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        bad = rng.choice(["vile", "scum"]) if rng.random() < (0.9 if toxic else 0.04) else "calm"
        rows.append((i, " ".join([*rng.choice(["sun", "rain", "tree", "road", "lake"], 12), bad]), ["en", "de", None][i % 3], toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").cache()
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int").cache()
    sample, counts = quality.sampled(docs, labels, "toxic", F.lit(True), 60)
    assert len(sample) == 120
    net = toxicity.fit(docs, labels, fit_rows=60, precision=0.8)
    order = np.random.default_rng(3).permutation(len(sample))
    trained = {sample[i]["id"] for k, i in enumerate(order) if k % 5}
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    others = [(lang, score[i], toxic) for i, _, lang, toxic in rows if i not in trained]
    assert len(trained) == 96 and set(net.thresholds) == {"en", "de", None}
    weight = {k: counts[k] / sum(1 for *_, toxic in others if toxic == k) for k in (0, 1)}
    for lang, limit in net.thresholds.items():
        mine = [(s, toxic) for where, s, toxic in others if where == lang]
        good = []
        for s, _ in mine:
            hits, misses = (sum(weight[k] for p, toxic in mine if p >= s and toxic == k) for k in (1, 0))
            if hits >= 0.8 * (hits + misses):
                good.append(s)
        assert limit == pytest.approx(min(good), abs=1e-12)
