"""N-gram join and substring dedup against brute force; the pipeline end to end."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tomewise.llm import ngram_join, quality, substring_dedup
from tomewise.llm.common import utf8
from tomewise.llm.components import components
from tomewise.llm.queries import bpe_digests, table, tokenizer_path

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_rows(docs):
    """(class_id, n_links) of each row, and whether it stays; ids may repeat or be null."""
    sets, up, links = [shingles(t) for _, t in docs], list(range(len(docs))), [0] * len(docs)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[top(i)].append(d)
    return [(min(ids[top(i)], default=None), links[i]) for i in range(len(docs))]


def brute_classes(docs):
    return {d: r for (d, _), r in zip(docs, brute_rows(docs), strict=True)}


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "日本"]
    docs, d = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(6, 150))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((d, rng.choice([" ", ", "]).join(words)))
            d += 1
    return [*docs, (900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two"), (905, "two one"), (906, "x " * 4000)]


def test_join_equals_brute_force(spark, monkeypatch):
    docs = near_copies()
    frame = spark.createDataFrame(docs, DOC).withColumn("rep", F.lit(1)).withColumn("cluster", F.lit("c"))
    want = brute_classes(docs)
    small = {"LEAST": 3, "SPREAD": 90, "LEAST_SETS": 2, "SPREAD_SETS": 90, "BROADCAST_IDS": 0, "_SLAB": 7, "_CHUNK": 5}
    for change in ({}, small, {"BLOCK_BYTES": 4000}):  # whole groups, then many blocks and no broadcast, then blocks cut by bytes
        for name, value in change.items():
            monkeypatch.setattr(ngram_join, name, value)
        got = ngram_join.similarity_classes(frame).collect()
        assert len(got) == len(docs)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    kept = ngram_join.keep_one_per_class(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (c, _) in want.items() if c == d}


def test_join_of_odd_tables(spark):
    assert ngram_join.similarity_classes(spark.createDataFrame([], DOC)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, None), (None, "lone")], DOC)
    got = ngram_join.similarity_classes(same).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3), (None, None, 0), (None, None, 0)]
    assert ngram_join.keep_one_per_class(same).count() == 5


def test_join_of_repeated_and_null_ids(spark, monkeypatch):
    for seed in (1, 2):
        rng = random.Random(seed)
        docs = [(rng.choice([None, *range(25)]), t) for _, t in near_copies(seed)]
        docs += rng.choices(docs, k=15)
        got = ngram_join.similarity_classes(spark.createDataFrame(docs, DOC)).collect()
        want = [(d, c if t and shingles(t) else d, n) for (d, t), (c, n) in zip(docs, brute_rows(docs), strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)


def test_rows_are_dropped_by_id_and_text(spark):
    base = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, base), (2, base + " ee"), (1, "something else altogether that nobody repeats here")], DOC)
    got = sorted(map(tuple, ngram_join.similarity_classes(docs).collect()))
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]
    assert sorted(r["text"] for r in ngram_join.keep_one_per_class(docs).collect()) == sorted([base, "something else altogether that nobody repeats here"])
    # One id over both sides of a link: one text stays.
    docs = spark.createDataFrame([(1, base), (1, base + " ee"), (None, base + " ff")], DOC)
    assert [r["n_links"] for r in ngram_join.similarity_classes(docs).collect()] == [2, 2, 2]
    assert ngram_join.keep_one_per_class(docs).count() == 2


def test_recall(spark):
    """Links found among links there are, over random texts whose similarities lie around the threshold."""
    rng, docs = random.Random(6), []
    for k in range(100):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(30, 200))]
        for c in range(5):
            words = list(base)
            for at in rng.sample(range(len(words)), k=len(words) * c // 110 + c % 2):
                words[at] = f"u{rng.randrange(10**6)}"
            docs.append((5 * k + c, " ".join(words)))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.similarity_classes(spark.createDataFrame(docs, DOC)).collect()}
    want = {d: n for d, (_, n) in brute_classes(docs).items()}
    assert all(got[d] <= want[d] for d in want)
    assert 400 < sum(want.values()) < 1900 and sum(got.values()) >= 0.99 * sum(want.values())


def test_pruning_bounds():
    least = ngram_join.least_matches()
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * ngram_join.HASHES
    rng = np.random.default_rng(1)  # pairs at the threshold survive
    matches = np.cumsum(rng.random((200_000, ngram_join.HASHES)) < 0.8, 1)[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (matches >= least).all(1).mean() > 1 - 1e-4


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_chunks(raw):
    h, start, out = 0, 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF
        last = i + 1 == len(raw)
        if last or (h < 65536 // substring_dedup.MEAN and raw[i + 1] & 0xC0 != 0x80):
            while i + 1 - start > substring_dedup.LONGEST:
                at = start + substring_dedup.LONGEST
                while raw[at] & 0xC0 == 0x80:
                    at -= 1
                out.append((start, at - start))
                start = at
            out.append((start, i + 1 - start))
            start = i + 1
    return out


def test_chunks_equal_a_plain_rolling_hash():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdé 日\n", k=rng.randint(0, 900))) for _ in range(30)] + ["", "z" * 5000, "é" * 4000, "x"]
    data, offsets = utf8(pa.array(texts))
    text, start, size, digest = substring_dedup.chunks(data, offsets)
    got = defaultdict(list)
    for t, a, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True):
        got[t].append((a, n))
    by_digest = defaultdict(set)
    for k, t in enumerate(texts):
        assert got[k] == plain_chunks(t.encode()) or len(t) > 3000
        assert sum(n for _, n in got[k]) == len(t.encode())
    for t, a, n, d in zip(text.tolist(), start.tolist(), size.tolist(), digest.tolist(), strict=True):
        by_digest[d].add(texts[t].encode()[a : a + n])
        texts[t].encode()[a : a + n].decode()  # no character is split
    assert all(len(v) == 1 for v in by_digest.values())


def test_repeats_are_found_and_cut(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(12)]
    docs, has = [], defaultdict(set)
    for d in range(80):
        parts = [prose(rng.randint(5, 80))]
        if d % 2 == 0:
            p = rng.randrange(12)
            parts += [passages[p], prose(rng.randint(1, 30))]
            has[p].add(d)
        docs.append((d, " ".join(parts)))
    planted = {d for ds in has.values() if len(ds) > 1 for d in ds}
    frame = spark.createDataFrame([*docs, (500, None), (501, ""), (None, docs[0][1]), (502, "short"), (503, "short")], DOC).withColumn("start", F.lit(1)).withColumn("spans", F.lit(1))
    found = substring_dedup.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in found} == planted
    text = dict(docs)
    for r in found:
        assert any(text[r["doc_id"]].encode()[r["start"] + 30 : r["stop"] - 30].decode(errors="ignore") in p for p in passages)
    cut = substring_dedup.remove_repeats(frame)
    assert cut.columns == frame.columns and cut.count() == 85
    after = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] is not None}
    for p, ds in has.items():
        kept = sorted(ds)[0]
        assert after[kept] == text[kept] or kept not in planted
        for d in sorted(ds)[1:]:
            assert len(after[d]) < len(text[d]) - 150
    assert after[500] is None
    assert substring_dedup.repeated_passages(frame.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = model.score(quality.features(pa.array([t for _, t in docs])))
    docs = [x for x, s in zip(docs, score, strict=True) if s >= 0.5]
    last = {}
    for d, t in docs:
        last[t or ""] = max(d, last.get(t or "", -1))
    docs = [(d, t) for d, t in docs if last[t or ""] == d]
    classes = brute_classes(docs)
    docs = [(d, t) for d, t in docs if classes[d][0] == d]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    runs = {tuple(w[k : k + 10]) for r in table(spark, SF, "benchmark").collect() if (w := words(r["text"])) for k in range(max(1, len(w) - 9))}
    sizes = {len(r) for r in runs}
    clean = lambda t: not any(tuple(w[k : k + n]) in runs for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    docs = [(d, t) for d, t in docs if clean(t)]
    want = bpe_digests(spark.createDataFrame(docs, DOC), tokenizer_path()).collect()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 0 < len(got) < 200
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_shared_runs_without_hash_cuts_are_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghé日", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    # The least that 51 words take, one word repeated, and characters of several bytes, each in two documents after texts of any length.
    runs = [" ".join(rng.choices("abcdefgh", k=51)) for _ in range(40)] + ["tok " * 60, "zz " * 51, "日 " * 51, "é" * 60]
    docs = [(2 * k + side, f"{prose(rng.randint(1, 40))}|{run}|{prose(rng.randint(1, 40))}") for k, run in enumerate(runs) for side in (0, 1)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(docs, DOC)).collect()
    text, by = {d: t.encode() for d, t in docs}, defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["start"], r["stop"]))
        assert text[r["doc_id"]][r["start"] : r["stop"]].decode() in text[r["doc_id"] ^ 1].decode()
    for d, raw in text.items():
        at = raw.index(b"|")
        assert any(a < raw.index(b"|", at + 1) and b > at for a, b in by[d]), d
    after = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, DOC)).collect()}
    assert all(after[d] == t if d % 2 == 0 else len(after[d].encode()) <= len(t.encode()) - 90 for d, t in docs)


def test_bits_of_different_documents_are_no_passage(spark):
    rng = random.Random(13)
    bits = ["".join(rng.choices("abcdefgh ", k=45)) for _ in range(40)]
    docs = [(k, "".join(rng.choices("ijklmnop ", k=200)) + bit) for k, bit in enumerate(bits)] + [(100, "".join(bits))]
    assert substring_dedup.repeated_passages(spark.createDataFrame(docs, DOC)).count() == 0
    # Overlapping units of two documents, none of them of 90 bytes.
    whole = "".join(rng.choices("abcdefgh ", k=130))
    docs = [(1, whole[:85] + "x" * 50), (2, "y" * 50 + whole[46:]), (3, whole)]
    assert substring_dedup.repeated_passages(spark.createDataFrame(docs, DOC)).count() == 0


def plain_units(raw):
    """(start, stop) of each unit, from the definition: anchors are least hashes of all stretches of ``WINDOW`` places."""
    def key(p):
        h = 0
        for b in raw[p : p + substring_dedup.GRAM]:
            h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF
        return h

    ok = [p + substring_dedup.GRAM <= len(raw) and raw[p] & 0xC0 != 0x80 for p in range(len(raw))]
    hashes = [key(p) if good else None for p, good in enumerate(ok)]
    anchors = set()
    for w in range(len(raw) - substring_dedup.WINDOW + 1):
        if places := [p for p in range(w, w + substring_dedup.WINDOW) if ok[p]]:
            anchors.add(min(places, key=lambda p: (hashes[p], p)))
    return [(a, whole(raw, a + substring_dedup.UNIT, -1)) for a in sorted(anchors) if a + substring_dedup.UNIT <= len(raw)]


def whole(raw, at, step):
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def plain_runs(ranges):
    """Overlapping or touching (start, stop, ...) in runs."""
    out = []
    for r in sorted(ranges):
        if out and r[0] <= max(x[1] for x in out[-1]):
            out[-1].append(r)
        else:
            out.append([r])
    return out


def owners(found):
    """Contents that several documents have, with the smallest of these."""
    ids = defaultdict(set)
    for d, content in found:
        ids[content].add(d)
    return {content: min(ds) for content, ds in ids.items() if len(ds) > 1}


def plain_passages(docs, least=substring_dedup.LEAST):
    text = {d: t.encode() for d, t in docs}
    units = [(d, a, b, text[d][a:b]) for d in text for a, b in plain_units(text[d])]
    keep = owners((d, content) for d, _, _, content in units)
    known, short = defaultdict(list), set()
    for d in text:
        for run in plain_runs({(a, b, content) for x, a, b, content in units if x == d and content in keep}):
            if max(r[1] for r in run) - run[0][0] >= 2 * least:
                known[d] += [(a, b, keep[content]) for a, b, content in run]
            else:
                short |= {content for _, _, content in run}
    windows = []
    for d, raw in text.items():
        near = {p for x, a, b, content in units if x == d and content in short for p in range(max(0, a - substring_dedup.WINDOW), b - substring_dedup.UNIT + 4)}
        for p in sorted(near):
            word = lambda q: bool(substring_dedup.WORD_BYTE[raw[q]])
            if p < len(raw) and word(p) and (p == 0 or not word(p - 1)) and (stop := whole(raw, p + least, 1)) <= len(raw):
                windows.append((d, p, stop, raw[p:stop]))
    keep = owners((d, content) for d, _, _, content in windows)
    for d, a, b, content in windows:
        if content in keep:
            known[d].append((a, b, keep[content]))
    out = []
    for d, ranges in known.items():
        for run in plain_runs(ranges):
            start, stop = run[0][0], max(r[1] for r in run)
            if stop - start >= least:
                out.append((d, start, stop, len({p for a, b, k in run if k < d for p in range(a, b)}), min(r[2] for r in run)))
    return sorted(out)


def test_passages_equal_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghéß日", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(12, 60)) for _ in range(8)]
    docs = [(d, " ".join(x for _ in range(rng.randint(1, 4)) for x in (prose(rng.randint(1, 25)), rng.choice(shared)[rng.randint(0, 40) :]))) for d in range(40)]
    docs += [(100, docs[3][1]), (101, prose(30)), (102, "short"), (103, "")]
    got = sorted((r["doc_id"], r["start"], r["stop"], r["removable_bytes"], r["keep_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, DOC)).collect())
    assert got == plain_passages(docs) and len(got) > 40


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs = table(spark, SF, "documents")
    good = [r["text"] for r in docs.orderBy(F.length("text").desc()).limit(3).collect()]
    rows = [(1, good[0], "x"), (1, good[1], "x"), (7, good[0], "x"), (None, good[2], None), (None, None, None), (8, "", "x"), (9, None, "x"), (3, good[1] + " more", "x"), (3, good[1] + " more", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("spans", F.lit(1)).withColumn("T1", F.lit("t")).withColumn("size", F.lit(2))
    for name, documents in (("odd", odd), ("empty", odd.limit(0))):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    stages, kept = corpus_pipeline.STAGES, odd
    for _, stage in stages[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/odd")
        assert kept.columns == odd.columns
    # Equal texts: the largest id. Near copies: the smallest id. Rows without id stay, empty texts are one text.
    want = sorted([(1, good[1]), (7, good[0]), (9, None), (None, good[2]), (None, None)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()) == [0, 0, 1, 7, 9]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
