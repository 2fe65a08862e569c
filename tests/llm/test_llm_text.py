"""Decontamination, BPE, token counts and exact dedup against brute force and the tokenizers library."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomewise.llm import bpe, decontaminate, exact_dedup, token_counts
from tomewise.llm.pretokens import load_vocabulary
from tomewise.llm.queries import OP1_SQL, op5_bpe_encode_decode, op8_token_counts, table, tokenizer_path

DOC = "doc_id long, text string"


def tokens_of(texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def odd_texts(n=150, seed=3):
    rng = random.Random(seed)
    parts = [*"ab 's\n\t\x85\xa0　\x1c١é日ß​\U0001f600\r﻿²Ⅷ.,!", "<|endoftext|>", "'ve", "   ", "the ", "Tion", "1234"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)] + ["a" * 1500 + "é" * 700, "", "xyzth" * 500]


def test_bpe_and_counts_equal_the_library(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (0, texts[0])], DOC).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    want = dict(enumerate(tokens_of(texts))) | {-1: []}
    rows = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        assert r["text"] == (texts[r["doc_id"]] if r["doc_id"] >= 0 else "")
    counted = token_counts.token_counts(docs, tokenizer_path(), limit=100).collect()
    for r in counted:
        assert r["n_tokens"] == len(want[r["doc_id"]]) and r["over_limit"] == (r["n_tokens"] > 100)
        assert r["n_bytes"] == (len(texts[r["doc_id"]].encode()) if r["doc_id"] >= 0 else 0)


def test_bpe_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert bpe.decode(bpe.encode(none, tokenizer_path()), tokenizer_path()).count() == 0
    assert token_counts.token_counts(none, tokenizer_path()).count() == 0


def test_unknown_ids_and_broken_bytes():
    v = load_vocabulary(tokenizer_path())
    with pytest.raises(KeyError):
        bpe.decode_ids([10**6], v)
    assert bpe.decode_ids([v.byte_ids[0xE9]], v) == "�"


def test_heap_and_rank_array_agree():
    v, rng = load_vocabulary(tokenizer_path()), random.Random(8)
    for _ in range(300):
        word = bytes(rng.choices(b"theinga \xc3\xa9", k=rng.randint(1, 40)))
        assert len(bpe.merge_word(word, v)) == token_counts.merged_count(word, v)


def brute_windows(docs, items, size=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    wins = []
    for item, text in items:
        w = words(text)
        wins += [(item, w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture
def contaminated():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gámma", "de", "e1", "zeta", "日本", "x"]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([12, 10, 3, 25, 11, 1])] + [(6, None), (7, "..."), (8, "alpha Beta, gámma")]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 30))
        if d % 3 == 0:
            text[2:2] = [items[rng.randrange(5)][1].upper().replace("Á", "á")]
        docs.append((d, "; ".join(text)))
    return [*docs, (100, None), (101, ""), (102, items[0][1])], items


def test_decontamination_equals_brute_force(spark, contaminated, monkeypatch):
    docs, items = contaminated
    frame = spark.createDataFrame(docs, DOC).withColumn("items", F.lit(1)).withColumn("n_words", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(docs, items)
    for nodes in (decontaminate.NODES, 150):  # one automaton, then several passes
        monkeypatch.setattr(decontaminate, "NODES", nodes)
        got = {r["doc_id"]: r for r in decontaminate.scan(frame, bench).collect()}
        assert {d: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for d, r in got.items()} == want
    kept = decontaminate.keep_clean(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    text = dict(docs)
    for d, r in got.items():
        assert sum(len(decontaminate.words_of(text[d][s["start"] : s["end"]].encode())) for s in r["spans"]) == r["n_hit"]


def test_decontamination_of_empty_tables(spark, contaminated):
    docs, items = contaminated
    some, none = spark.createDataFrame(docs, DOC), spark.createDataFrame([], DOC)
    assert decontaminate.scan(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.scan(some, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_a_benchmark_is_measured_before_it_is_collected(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "some words of an item"), (2, None)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 10)
    with pytest.raises(ValueError, match="22 bytes"):
        decontaminate.collect_items(bench)


def test_parts_of_a_benchmark():
    items = [(None, "x " * 30), ("b", ""), ("c", "one two"), ("d", " ".join(f"w{k}" for k in range(1000)))]
    whole = list(decontaminate.parts(items))
    assert len(whole) == 1 and {i for i, _ in whole[0]} == {None, "c", "d"}
    cut = list(decontaminate.parts(items, nodes=300))
    window_sets = [{(i, tuple(raw.split()[k : k + 10])) for part in ps for i, raw in part for k in range(max(1, len(raw.split()) - 9))} for ps in (whole, cut)]
    assert len(cut) > 30 and window_sets[0] == window_sets[1]


def test_decontamination_of_long_texts_and_repeated_rows(spark):
    rng = random.Random(7)
    item = " ".join(f"q{k}" for k in range(20))
    long = " ".join(f"t{rng.randrange(5000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (1, f"{long} {item} {long}"), (None, item), (2, long)], DOC)
    bench = spark.createDataFrame([(1, item), (1, "something else"), (1, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["spans"]) for r in decontaminate.scan(docs, bench).collect()), key=str)
    assert [g[:4] for g in got] == [(1, 600_020, 20, 1), (1, 600_020, 20, 1), (2, 300_000, 0, 0), (None, 20, 20, 1)]
    assert got[0][4] == [(len(long) + 1, len(long) + 1 + len(item))]


def test_exact_dedup_combines_before_the_shuffle(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    plan = exact_dedup._winners(exact_dedup._digests(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert below.count("partial_max") == 1 and plan.count("Exchange hashpartitioning") == 2
    got = exact_dedup.exact_duplicates(docs)
    assert got.where("group_size = 1000 and keep_id = 2997").count() == 1000 and got.where("group_size = 1 and kept").count() == 2000


def test_vocabularies_that_need_more_are_refused(tmp_path):
    import json

    spec = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="isn't supported"):
            load_vocabulary(str(path))


def test_every_document_of_the_tables_equals_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = dict(zip(texts, tokens_of(list(texts.values())), strict=True))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = op5_bpe_encode_decode(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {d: (len(w), sha(np.array(w, "<u4").tobytes()), sha(texts[d].encode())) for d, w in want.items()}
    rows = op8_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {d: (len(texts[d].encode()), len(w), len(w) > 1024) for d, w in want.items()}


@pytest.mark.parametrize("size", [199, 200, 201])
def test_words_about_the_bound_of_the_rank_array(size):
    v, rng = load_vocabulary(tokenizer_path()), random.Random(size)
    word = "".join(rng.choices("theingaro", k=size))
    assert bpe.merge_word(word.encode(), v) == tokens_of([word])[0]


def test_exact_dedup(spark):
    rows = [(i, "same") for i in range(200)] + [(1000, None), (1001, ""), (1002, "Same"), (1003, "same "), (1002, "Same"), (None, "lone")]
    docs = spark.createDataFrame(rows, DOC).withColumn("salt", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("keep_id", F.lit(0))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = digest[r["text_sha256"]]
        top = max((i for i in ids if i is not None), default=None)
        assert r["group_size"] == len(ids) and r["keep_id"] == top and r["kept"] == (r["doc_id"] == top)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 199, 1001, 1002, 1002, 1003]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_windows_of_items_without_id_are_hits(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "clean"), (3, f"a b c d e f g h i j {passage}")], DOC)
    bench = spark.createDataFrame([(None, passage), (None, passage), (7, "a b c d e f g h i j")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontaminate.scan(docs, bench).collect()}
    assert got == {1: (11, 1, [], True), 2: (0, 0, [], False), 3: (21, 2, ["7"], True)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()] == [2]
    con = duckdb.connect()
    for name, frame in (("documents", docs), ("benchmark", bench)):
        con.register(name, frame.toArrow())
    want = con.sql(OP1_SQL)
    assert sorted(map(tuple, decontaminate.scan(docs, bench).select(*want.columns).collect())) == sorted(want.fetchall())


def test_exact_dedup_of_ids_with_several_texts(spark):
    docs = spark.createDataFrame([(5, "a"), (9, "a"), (5, "b"), (5, None), (7, ""), (7, "b")], DOC)
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == [(7, ""), (7, "b"), (9, "a")]
    docs = spark.createDataFrame([(5, "a"), (9, "a"), (5, "b")], DOC)
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == [(5, "b"), (9, "a")]
