"""Quality classifier and language identification: held-out accuracy, bounds, odd inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomewise.llm import language_id, quality
from tomewise.llm.queries import op6_quality, op9_language_id, table

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in op6_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == held_out(d) for d, r in rows.items())
    told = [(rows[d]["score"], y) for d, y in labels.items() if held_out(d)]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in told]) > 0.95
    good, bad = [s for s, y in told if y], [s for s, y in told if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_are_never_learned(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality.learnable(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables, strict=True))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_features(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    for labels in (np.ones(5), np.zeros(5), np.zeros(0)):
        score = quality.fit_features(x[: len(labels)], labels).score(x)
        assert (score == score[0]).all() and 0 <= score[0] <= 1


def test_features_equal_plain_counts():
    texts = ["", "Ab 12\nab\tAB!", "é é é | %%", "one one one two", "x" * 300]
    got = dict(zip(quality.FEATURES, quality.features(pa.array([*texts, None])).T, strict=True))
    assert got["log_bytes"].tolist() == [np.log1p(len(t.encode())) for t in texts] + [0]
    assert got["upper_share"].tolist() == [0, 3 / 6, 0, 0, 0, 0] and got["bangs"][1] == 1 / 12
    assert got["echoes"].tolist() == [0, 1 / 4, 2 / 3, 2 / 4, 0, 0]
    assert got["distinct_words"].tolist() == [1, 2 / 4, 1 / 3, 2 / 4, 1, 1]
    assert got["distinct_pairs"].tolist() == [1, 1, 1 / 2, 2 / 3, 1, 1]
    lines = quality.features(pa.array(["a b.\nc d!\n\na b\na  b", "a\nb", "b\na?", "\n\n"]))[:, [quality.FEATURES.index("repeated_lines"), quality.FEATURES.index("sentence_words")]]
    assert lines.tolist() == [[2 / 4, 8 / 3], [0, 2], [0, 2 / 2], [0, 0]]


def test_scores_equal_plain_sums(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in op6_quality(spark, SF).collect()}
    assert len(model.tables) == len(quality.FEATURES) and len(model.pairs) == quality.PAIRS

    def plain(x):
        at = [sum(v >= edge for edge in edges) for v, edges in zip(x, model.edges, strict=True)]
        return model.intercept + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))

    for d, text in texts.items():
        assert abs(got[d] - 1 / (1 + np.exp(-plain(quality.features(pa.array([text]))[0])))) < 1e-9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "good text here " * 50), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("text_read", F.lit("t"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (2, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.scores(docs, model).where("score between 0 and 1").count() == 5
    kept = quality.keep_good(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 5 and kept.where("text is null").count() == 1
    none = docs.limit(0)
    assert quality.scores(none, quality.fit(none, labels.limit(0))).count() == 0


def test_language_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in op9_language_id(spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == held_out(d) for d, r in rows.items())
    assert np.mean([rows[d]["lang_pred"] == x for d, x in lang.items() if held_out(d)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def plain_ppm(texts, text):
    """Bits of a text by a context tree of order 3 over other texts, byte by byte, with exclusion."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        raw = b"\0\0\0" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][raw[i - k : i]][raw[i]] += 1

    def p(context, byte):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        count = seen[len(context)].get(context)
        if not count:
            return p(shorter, byte)
        total, distinct = sum(count.values()), len(count)
        rest = 1 - sum(p(shorter, b) for b in count)
        if rest < 1e-12:
            return count[byte] / total
        return count[byte] / (total + distinct) if byte in count else distinct / (total + distinct) / rest * p(shorter, byte)

    raw = b"\0\0\0" + text.encode()
    return -sum(math.log2(p(raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))


LEARNED = {
    "ar": ["القط جلس على السجادة", "الكلب في البيت"], "en": ["the cat and the dog sat on the mat " * 3, "a"], "fr": ["le chat et le chien " * 3, "l'été, c'est ça", ""],
    "ja": ["猫がマットの上に座った。", "犬は家にいる"], "ru": ["кошка сидела на коврике", "собака дома, а кошка нет"],
    "zz": ["".join(map(chr, range(0x20, 0x250))) + "".join(map(chr, range(0x4E00, 0x9000, 37)))],
}


def learned(by_language):
    rows = [(lang, t) for lang, texts in by_language.items() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    counts = pa.Table.from_batches(list(language_id._gram_counts(iter([batch])))).group_by(["lang", "gram"]).aggregate([("n", "sum")])
    return counts["lang"].to_pylist(), counts["gram"].to_numpy(), counts["n_sum"].to_numpy()


def test_code_lengths_equal_a_plain_ppm():
    """Six scripts, more than 112 byte values: every byte keeps its own code."""
    assert len(set("".join(t for texts in LEARNED.values() for t in texts).encode())) > 112
    model = language_id.trees(sorted(LEARNED), *learned(LEARNED))
    texts = ["", "the cat", "x", "le chat noir et la souris ", "é", "кошка и собака", "日本の猫", "القط", "\0\x7f", "ab" * 40]
    data, offsets = language_id.utf8(pa.array(texts))
    got = language_id.code_lengths(model, data, offsets)
    assert np.allclose(got, [[plain_ppm(LEARNED[x], t) for x in sorted(LEARNED)] for t in texts], rtol=1e-5)
    with pytest.raises(ValueError, match="too many"):
        language_id.trees(sorted(LEARNED), *learned(LEARNED), cells=1000)


def test_twenty_languages_of_four_scripts():
    rng = random.Random(3)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "ابتثجحخدذرزسشصضطظعغ", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))]
    words = {f"l{k:02}": ["".join(rng.choices(scripts[k % 4], k=rng.randint(2, 7))) for _ in range(60)] for k in range(20)}
    say = lambda x, n: " ".join(rng.choices(words[x], k=n))
    model = language_id.trees(sorted(words), *learned({x: [say(x, 50) for _ in range(10)] for x in words}))
    held = [(x, say(x, 12)) for x in words for _ in range(10)]
    data, offsets = language_id.utf8(pa.array([t for _, t in held]))
    best = language_id.code_lengths(model, data, offsets).argmin(1)
    assert np.mean([model.languages[b] == x for b, (x, _) in zip(best, held, strict=True)]) > 0.98


def test_table_finds_what_it_was_made_of():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 32, 50_000, dtype=np.uint64)).astype(np.uint32)
    t = language_id.Table(codes[::2])
    assert (t.find(codes[::2]) == np.arange(len(codes[::2]))).all() and (t.find(codes[1::2]) == -1).all()
    assert len(language_id.Table(codes[:0]).find(codes[:3])) == 3


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !?", None), (6, "日本語", None), (1, "the cat sat", "en"), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("place", F.lit(1))
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", 6: got[6], None: "en"} and got[6] in ("en", "fr")
    assert language_id.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert language_id.fit(docs, per_language=1).languages == ["en", "fr"]


@pytest.mark.parametrize("name", ["lang", "source"])
def test_labels_are_no_inputs(spark, name):
    docs = table(spark, SF, "documents").limit(50)
    model = language_id.fit(table(spark, SF, "documents"))
    plain = language_id.predict(docs, model).collect()
    assert plain == language_id.predict(docs.withColumn(name, F.lit("zz")), model).collect()
