"""Chat formatting and WARC archives: round trips and brute force."""

import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tomewise.llm import chat_format, warc
from tomewise.llm.common import shared_path

LOG = "conv_id long, turn long, seq long, kind string, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "#### a\n### b", "\\\\</turn>\\", "", "</turn></turn>\n### user\n", "a" * 5000 + "</turn", "\n\\\n#"]


def test_escapes_are_reversible():
    for text in NASTY:
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert list(chat_format.parse(chat_format.render(text, text)[0] * 2)) == [(text, text)] * 2
    with pytest.raises(ValueError):
        list(chat_format.parse("no turn"))


def test_fold_of_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 3, "delta", None, None),
        (1, 0, 4, "edit", "user", "hi there"), (1, 1, 5, "regenerate", "assistant", "x"), (1, 1, 6, "delta", "assistant", "Good"), (1, 1, 7, "delta", "assistant", " day"),
        (2, 0, 0, "delta", "assistant", NASTY[0]), (2, 3, 0, "regenerate", "user", "gone"), (None, 0, 0, "message", None, None),
        (3, 0, 0, "message", "user", "a"), (3, 0, 0, "message", "user", "b"),
    ]
    frame = spark.createDataFrame(log[::-1], LOG).withColumn("place", F.lit(5)).withColumn("formatted", F.lit(5))
    got = {}
    for r in sorted(chat_format.format_log(frame).collect(), key=lambda r: (r["conv_id"] or -1, r["place"])):
        (turn,) = chat_format.parse(r["formatted"])
        got.setdefault(r["conv_id"], []).append(turn)
        assert (r["loss_start"] is not None) == (turn[0] == "assistant")
        if r["loss_start"] is not None:
            assert chat_format.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) == turn[1]
    assert got == {1: [("user", "hi there"), ("assistant", "Good day")], 2: [("assistant", NASTY[0]), ("user", "")], None: [("", "")], 3: [("user", "a"), ("user", "b")]}
    with pytest.raises(Exception, match="unknown event kind"):
        chat_format.format_log(spark.createDataFrame([(1, 0, 0, "what", "user", "x")], LOG)).count()
    assert chat_format.digests(chat_format.format_log(spark.createDataFrame([], LOG))).count() == 0


def test_digests_of_long_conversations(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], NASTY[(c + t) % len(NASTY)]) for c in range(3) for t in range(5000 if c == 0 else 4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_log(chat_format.log_of_messages(frame))).collect()}
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat_format.render(r[2], r[3])[0]) for r in own)


def pages():
    rows = [(i, f"http://x/{i}", f"<p>page {i % 40} {'lorem ipsum ' * (i % 7)}</p>") for i in range(300)]
    return rows + [(900, None, None), (901, "http://y/\r\nInjected: 1", ""), (None, "http://n", "only"), (902, "http://z", "é" * 70_000), (299, rows[299][1], rows[299][2])]


def test_archives_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("response", F.lit(1))
    path = shared_path(spark, "warc")
    warc.write_archives(frame, path, archive_bytes=30_000, sample_bytes=8_000)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).count() > 3
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    keep = {}
    for p, _, h in rows:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if p is None else p)
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        body, top = html[r["page_id"]], keep[html[r["page_id"]].decode()]
        first = r["page_id"] is None or r["page_id"] == top
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("response" if first else "revisit") and r["refers_to"] == (None if first else top)
        assert r["payload"] == (body if first else None)
    assert next(r["url"] for r in got if r["page_id"] == 901) == "http://y/%0D%0AInjected:%201"


def test_archive_starts_with_its_dictionary():
    records = [warc.record(i, f"http://x/{i}", b"some common words " * 20 + str(i).encode(), None, False, "2000-01-01T00:00:00Z") for i in range(400)]
    made = list(warc.frames(iter(records)))
    head = made[0][1]
    assert head[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(head[4:8], "little") == len(head) - 8 > 0
    dictionary = zstandard.ZstdCompressionDict(head[8:])
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(made[1][1]) == records[0]
    assert list(warc.records_of(b"".join(f for _, f in made))) == records
    with pytest.raises(ValueError):
        list(warc.records_of(b"not an archive"))


def test_archives_of_an_empty_table(spark):
    path = shared_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_small_payloads_stay_responses(spark):
    path = shared_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string"), path, least=5)
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, path).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_long_first_records_leave_a_dictionary():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400)]
    page = lambda n: " ".join(rng.choices(words, k=n)).encode()
    records = [warc.record(i, f"http://x/{i}", page(400_000 if i == 0 else 60), None, False, "2000-01-01T00:00:00Z") for i in range(300)]
    assert len(records[0]) > warc.SAMPLE_BYTES
    made = [f for _, f in warc.frames(iter(records))]
    assert int.from_bytes(made[0][4:8], "little") > 0 and list(warc.records_of(b"".join(made))) == records
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(map(len, made[2:])) < sum(len(plain.compress(r)) for r in records[1:])


def test_small_archives_have_a_dictionary():
    for n in range(1, 9):
        records = [warc.record(i, f"http://x/{i}", b"<p>same page, more or less</p>" * (i + 1), None, False, "2000-01-01T00:00:00Z") for i in range(n)]
        made = [f for _, f in warc.frames(iter(records))]
        assert int.from_bytes(made[0][4:8], "little") > 100 and list(warc.records_of(b"".join(made))) == records
        alone = zstandard.ZstdDecompressor()
        with pytest.raises(zstandard.ZstdError):  # no record can be read without the dictionary
            for frame in made[1:]:
                alone.decompress(frame)


def plain_fold(events):
    """Final messages of a log: (conv_id, turn) to a list of (role, text)."""
    out = {}
    order = lambda e: (e[0] is not None, e[0] or 0, e[1], e[2], e[3] != "message", e[3], e[4] or "", e[5] or "")
    for conv, turn, _, kind, role, text in sorted(events, key=order):
        messages = out.setdefault((conv, turn), [])
        role, text = role or "", text or ""
        if kind == "message" or not messages:
            messages.append([role, "" if kind == "regenerate" else text])
        elif kind == "delta":
            messages[-1][1] += text
        else:
            messages[-1][1] = text if kind == "edit" else ""
    return out


def test_random_logs_equal_a_plain_fold(spark):
    rng = random.Random(31)
    texts = [*NASTY, "x", None, "tail "]
    events = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 3), rng.randint(0, 6), rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", None, "odd\nrole #### x"]), rng.choice(texts)) for _ in range(250)]
    rows = chat_format.format_log(spark.createDataFrame(events, LOG)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (str(r["conv_id"]), r["place"])):
        (role, text), = chat_format.parse(r["formatted"])
        got.setdefault((r["conv_id"], r["turn"]), []).append([role, text])
        inside = chat_format.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) if r["loss_start"] is not None else None
        assert inside == (text if role == "assistant" else None)
    assert got == plain_fold(events)
