"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable frame that holds a Zstandard dictionary, built from the first records of that archive
(at most ``SAMPLE_BYTES`` of them, a bounded sample; from pieces of them where they are fewer than 8; where that is too little to train on,
their bytes themselves are the dictionary); every record is a frame of its own compressed with it. An archive ends at ``ARCHIVE_BYTES`` of records, so neither writer nor reader holds more than one such archive. Frames are written by Spark's text
writer, whose line separator is set to an empty skippable frame: archives go to whatever store the path names, by any executor,
with Spark's commit protocol. They are read as binary files.

Of records with equal payloads (of at least ``least`` bytes) that with the largest id is a response, the others are revisits of
it. Winners are found by partial maxima per digest, combined in each input split, and told to the rows by a salted join, so a payload
that a third of all pages share is no hot group.

Defined results: null html is an empty payload; rows that repeat the largest id of their payload are all responses; rows with
null id never win over others (a group without any id is all responses, its ids read back as null); a null url becomes the record's
id; control characters in urls are percent-encoded; an empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.llm.common import bounded, join_salted, materialize, slices

ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 2 << 20, 32 << 10, 3
#: Bytes of the pieces that fewer than 8 records are cut into to learn a dictionary.
PIECE_BYTES = 4 << 10
#: Magic numbers of Zstandard: a frame, the skippable frames, the one of these that holds a dictionary. Fixed values.
_FRAME, _SKIPPABLE, _DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
#: An empty skippable frame; all its bytes are ASCII.
_EMPTY = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else _record_id(page)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(response)}"] * revisit
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records, or made of their first bytes where these are too few or too alike to train on."""
    learn = records
    if len(records) < 8:  # few, maybe long, records: learn from pieces of them, evenly taken
        pieces = [r[k : k + PIECE_BYTES] for r in records for k in range(0, len(r), PIECE_BYTES)]
        learn = pieces[:: max(1, len(pieces) * PIECE_BYTES // SAMPLE_BYTES)]
    if len(learn) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, learn, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(archive number, frame) of records: per archive the dictionary first."""
    archive, held, size, compress = 0, [], 0, None

    def begin() -> Iterator[tuple[int, bytes]]:
        nonlocal compress
        learned = _dictionary(held)
        data = learned.as_bytes()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True, write_content_size=True).compress
        yield archive, struct.pack("<II", _DICTIONARY, len(data)) + data
        yield from ((archive, compress(r)) for r in held)

    for r in records:
        if compress is None:
            held.append(r)
        else:
            yield archive, compress(r)
        size += len(r)
        if compress is None and size >= sample_bytes:
            yield from begin()
            held = []
        if size >= archive_bytes:
            archive, held, size, compress = archive + 1, [], 0, None
    if held:
        yield from begin()


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers (RFC 8878)."""
    flags = data[at + 4]
    at += 4 + zstandard.frame_header_size(bytes(data[at : at + 18])) - 4
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + (4 if flags & 4 else 0)


def records_of(archive: bytes) -> Iterator[bytes]:
    data, at, decompress = memoryview(archive), 0, zstandard.ZstdDecompressor().decompress
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in _SKIPPABLE:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if magic == _DICTIONARY and size:
                decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size]))).decompress
            at += 8 + size
        elif magic == _FRAME:
            end = _frame_end(data, at)
            yield decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame starts at byte {at}")


def parse_record(data: bytes) -> tuple[int | None, str, str, int, str, int | None, bytes | None]:
    """page_id, url, record type, payload bytes, payload digest, id of the response that it revisits, payload (None for revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda s: int(s[len("<urn:page:") : -1]) if len(s) > len("<urn:page:>") else None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], "revisit", size, digest, number(fields["WARC-Refers-To"]), None
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], "response", len(payload), digest, None, payload


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Write a record per row to archives under ``path``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    winners = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")), "winners")
    told = join_salted(rows, winners, ["digest"], "n").select(
        "page_id", "url", "payload", "response", ((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for part in slices(batch, "payload"):
                    for row in part.to_pylist():
                        yield record(row["page_id"], row["url"], row["payload"], row["response"], row["revisit"], date)

        for seq, (archive, frame) in enumerate(frames(records(), archive_bytes, sample_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{place:06d}-{archive:04d}"]), pa.array([seq], pa.int64()), pa.array([frame], pa.binary())], ["archive", "seq", "frame"])

    out = told.mapInArrow(run, "archive string, seq long, frame binary").sortWithinPartitions("archive", "seq")
    out.select("archive", F.col("frame").cast("string").alias("frame")).write.partitionBy("archive").option("lineSep", _EMPTY).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload of each record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for data in records_of(batch.column("content")[i].as_py()):
                    rows.append(parse_record(data))
                    held += len(data)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
