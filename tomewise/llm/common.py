"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once, and bytes of an Arrow batch that brings them.
SLICE_BYTES, BATCH_BYTES = 256 << 10, 4 << 20
#: Ids that may be broadcast (about 100 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rows of a table of ids and numbers in one file.
FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tomewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str, keep: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors.

    Where the number of rows is known, about, they are written by a task for each ``FILE_ROWS`` of them, so small tables aren't many files. Inside ``passing`` the table goes at its end; with ``keep`` it goes with the scope around that, if there is one."""
    path = shared_path(df.sparkSession, kind)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    few = df if rows is None else df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), -(-rows // FILE_ROWS))))
    few.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are written inside, once nothing reads them any more."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, _SCOPES.pop())


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders from whatever store they are in."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_salted(rows: DataFrame, told: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``told``, which has one row for each of ``keys`` and the number of ``rows`` with them in ``size``.

    A key with more than a quarter of an average partition is salted: its rows are dealt by input split, its row of ``told`` is sent
    to each salt. At most four keys for each shuffle partition can be that large, so the broadcast list of them is small whatever the
    input. ``total`` is the sum of ``size`` where it is known. ``told`` is read several times and should be a table or cheap."""
    quarters = 4 * shuffle_partitions(rows.sparkSession)
    total = told.agg(F.sum(size)).first()[0] if total is None else total
    if not total:
        return rows.join(told, keys)
    salts = F.ceil(F.col(size) * quarters / total).cast("int")
    hot = told.where(salts > 1).select(*keys, salts.alias("salts_"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.spark_partition_id(), F.col("salts_")), F.lit(0))).drop("salts_")
    copies = told.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(copies, [*keys, "salt_"]).drop("salt_")


def text_key(text: str | Column) -> list[Column]:
    """Two 64-bit hashes of a text, ``t1`` and ``t2``: with its id they tell a row from others of that id."""
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))).alias(f"t{k}") for k in (1, 2)]


def without(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the rows (doc_id, t1, t2; ids aren't null), all of them told by id and text, since an id may repeat.

    The list is broadcast only if its size, counted first, allows it."""
    dropped = materialize(rows.select(F.col("doc_id").alias("dropped_id"), F.col("t1").alias("dropped_t1"), F.col("t2").alias("dropped_t2")).distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    t1, t2 = text_key(df[text_col].cast("string"))
    same = (df[id_col].cast("long") == dropped["dropped_id"]) & (t1 == dropped["dropped_t1"]) & (t2 == dropped["dropped_t2"])
    return df.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column already (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([bkmg]?)b?", df.sparkSession.conf.get(key).lower())
    if size is None or int(size[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH_BYTES:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, as ``doc_id`` long and ``text`` string (null becomes empty)."""
    return bounded(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` text bytes; a longer single text is a run by itself."""
    ends = np.cumsum(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and the offsets of its values in it; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Bytes of words, lower-cased (A-Z only): ASCII letters and digits, and every byte of a non-ASCII character. 0: not in a word.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of several texts; no word reaches over the border of two texts."""
    inside = WORD_BYTE[data] > 0
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = WORD_BYTE[data]
    letters = letters[letters > 0]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, np.uint64))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    return mixed(np.add.reduceat(_BYTE_CODE[letters] * powers[place], first) + sizes.astype(np.uint64))
