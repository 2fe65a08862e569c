"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles (64-bit hashes of lower-cased words); those with equal sets are one class with one
representative. Candidates share at least one of 32 bands of four MinHash values, so a pair at the threshold of 0.8 is missed with
probability (1 - 0.8**4)**32, under 1e-7. For each candidate pair MinHash values are compared 16 at a time; after each step the
posterior probability (uniform prior) that the similarity reaches the threshold is looked up, and the pair is dropped when it is
below ``TOLERANCE``. The pairs left are verified exactly on their whole shingle sets.

No pair ever becomes a row. Buckets are cut into blocks, each two blocks meet in one task, and what a task returns is a spanning forest
of its surviving pairs. The components of these forests hold every surviving pair; they are cut into blocks again, in order of
set size, joined with their shingle sets, and verified where two blocks' sizes allow a similarity of 0.8; a task returns link counts
per class and a spanning forest of its links. A group is cut into a fixed number of blocks at most until a block would hold more than
``BLOCK_BYTES``, so a class is sent to at most ``SPREAD`` tasks however large its group is, until bytes force more; the pairs of
blocks of one group go to consecutive partitions, so no two of them meet in one by chance.

A class of equal sets is told by its digest, never by an id, so texts that share an id by mistake keep their own links.

Defined results: null text counts as empty; a text without words links with nothing and is a class by itself; a text of one to
four words has one shingle of all its words; copies count as links of one another but are never expanded into pairs; rows that
repeat an id count as copies if their sets are equal and as documents of their own else; a class is named by the smallest id in it, so
classes that share that id by mistake have one name; a row with null id links like any other but names no class (null if no row of its
class has an id) and is never dropped; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import BROADCAST_IDS, id_text, join_salted, materialize, mixed, passing, shuffle_partitions, slices, text_key, utf8, without, word_hashes, word_spans
from tomewise.llm.components import components

WORDS, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 32, 4, 16, 1e-6
HASHES = BANDS * ROWS
#: Bytes of a block at most; rows that a group has before it is cut, and blocks that it is cut into before bytes force more, for candidates and for sets.
BLOCK_BYTES, LEAST, SPREAD, LEAST_SETS, SPREAD_SETS = 4 << 20, 512, 8, 128, 16
#: Rows of whole groups that are worked on together, and pairs of them at once.
_CHUNK, _SLAB = 4096, 1 << 15
_FACTORS = mixed(np.arange(7001, 7001 + HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mixed(np.arange(9001, 9001 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, as one array with offsets."""
    data, offsets = utf8(column)
    starts, ends = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # first word of each text
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(column)), made)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    stop = first[text + 1] if len(text) else at
    hashes = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        hashes += np.where(at + k < stop, padded[at + k] * _PLACES[k], np.uint64(k + 1))
    hashes = mixed(hashes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(column)))])


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values [set, hash] of sets that aren't empty."""
    starts = offsets[:-1]
    out = np.empty((len(starts), HASHES), np.uint32)
    if len(starts):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat(hashes * factor, starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Keys [set, band]; equal keys of one band mean equal MinHash values (up to 64-bit collisions)."""
    bands = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For 16, 32, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior the posterior of the similarity is a beta distribution, and P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        term, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while m <= n:
            total += term
            if total >= tolerance:
                break
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return np.array(out)


def likely(signature: np.ndarray, x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of the pairs (x, y) the numbers of those that incremental comparison keeps."""
    kept, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for step, fewest in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (signature[x[kept], cut] == signature[y[kept], cut]).sum(1)
        stay = matches >= fewest
        kept, matches = kept[stay], matches[stay]
    return kept


def forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star around the smallest id of each component of the pairs, as two columns of ids; repeated ids are one."""
    known, number = np.unique(ids, return_inverse=True)
    x, y, top = number[x], number[y], np.arange(len(known))
    while not ((a := top[x]) == (b := top[y])).all():
        least = np.minimum(a, b)
        np.minimum.at(top, a, least)
        np.minimum.at(top, b, least)
        top = top[top]
    while (top != top[top]).any():
        top = top[top]
    other = np.flatnonzero(top != np.arange(len(known)))
    return known[top[other]], known[other]


def _slabs(bounds: np.ndarray, block: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of several groups, never many at once: all of a group of one block, those between two blocks else."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    whole = first[starts] == second[starts]
    x, y, held = [], [], 0
    for size in np.unique(sizes[whole & (sizes > 1) & (sizes <= 128)]):
        i, j = np.triu_indices(size, 1)
        at = starts[whole & (sizes == size)]
        step = max(1, _SLAB // len(i))
        for k in range(0, len(at), step):
            x.append((at[k : k + step, None] + i).ravel())
            y.append((at[k : k + step, None] + j).ravel())
            held += len(x[-1])
            if held >= _SLAB:
                yield np.concatenate(x), np.concatenate(y)
                x, y, held = [], [], 0
    if held:
        yield np.concatenate(x), np.concatenate(y)
    for g in np.flatnonzero(~whole | (sizes > 128)):
        rows = np.arange(bounds[g], bounds[g + 1])
        left, right = (rows, rows) if whole[g] else (rows[block[rows] == first[rows[0]]], rows[block[rows] == second[rows[0]]])
        step = max(1, _SLAB // max(1, len(right)))
        for k in range(0, len(left), step):
            own = left[k : k + step]
            a, b = np.repeat(own, len(right)), np.tile(right, len(own))
            yield (a[a < b], b[a < b]) if whole[g] else (a, b)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, size: str, most: int = 2 * BLOCK_BYTES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (runs of equal values in the first ``keys`` columns, even where they span batches) with the bounds of these.

    A table ends with the group that reaches ``_CHUNK`` rows or ``most`` bytes in column ``size``."""
    held: list[pa.RecordBatch] = []
    bounds, rows, load, last = [0], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], 1)
        ends = np.cumsum(pc.binary_length(batch.column(size)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[a].tolist())
            if last is not None and key != last:
                bounds.append(rows)
                if rows >= _CHUNK or load >= most:
                    yield pa.Table.from_batches(held), np.array(bounds)
                    held, bounds, rows, load = [], [0], 0, 0
            held.append(batch.slice(a, b - a))
            rows, load, last = rows + b - a, load + int(ends[b - 1] - (ends[a - 1] if a else 0)), key
    if held:
        yield pa.Table.from_batches(held), np.array([*bounds, rows])


def _fixed(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _n_blocks(n: Column, load: Column, least: int, spread: int) -> Column:
    """Blocks of a group of ``n`` rows and ``load`` bytes."""
    return F.greatest(F.ceil(load / BLOCK_BYTES), F.least(F.ceil(n / least), F.lit(spread))).cast("int")


def _meet(rows: DataFrame, group: str, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """Bring each two blocks (``first``, ``second``) of a group together in one task, one pair after another."""
    parts = shuffle_partitions(rows.sparkSession)
    place = F.pmod(F.pmod(F.xxhash64(group), F.lit(parts)) + (F.col("second").cast("long") * (F.col("second") + 1) / 2).cast("long") + F.col("first"), F.lit(parts)).cast("int")
    keys = [group, "first", "second"]
    return rows.select(*keys, *columns, place.alias("place_")).repartitionById(parts, F.col("place_")).drop("place_").sortWithinPartitions(*keys).mapInArrow(run, schema)


def _read_sets(rows: DataFrame, with_set: bool) -> DataFrame:
    """Add size, digest (d1, d2), sig and, if asked for, the shingle set to rows (doc_id, text, more columns)."""
    extra = [c for c in rows.columns if c not in ("doc_id", "text")]
    kinds = "".join(f", {c} {t}" for c, t in rows.dtypes if c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, offsets = shingle_sets(part.column("text"))
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                digests = []
                for salt in (1, 2):
                    value = np.zeros(len(size), np.uint64)
                    if len(full):
                        value[full] = np.add.reduceat(mixed(hashes + np.uint64(salt)), offsets[:-1][full])
                    digests.append(value.view(np.int64))
                sig = np.zeros((len(size), HASHES), np.uint32)
                sig[full] = signatures(hashes, np.append(offsets[:-1][full], len(hashes)))
                columns = [part.column("doc_id"), *(part.column(c) for c in extra), pa.array(size), *map(pa.array, digests), pa.array((s.tobytes() for s in sig), pa.binary())]
                names = ["doc_id", *extra, "size", "d1", "d2", "sig"]
                if with_set:
                    columns.append(pa.array((hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)), pa.binary()))
                    names.append("shingles")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("doc_id", *extra, "text").mapInArrow(run, f"doc_id long{kinds}, size long, d1 long, d2 long, sig binary" + ", shingles binary" * with_set)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "sig", 1 << 20):
            keys = band_keys(_fixed(part.column("sig"), np.uint32, HASHES))
            ids = np.repeat(part.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1).view(np.int64))], ["rep", "band", "key"])


def _survivors(table: pa.Table, bounds: np.ndarray, sig: np.ndarray, size: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that sizes allow to be similar and that incremental comparison keeps."""
    block, first, second = (table[c].to_numpy() for c in ("block", "first", "second"))
    for x, y in _slabs(bounds, block, first, second):
        fits = 5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y])
        x, y = x[fits], y[fits]
        kept = likely(sig, x, y, least)
        if len(kept):
            yield x[kept], y[kept]


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs of a bucket that meet here for the first time and survive pruning."""
    least = least_matches()
    for table, bounds in _groups(batches, 3, "sig"):
        ids, band, size = (table[c].to_numpy() for c in ("rep", "band", "size"))
        sig = _fixed(table["sig"], np.uint32, HASHES)
        keys = band_keys(sig)
        found = []
        for x, y in _survivors(table, bounds, sig, size, least):
            new = (keys[x] == keys[y]).argmax(1) == band[x]  # no earlier band has this pair too
            found.append((x[new], y[new]))
        if found:
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(ids, x, y)], ["a", "b"])


def _similar(places: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Of pairs of sets (numbers of their shingles from ``begin`` on) whether their Jaccard similarity is 0.8 or more."""
    real, size = np.zeros(len(x), bool), np.diff(begin)
    order = np.argsort(x, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(order) else []:
        a, others = x[run[0]], y[run]
        mark[places[begin[a] : begin[a + 1]]] = True
        low, high = others.min(), others.max() + 1
        if begin[high] - begin[low] <= 4 * size[others].sum():  # most of that stretch is compared: one look-up for all
            common = np.add.reduceat(mark[places[begin[low] : begin[high]]], begin[low:high] - begin[low], dtype=np.int64)[others - low]
        else:
            common = np.array([mark[places[begin[b] : begin[b + 1]]].sum() for b in others])
        real[run] = 5 * common >= 4 * (size[a] + size[others] - common)  # in integers
        mark[places[begin[a] : begin[a + 1]]] = False
    return real


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts of a cluster's classes, and forests of the links (as rows with null links)."""
    least = least_matches()
    for table, bounds in _groups(batches, 3, "shingles"):
        ids, copies, size = (table[c].to_numpy() for c in ("rep", "copies", "size"))
        sig = _fixed(table["sig"], np.uint32, HASHES)
        begin = np.concatenate([[0], np.cumsum(size)])
        known, places = np.unique(_fixed(table["shingles"], np.uint64, 1)[:, 0], return_inverse=True)
        mark, found = np.zeros(len(known), bool), []
        for x, y in _survivors(table, bounds, sig, size, least):
            real = _similar(places, begin, x, y, mark)
            found.append((x[real], y[real]))
        if not found:
            continue
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        links = np.bincount(x, weights=copies[y], minlength=len(ids)) + np.bincount(y, weights=copies[x], minlength=len(ids))
        has = np.flatnonzero(links)
        a, b = forest(ids, x, y)
        n = [*links[has].astype(np.int64).tolist(), *[None] * len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[has], a])), pa.array(np.concatenate([ids[has], b])), pa.array(n, pa.int64())], ["a", "b", "links"])


def _candidates(classes: DataFrame, number: int) -> DataFrame:
    """Edges (a, b) of pairs of classes that share a band and survive pruning, enough of them to connect all such pairs."""
    keys = classes.select("rep", "sig").mapInArrow(_band_rows, "rep long, band int, key long")
    crowds = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowds", rows=4 * number)
    crowded = join_salted(keys, crowds, ["key"], "n").join(classes.select("rep", "size", "sig"), "rep")
    parts = _n_blocks(F.col("n"), F.col("n") * 4 * HASHES, LEAST, SPREAD)
    dealt = crowded.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = other.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return _meet(pairs, "key", ["band", "block", "rep", "size", "sig"], _prune, "a long, b long")


def _laid_out(members: DataFrame) -> DataFrame:
    """(cluster, size, n, start, bytes, load, parts, low, high): where the ``n`` classes of a size lie in their cluster, which is laid out by size.

    Those of one size are spread evenly over ``bytes`` from ``start`` on, of ``load`` in all; a block is an equal part of these. ``low`` to
    ``high`` are the blocks of sizes from 0.8 to 1.25 of this one. Only counts per size are ordered, never classes."""
    sizes = members.groupBy("cluster", "size").agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * (8 * F.col("size") + 4 * HASHES))
    whole = Window.partitionBy("cluster")
    laid = sizes.select("*", F.sum("bytes").over(whole.orderBy("size")).alias("stop"), F.sum("bytes").over(whole).alias("load"), F.sum("n").over(whole).alias("all"))
    laid = laid.withColumn("parts", _n_blocks(F.col("all"), F.col("load"), LEAST_SETS, SPREAD_SETS)).withColumn("start", F.col("stop") - F.col("bytes"))
    laid = laid.withColumn("log", (F.log("size") * 1_000_000).cast("long"))
    reach = whole.orderBy("log").rangeBetween(-223_150, 223_150)  # ln 1.25, and a little more
    return laid.select("cluster", "size", "n", "start", "bytes", "load", "parts", F.min(_block("start")).over(reach).alias("low"), F.max(_block(F.col("stop") - 1)).over(reach).alias("high"))


def _block(at: str | Column) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.least(F.floor(at * F.col("parts") / F.col("load")).cast("int"), F.col("parts") - 1)


def _links(docs: DataFrame, sets: DataFrame, classes: DataFrame, number: int) -> DataFrame:
    """(a, b, links): the links of class ``a``, and with null links edges that connect all links. ``number``: of classes."""
    near = components(_candidates(classes, number), 8 * number).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    members = materialize(near.join(classes.select("rep", "size", "copies", "least"), "rep"), "members", rows=number)
    share = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
    placed = join_salted(members, materialize(_laid_out(members), "laid", rows=number), ["cluster", "size"], "n").select(
        "rep", "cluster", "copies", _block(F.col("start") + F.floor(share * F.col("bytes"))).alias("block"), "low", "high", *(F.col(f"least.{c}").alias(f"own_{c}") for c in ("doc_id", "t1", "t2"))
    )
    picked = materialize(placed, "picked", rows=number)
    n = picked.count()
    own = F.broadcast(picked) if n <= BROADCAST_IDS else picked

    def of(rows: DataFrame) -> DataFrame:
        return rows.join(own, rows["doc_id"].eqNullSafe(F.col("own_doc_id")) & (rows["t1"] == F.col("own_t1")) & (rows["t2"] == F.col("own_t2")))

    texts = of(docs).select("doc_id", "text", "rep", "cluster", "copies", "block", "low", "high")
    if of(sets.select("doc_id", "t1", "t2")).count() > n:  # whole rows are repeated
        texts = texts.dropDuplicates(["rep"])
    whole = _read_sets(texts, with_set=True).withColumn("other", F.explode(F.sequence("low", "high")))
    whole = whole.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return _meet(whole, "cluster", ["block", "rep", "copies", "size", "sig", "shingles"], _verify, "a long, b long, links long")


def _told(docs: DataFrame, sets: DataFrame, digest: list[str]) -> DataFrame:
    """For each class (by ``digest``) its copies, its links, and the row that its group is named by (``key``)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    classes = sets.where("size > 0").groupBy(*digest).agg(least.alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), *digest, "copies", "least", "sig"), "classes")
    number = classes.count()
    found = materialize(_links(docs, sets, classes, number), "links")
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links is null").select("a", "b"), 8 * number).select(F.col("node").alias("rep"), "root")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    linked = materialize(classes.drop("sig").join(links, "rep", "left").join(roots, "rep", "left").select("root", *digest, "copies", "least", n_links), "linked", rows=number)
    joined = linked.where("root is not null")
    groups = materialize(joined.groupBy("root").agg(F.min("least").alias("key"), F.count("*").alias("n")), "groups", rows=number)
    columns = [*digest, "copies", "n_links", "key"]
    return join_salted(joined, groups, ["root"], "n").select(*columns).unionByName(linked.where("root is null").withColumnRenamed("least", "key").select(*columns))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2, class_id, n_links and stays (whether a row is the one of its class that stays) of each row."""
    docs = id_text(df, id_col, text_col).select("doc_id", "text", *text_key("text"))
    sets = materialize(_read_sets(docs, with_set=False), "sets")
    digest = ["d1", "d2", "size"]
    with passing(df.sparkSession):
        told = materialize(_told(docs, sets, digest), "told", keep=True)
    full = join_salted(sets.where("size > 0").select("doc_id", "t1", "t2", *digest), told, digest, "copies")
    stays = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("key.doc_id")) & (F.col("t1") == F.col("key.t1")) & (F.col("t2") == F.col("key.t2")))
    full = full.select("doc_id", "t1", "t2", F.col("key.doc_id").alias("class_id"), "n_links", stays.alias("stays"))
    return full.unionByName(sets.where("size = 0").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays")))


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id among the documents it is linked with, directly or by others) and n_links (documents with similarity 0.8 or more)."""
    return _rows(df, id_col, text_col).select("doc_id", "class_id", "n_links")


def keep_one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id (of a repeated id the smallest text key), and all rows without id.

    Rows that repeat it as a whole stay with it."""
    return without(df, _rows(df, id_col, text_col).where("not stays").select("doc_id", "t1", "t2"), id_col, text_col)
