"""Shared pieces: the cluster's scratch folder, vectorised text hashing, components of a graph."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was written and has at most so many bytes and rows.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 500_000
#: Vectorised steps look at about so many bytes of text at a time, whatever the size of Arrow's batches.
SLICE_BYTES = 1 << 20

#: Most rows and bytes of an Arrow batch: texts are long, and a batch stands in the executor's memory and in the worker's.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_fallback: list[str] = []


def _frugal() -> None:
    """Python workers stay from stage to stage; what they have freed should go back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # larger blocks are mapped by themselves
        libc.mallopt(-1, 16 << 20)  # more than this at the heap's end goes back
    except (OSError, AttributeError):  # another C library
        pass


_frugal()


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, th, text): each row of docs as a struct, so that no name of its columns clashes with ours, with its
    id, a hash of its text and its text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The rows of docs again, with another text if one is given; a column n_chars then says its length."""
    row = F.col("row")
    if text is not None:
        row = row.withField("text", text)
        if "n_chars" in docs.columns:
            row = row.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session, as in tests, may lack the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="rolloom-"))
    return _fallback[0]


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends, a lost executor costs nothing.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/rolloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at  # noqa: SLF001
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that will run reads it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Has the driver look for tables that nothing refers to any more, so that their shuffle files go at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def bytes_stored(df: DataFrame) -> int:
    """Size on disk of what stored() returned."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)  # noqa: SLF001
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its size was measured to be within the bounds; else joined by shuffle."""
    return F.broadcast(df) if bytes_stored(df) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- text in Arrow batches


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))])
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        size = max(n, 256)
        _power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _STEP | np.uint64(1), np.uint64))])
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(body: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of anything but ASCII white space, or what else `space` marks; no word spans two texts."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~space[body]
    before = np.empty(len(body), bool)
    before[0] = False
    before[1:] = ink[:-1]
    heads = off[:-1][off[:-1] < len(body)]
    before[heads] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(len(body), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    tails = off[1:] - 1
    after[tails[tails >= 0]] = False
    return starts, np.flatnonzero(ink & ~after) + 1


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each of the spans, which are in order and don't overlap or are empty."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        s, e = starts[i:j], ends[i:j]
        lens = e - s
        total = int(lens.sum())
        at = np.cumsum(lens) - lens
        pos = np.arange(total) - np.repeat(at, lens)
        got = _BYTE[body[pos + np.repeat(s, lens)]] * powers(int(lens.max()) + 1)[pos]
        out[i:j] = mix(np.add.reduceat(got, at) + lens.astype(np.uint64))
        i = j
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in it)."""
    body, off = flat(texts)
    starts, ends = word_bounds(body, off)
    return hash_spans(body, starts, ends), np.searchsorted(starts, off)


def grams(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words, offsets of the texts in them). A text of 1 to n-1 words has one gram, of them all."""
    sizes = np.diff(off)
    count = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    goff = np.concatenate([[0], np.cumsum(count)])
    total = int(goff[-1])
    first = np.arange(total) - np.repeat(goff[:-1], count) + np.repeat(off[:-1], count)
    limit = np.repeat(off[1:], count)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        at = first + k
        inside = at < limit
        acc = acc * (_STEP | np.uint64(1)) + np.where(inside, h[np.minimum(at, len(h) - 1)] if len(h) else 0, np.uint64(0))
    return mix(acc), goff


# ---------------------------------------------------------------- components


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as a star around the smallest node of each of its components. Memory follows the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    out = [(x, root(x)) for x in list(parent)]
    out = [(x, r) for x, r in out if x != r]
    if out:
        u, v = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of `edges` (u, v: long, not null); component: the smallest node reachable.

    Large-star and small-star rounds, which end in O(log^2) rounds; each round's edges are written to the
    shared folder. A partition's edges are first contracted to stars, so that a hub has few of them. Empty
    edges: no rows. Loops and repeated edges change nothing.
    """
    spark = edges.sparkSession

    def contracted(df: DataFrame) -> DataFrame:
        return stored(df.mapInArrow(_contract, "u long, v long"))

    def star(df: DataFrame, large: bool) -> DataFrame:
        # large-star: each node's larger neighbours go to the least of it and its neighbours; small-star: it and the smaller ones do
        both = df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("n"))
        if large:
            return out.filter("u > n").select("u", "v").filter("u <> v").distinct()
        return out.select("u", "v").union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    now, before = contracted(edges.select("u", "v").filter("u <> v")), None
    for _ in range(rounds):
        last, now = now, stored(star(star(now, True), False))
        dropped(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- order


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with `rank`: 0, 1, ... in the given order, by range partitions and a sum over their sizes; no task gets all rows."""
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(parts.withColumn("_pid", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count("*").alias("n")).collect())  # one row a partition
    at, bases = 0, []
    for pid, n in sizes:
        bases.append((pid, at))
        at += n
    base = spark.createDataFrame(bases, "_pid int, _base long")
    return parts.join(F.broadcast(base), "_pid").withColumn("rank", F.col("_base") + F.col("_row")).drop("_pid", "_row", "_base")
