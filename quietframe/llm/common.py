"""Shared plumbing: staged tables, Arrow text access, hashing, components.

Nothing here keeps rows on the driver.  Tables that have to be read more than
once are written to the folder that the session names in
``spark.checkpoint.dir``, which all executors share, so that a lost executor
never takes the only copy of an intermediate result with it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only in single-process local mode, where the
    driver is the executor; on a cluster without the setting this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quietframe-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def passing(spark: SparkSession):
    """Shuffle files of a query that is made and run in here go as soon as it has ended (Spark 4.1), not with the session."""
    return _setting(spark, _CLEANUP, "true")


def batches_of(spark: SparkSession, n_bytes: int):
    """Queries that are run in here hand Python about so many bytes at a time, in place of all texts of a task up to 10,000.

    A whole row at least.  The JVM holds a batch several times over beside its heap, while it grows and is sent.
    """
    return _setting(spark, _BATCH, str(n_bytes))


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: lineage ends there, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quietframe-{uuid.uuid4().hex}"
    with passing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> list:
    """Rows of a bounded table; what was shuffled for them goes."""
    with passing(df.sparkSession):
        return df.select("*").collect()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, modulus: int, remainder: int):
    """Fold rule shared by the learned operators: crc32 of the id's text."""
    return F.crc32(doc_id.cast("string")) % modulus == remainder


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of rows of about ``max_bytes``.

    Yields ``(lo, hi, bytes, offsets)``; null texts count as empty.  A single
    longer text makes a slice of its own, never a truncated one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for further tasks and would hold it beside those of others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """Row number of every byte of a slice."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every run ``data[starts:ends]``, length mixed in.

    Prefix sums of ``value * base**i`` modulo 2**64 give any run by one
    subtraction; multiplying by the inverse power takes its position out.
    """
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: The ASCII white space that ends a word (0x20 and 0x09 to 0x0D).
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of a slice of texts."""
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[data]


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs of places ``a`` and ``b`` connect, one for each id that has any."""
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[moved]], ids[moved]


#: Rows of a few numbers that may be broadcast, a few MB; beyond that a join shuffles.
SMALL_ROWS = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """A staged table of a few numbers a row, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def tasks_for(spark: SparkSession, rows: int, each: int = 50_000) -> int:
    """Tasks for a counted number of small rows."""
    return max(1, min(partitions(spark), -(-rows // each)))


def connected(edges: DataFrame, vertex_type: str = "long") -> DataFrame:
    """Components of an undirected graph: ``(v, component)`` with the least id.

    ``edges`` has columns ``a`` and ``b``.  Every round each vertex follows
    the neighbour of least random priority and the graph is contracted along
    those pointers, so rounds grow with the logarithm of the longest chain and
    never with the degree of a hub: minima are combined before the shuffle,
    and edges that became equal or loops are dropped.  Only vertices that have
    an edge are returned.
    """
    spark = edges.sparkSession
    live = edges.select(F.col("a").cast(vertex_type).alias("a"), F.col("b").cast(vertex_type).alias("b")).where("a <> b")
    live = staged(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    for round_no in range(200):
        rows = live.count()
        if not rows:
            break
        # Every later table of this graph is smaller: few rows go to few tasks, however many partitions are set.
        n = tasks_for(spark, rows)
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64(F.col("b"), F.lit(round_no)).alias("p"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(round_no)).alias("p"), F.col("a").alias("v"))
        to = both.groupBy("a").agg(F.min(rank).alias("m")).select(F.col("a").alias("v"), F.least("m", own)["v"].alias("to"))
        to = if_small(staged(to.coalesce(n)))
        left = to.select(F.col("v").alias("a"), F.col("to").alias("a2"))
        right = to.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        nxt = live.join(left, "a").join(right, "b").where("a2 <> b2")
        nxt = staged(nxt.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct().coalesce(n))
        if names is None:
            names = to.select("v", F.col("to").alias("at"))
        else:
            hop = to.select(F.col("v").alias("at"), "to")
            names = staged(names.join(hop, "at", "left").select("v", F.coalesce("to", "at").alias("at")))
        live = nxt
    if names is None:
        return spark.createDataFrame([], f"v {vertex_type}, component {vertex_type}")
    least = if_small(staged(names.groupBy("at").agg(F.min("v").alias("component")).coalesce(tasks_for(spark, names.count()))))
    return staged(names.join(least, "at").select("v", "component"))
