"""Shared helpers: durable cuts of lineage, document keys, vectorised text hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1
CHUNK_BYTES = 1 << 19  # text handled at once by the vectorised kernels
BATCH_BYTES = 4 << 20  # bytes of one Arrow batch between the JVM and Python
REST_S, EXECUTORS_REST_S = 5, 15  # seconds between two rests of the driver's JVM, and of the executors'
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, may go without: it gets a
    temporary folder.  On a cluster a missing setting is an error, as no other folder is known to be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes, since texts have no bound in rows.

    Operators begin with it, so the JVMs rest here before Python workers take texts.
    """
    rest(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and reread it: lineage ends there, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rest(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_rested = [float("-inf"), float("-inf")]


def rest(spark: SparkSession):
    """The driver's JVM collects what ended plans and their broadcasts left and hands free pages back, at most every REST_S seconds.

    Left alone, it grows its heap before it looks for garbage, and what the compiler threads free stays with the
    C library.  Shuffle files that nothing refers to go at the same time.  A small query runs before: the listeners'
    threads hold the last event, and with it the plan and the shuffle files of the query that ended last.  At most every
    EXECUTORS_REST_S seconds its tasks, one a core, have the executors' JVMs collect, which keep a grown heap, too,
    while the Python workers beside them need the memory.
    """
    if time.monotonic() - _rested[0] < REST_S:
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    everywhere = time.monotonic() - _rested[-1] >= EXECUTORS_REST_S
    n = spark.sparkContext.defaultParallelism if everywhere else 1
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')" if everywhere else "id")).write.format("noop").mode("overwrite").save()
    if everywhere:
        _rested[-1] = time.monotonic()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JError:
        pass  # listeners that lag: the next rest lets go of more
    jvm.System.gc()
    try:  # by reflection, as the bean server's own class is not open
        named = jvm.java.lang.Class.forName
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass  # another JVM: it keeps its pages
    _rested[0] = time.monotonic()


def keyed(docs: DataFrame) -> DataFrame:
    """(k, did, text): did orders documents (null ids last), k identifies rows.

    k is doc_id where ids are unique and not null, else a hash of id and text; then equal
    rows share k, and since they hold the same text they get the same result.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    k = F.xxhash64("doc_id", "text") if odd else F.col("doc_id")
    return docs.select(
        F.coalesce(k, F.lit(0)).alias("k"),
        F.coalesce("doc_id", F.lit(MAX_ID)).alias("did"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def doc_id(did="did"):
    """The document's id again, null where it was null."""
    did = F.col(did) if isinstance(did, str) else did
    return F.when(did != MAX_ID, did).alias("doc_id")


# ---------------------------------------------------------------- vectorised hashing
def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), in place on a fresh array."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)

            def powers(b):
                out = np.full(n, b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xD6E8FEB86659FD93)


class PrefixHash:
    """Prefix polynomial hashes of an array: the hash of any slice in constant time."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        up, self.down = powers.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:n] if n else values.astype(np.uint64), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def fixed(self, width: int) -> np.ndarray:
        """The hash of every slice of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """Bytes of a column of texts, with offsets; null is empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        _, offsets, data = column.buffers()
        n = len(column)
        self.offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        base = self.offsets[0]
        self.data = np.frombuffer(data, np.uint8)[base : self.offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.offsets = self.offsets - base

    def words(self):
        """Starts and ends of the words, and each document's first word (with the total last)."""
        solid = ~SPACE[self.data]
        n = len(solid)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        edge[0] = edge[n] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, lower=False):
        starts, ends, first = self.words()
        data = LOWER[self.data] if lower else self.data
        h = PrefixHash(data, BYTE_POWERS).slices(starts, ends)
        return starts, ends, first, mix(h + (ends - starts).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def chunks(column_lengths: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows whose texts together stay near the limit; a longer text is alone."""
    at, n = 0, len(column_lengths)
    total = np.concatenate([[0], np.cumsum(column_lengths)])
    while at < n:
        end = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


#: What a Python worker keeps between tasks: (owner, a function that lets go of it).
kept: list = []


def hand_back():
    """Hand pages that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the allocator keeps its pages


def let_go(owner: str | None):
    """Drop what other kernels keep in this worker, which Spark reuses, and hand the pages back."""
    others = [k for k in kept if k[0] != owner]
    if others:
        kept[:] = [k for k in kept if k[0] == owner]
        for _, drop in others:
            drop()
        hand_back()


def text_chunks(batch: pa.RecordBatch, column="text", limit: int = CHUNK_BYTES, owner: str | None = None):
    """The batch in slices of bounded text, for a kernel that keeps things under that owner's name."""
    import pyarrow.compute as pc

    let_go(owner)
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in chunks(lengths, limit):
        yield batch.slice(a, b - a)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def within(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Mask over positions: a slice of that width starting there stays in one document."""
    ok = np.zeros(max(total, 0), bool)
    lens = np.diff(first)
    doc_end = np.repeat(first[1:], lens)
    ok[:] = np.arange(total) + width <= doc_end
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)
