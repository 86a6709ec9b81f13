"""Helpers shared by the training-data operators: shared storage, loading, packing, components."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, read only by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset (tests) below the local temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/brindle-checkpoint"
    path = f"{root.rstrip('/')}/brindle-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor
    costs no recomputation. Files are removed when the application ends, the job's shuffle files when it is written."""
    spark = df.sparkSession
    path = shared_dir(spark)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a :func:`cut` table that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def small_batches(spark: SparkSession, most: int = 4 * MB) -> None:
    """From now on Arrow batches of the session hold at most ``most`` bytes, so that a Python worker's memory does not follow the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name)))
    if not size or not 0 < int(size[1]) <= most:
        spark.conf.set(name, str(most))


def steady_scans(spark: SparkSession) -> None:
    """From now on the session cuts files into the same scan partitions, whatever executors come or go, so that a table read twice is numbered alike."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy(run):
    """``run`` as a task of its own: what a Python worker has freed goes back to the system before other tasks use the worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def crc_fold(col: str, folds: int) -> F.Column:
    """crc32 of the id as decimal text, modulo ``folds``; a null id falls in no fold (null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(folds))


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


#: A-Z lowered and every byte that belongs to no word made a space; words are runs of ASCII letters, digits and bytes above 127.
AS_WORDS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Memo(dict):
    """A function of words that remembers its values, at most ``most`` at a time."""

    def __init__(self, f, most: int = 300_000) -> None:
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.f(word)
        return out


def word_stream(raw: list[bytes], memo: Memo, dtype: type, piece: int = MB) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one after another: the lowered bytes, where each word starts in them, its value by ``memo``, and the word at which each text starts (one more at the end).
    Words are cut out piece by piece, so that a long text never stands as a list of all its words."""
    low = b" ".join(raw).translate(AS_WORDS)
    inside = np.frombuffer(b" " + low, np.uint8) != 32
    at = np.flatnonzero(inside[1:] & ~inside[:-1])
    values = np.empty(len(at), dtype)
    lo = done = 0
    while lo < len(low):
        hi = lo + piece
        if hi < len(low):
            hi = low.find(b" ", hi)
            hi = len(low) if hi < 0 else hi
        words = low[lo:hi].split()
        values[done : done + len(words)] = np.fromiter(map(memo.__getitem__, words), dtype, len(words))
        done, lo = done + len(words), hi
    starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return low, at, values, np.searchsorted(at, starts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads the bits of each uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(rows: Iterator[dict], schema: pa.Schema, flush: int = 8 * MB) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``flush`` bytes from dictionaries whose large values are bytes."""
    cols: dict[str, list] = {n: [] for n in schema.names}
    size = count = 0
    for r in rows:
        for n in schema.names:
            v = r.get(n)
            cols[n].append(v)
            size += len(v) if isinstance(v, bytes) else 8
        count += 1
        if size >= flush or count >= 20_000:
            yield pa.RecordBatch.from_pydict(cols, schema=schema)
            cols, size, count = {n: [] for n in schema.names}, 0, 0
    if count:
        yield pa.RecordBatch.from_pydict(cols, schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` by alternating large-star and small-star rounds.

    Every round is one shuffle by vertex; a hub is not gathered: its minimum neighbour comes from a partial
    aggregation and returns by a join. Rounds grow with the logarithm of the diameter. Returns ``(v, component)``, one row per
    vertex that has an edge, ``component`` being the smallest vertex reached. Self links and repeats are ignored.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        # large star: each vertex links its larger neighbours to its smallest neighbour or itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: each vertex links its smaller neighbours and itself to the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        # a star forest has no vertex that is both a leaf and a centre, and one centre for each leaf
        leaves = new.select(F.col("u").alias("x"))
        tangled = not leaves.join(new.select(F.col("v").alias("x")).distinct(), "x", "left_semi").isEmpty()
        drop_cut(e)
        e = new
        if not tangled:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(
        e.select("v", F.col("v").alias("component")).distinct()
    )


def default_tokenizer(name: str) -> str:
    """Path of a public vocabulary file; its folder can be set with PUBLIC_TOKENIZERS_DIR."""
    folder = os.environ.get("PUBLIC_TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


LETTER = re.compile(r"[^\W\d_]")
