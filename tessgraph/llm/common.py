"""Shared pieces: the table reader, bounded Arrow slices, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python step holds in expanded form at once.
SLICE_CHARS = 1 << 20
#: Bits of the bitmaps that tell scorers which keys may matter.
BITS = 1 << 24
#: Edges that one task joins.
ONE_TASK_EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_few(df: DataFrame) -> DataFrame:
    """checkpoint() in few files, for rows of ids and numbers: up to four for each core, or an eighth of the shuffle partitions if that is more.

    For each file and its checksum an executor's JVM starts a chmod (Hadoop's local file system without its native library),
    and until that has begun, the child has the JVM's whole memory as its own."""
    spark = df.sparkSession
    return checkpoint(df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def released(x=None):
    """x, after the memory that this Python worker has freed went back to the machine: the worker waits for its next task without it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return x


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where none is set, a local master (tests) gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written and that nothing reads any more, through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_slices(batch: pa.RecordBatch, column: str = "text", max_chars: int = SLICE_CHARS, values: bool = True) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of at most max_chars characters (one row at least), with their texts (if values); null is an empty text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_chars:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(column).to_pylist()] if values else []
            start, held = i, 0
        held += n
    if start < len(sizes):
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(column).to_pylist()] if values else []


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def word_arrays(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, split in C.

    Returns (indices into the distinct words, word count of each text, the distinct words as Arrow binary)."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    if lower:
        split = [[w.lower() for w in ws] if not (b := b" ".join(ws)).islower() and b else ws for ws in split]
    counts = np.fromiter((len(x) for x in split), np.int64, len(split))
    flat = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, flat.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit keys of distinct words (SipHash with a fixed key: the same on every executor)."""
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def inside(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (keys != 0)


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size, built from distinct positions (at most BITS of them, 2 MB packed)."""
    out = np.zeros(BITS // 8, np.uint8)
    at = f"({column} & {BITS - 1})"
    rows = keys.select(F.expr(f"shiftright({at}, 3) AS byte"), F.expr(f"shiftleft(1, int({at} & 7)) AS bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of shuffles and checkpoints that nothing refers to any more, now that both collectors see it.

    Two things keep the last query's files longer: handles that Python gives up are passed to the JVM by a thread that sleeps
    up to a second, and Spark's listeners hold the event of the last query, and so its plan, until another one ends."""
    gc.collect()
    spark.range(1).collect()
    given_up = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    for _ in range(60):
        if not given_up:
            break
        time.sleep(0.05)
    time.sleep(0.1)  # the last one is on its way
    spark._jvm.System.gc()


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) from all edges (u, v) that the task gets, by union-find."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(u, u), up.setdefault(v, v)
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable. At most ONE_TASK_EDGES edges are joined by one task; more take
    large-star and small-star rounds until nothing changes.

    The rounds are joins and aggregates on node ids with a checkpoint each; only a count of changed rows reaches the driver."""
    e = checkpoint_few(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n = e.count()
    if n <= ONE_TASK_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        return checkpoint(e.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        nxt = checkpoint_few(small)
        if nxt.exceptAll(e).isEmpty() and nxt.count() == e.count():
            break
        e = nxt
        tidy(edges.sparkSession)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def tokenizer_path(name: str) -> str:
    """The installed public vocabulary files; an own path may be given wherever this is the default."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
