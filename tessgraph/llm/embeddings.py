"""Embedding near-duplicates by randomised-rotation binary codes (op10).

Bit-equal vectors form one class first (a 128-bit key of the vector itself), so copies of one vector are one row.
Each class has the sign code of its rotated unit vector, the correction factor <code, vector>, and the rotated
vector in 8 bits. Classes of one length that agree in all signs of one of several further rotations meet in a
bucket; there the code gives an unbiased estimate of the inner product with a confidence bound, and only pairs
whose bound reaches the threshold are computed exactly from the whole vectors in double precision. The number of
bucket tables follows from the wanted recall at the threshold and from the number of classes of that length.
Large buckets are split into cells of pairs of chunks, so no task holds a whole bucket.

Vectors of different lengths never link; each length is searched for itself. Null, empty, zero vectors, and vectors
with null or non-finite components: link with nothing, own component, kept. Vectors are scaled by their largest
component before squaring, so any finite length will do. Repeated rows link like other copies, also under one id.
Null vec_id: counted as a vector; its component is the smallest id linked with it, or null and then kept. A cosine equal to the threshold
links. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components

MISS, SIGMAS, CHUNK, BUCKET = 1e-4, 4.0, 1024, 256


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(n: int, dim: int, least: float) -> tuple[int, int]:
    """(sign bits per table, tables): about BUCKET chance classes per bucket, and a miss rate of MISS at the threshold."""
    bits = min(max(round(math.log2(max(n, 2) / BUCKET)), 2), dim, 40)
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def units(values: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors; the largest component is divided out first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(values), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, cid, d, v of every row: class, length and little-endian doubles, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for e in b.column("embedding"):
                x = np.asarray(e.values.cast(pa.float64()).fill_null(np.nan), "<f8") if e.is_valid else np.zeros(0)
                fine = len(x) and np.isfinite(x).all() and x.any()
                v = (x + 0.0).tobytes() if fine else None  # + 0.0: both zeros are one
                rows.append((hashlib.blake2b(v, digest_size=16).digest() if fine else None, len(x) if fine else None, v))
            cid, d, v = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cid, pa.binary()), pa.array(d, pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "cid", "d", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cid binary, d int, v binary")


CODE = "d int, slot long, cid binary, code binary, corr float, scale float, q8 binary"


def coded(classes: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """d, slot (table and bucket), cid, code, corr, scale, q8: one row per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, tuple] = {}
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for dim in np.unique(lengths).tolist():
                bits, tables = sizes[dim]
                if dim not in turned:
                    turned[dim] = rotation(dim, 0), [rotation(dim, 1 + k)[:, :bits] for k in range(tables)]
                main, more = turned[dim]
                rows = batch.filter(pa.array(lengths == dim))
                for at in range(0, rows.num_rows, 4096):
                    part = rows.slice(at, 4096)
                    x = units(part.column("v").to_pylist(), dim)
                    y = x @ main
                    code, scale = np.packbits(y > 0, axis=1), np.abs(y).max(1) / 127
                    q8 = np.rint(y / scale[:, None]).astype(np.int8)
                    cols = [part.column("d"), part.column("cid"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array((np.abs(y).sum(1) / math.sqrt(dim)).astype(np.float32)), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in q8], pa.binary())]
                    for k, r in enumerate(more):
                        slot = (x @ r > 0) @ (1 << np.arange(bits, dtype=np.int64)) * tables + k
                        yield pa.RecordBatch.from_arrays([cols[0], pa.array(slot), *cols[1:]], names=["d", "slot", "cid", "code", "corr", "scale", "q8"])

    return classes.select("cid", "d", "v").mapInArrow(run, CODE)


def bounded(left: pa.Table, right: pa.Table, dim: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and right whose inner product may reach the threshold: estimate plus confidence bound."""
    sign = np.unpackbits(np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(left), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
    query = np.frombuffer(b"".join(right.column("q8").to_pylist()), np.int8).reshape(len(right), dim).astype(np.float32) * right.column("scale").to_numpy()[:, None]
    corr = left.column("corr").to_numpy()[:, None]
    room = SIGMAS * np.sqrt(np.maximum(1 - corr**2, 0)) / corr / math.sqrt(max(dim - 1, 1)) * math.sqrt(1 - least**2) + 0.02
    return np.nonzero(sign @ query.T / math.sqrt(dim) / corr + room >= least)


def candidates(codes: DataFrame, least: float) -> DataFrame:
    """a, b: pairs whose estimated inner product may reach the threshold, bucket cell by bucket cell.

    A task reads its cells one after the other, sorted; it holds one cell, of at most two chunks."""
    sizes = codes.groupBy("d", "slot").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("d", "slot", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    rows = codes.join(sizes, ["d", "slot"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "chunks")
    key = ["d", "slot", "i", "j"]

    def pairs(cell: pa.Table) -> pa.RecordBatch:
        dim, i, j = (cell.column(c)[0].as_py() for c in ("d", "i", "j"))
        mine = cell.column("mine").to_numpy()
        left, right = cell.filter(pa.array(mine == i)), cell.filter(pa.array(mine == j))
        a, b = [], []
        if len(left) and len(right):
            x, y = bounded(left, right, dim, least)
            p, q = (np.array(t.column("cid").to_pylist(), object)[k] for t, k in ((left, x), (right, y)))
            low, ok = p < q, p != q if i != j else p < q
            a, b = np.where(low, p, q)[ok], np.where(low, q, p)[ok]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            k = [t.column(c).to_numpy() for c in key]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], 0)) + 1).tolist(), len(t)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(a, z - a)
                if held is not None and all(held.column(c)[0].as_py() == part.column(c)[0].as_py() for c in key):
                    held = pa.concat_tables([held, part])
                    continue
                if held is not None:
                    yield pairs(held)
                held = part
        if held is not None:
            yield pairs(held)

    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "a binary, b binary").distinct()


def near(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = checkpoint(keyed(vectors))
    classes = checkpoint(rows.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("d").alias("d"), F.first("v").alias("v")))
    sizes = {r["d"]: tables_for(r["count"], r["d"], least) for r in classes.groupBy("d").count().collect()}  # one row a length
    pairs = candidates(coded(classes, sizes), least)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ok = b.column("d").to_numpy(), np.zeros(b.num_rows, bool)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, y = (units(b.column(c).take(pa.array(at)).to_pylist(), dim) for c in ("va", "vb"))
                ok[at] = (x * y).sum(1) >= least - 1e-12
                edge = at[np.abs((x * y).sum(1) - least) < 1e-12]
                for k in edge.tolist():  # at the threshold the order of the operations counts: as cosine is defined
                    p, q = (np.frombuffer(b.column(c)[k].as_py(), "<f8") for c in ("va", "vb"))
                    p, q = p / np.abs(p).max(), q / np.abs(q).max()
                    ok[k] = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= least
            yield b.select(["a", "b", "wa", "wb"]).filter(pa.array(ok))

    side = lambda s: classes.select(F.col("cid").alias(s), F.col("w").alias("w" + s), F.col("v").alias("v" + s), *([F.col("d")] if s == "a" else []))
    linked = checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(exact, "a binary, b binary, wa long, wb long"))
    degree = linked.select(F.col("a").alias("cid"), F.col("wb").alias("k")).union(linked.select("b", "wa")).groupBy("cid").agg(F.sum("k").alias("k"))
    comp = components(linked.select("a", "b")).withColumnRenamed("node", "cid")
    info = classes.select("cid", "w", "least").join(degree, "cid", "left").join(comp, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = info.groupBy("root").agg(F.min("least").alias("component"))
    info = checkpoint(info.join(first, "root").select("cid", (F.col("w") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), "component"))
    out = rows.select("vec_id", "cid").join(info, "cid", "left")
    one = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), one.alias("component_id"), F.coalesce(F.col("vec_id") == one, F.col("n_links").isNull() | one.isNull()).alias("kept"))
