"""Readers and writers of the text and raw formats: settings, color maps, models, features, labels, volumes.

All reads go through Spark's readers, so any store that Spark reaches will do. Raw volumes are one
binary file a volume and are unpacked in Arrow batches of whole slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxels that one Arrow batch of a raw volume holds.
BATCH = 1 << 20


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of one text file in file order; the file is one record, as line order is its meaning."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "line"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a settings file; reading stops at the first line without '='; the last of equal keys counts."""
    lines = numbered(spark, path)
    end = lines.agg(F.coalesce(F.min(F.when(~F.contains("line", F.lit("=")), F.col("pos"))), F.lit(2**31 - 1)).alias("end"))
    kept = lines.crossJoin(F.broadcast(end)).where("pos < end")  # one row
    pair = kept.select("pos", F.split("line", "=", 2).alias("p"))
    return pair.groupBy(F.get("p", F.lit(0)).alias("key")).agg(F.max_by(F.get("p", F.lit(1)), "pos").alias("value"))


def read_colormap(spark: SparkSession, path: str) -> DataFrame:
    """(label, class_idx, r, g, b) of lines 'label classIdx [r g b [name]]'; missing colors are derived from the index."""
    p = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = lambda k: F.get("p", F.lit(k)).cast("long")
    out = p.select(at(0).cast("int").alias("label"), at(1).alias("class_idx"), at(2).alias("r"), at(3).alias("g"), at(4).alias("b"))
    return out.withColumns({c: F.coalesce(c, d) for c, d in zip("rgb", color_of("class_idx"), strict=True)})


def color_of(index: str) -> list:
    """Red, green and blue of a color index: digits to the base 255, each at most 255."""
    i, cap = F.col(index), F.lit(255).cast("long")
    r = F.least(F.floor(i / 65025), cap)
    g = F.least(F.floor((i - r * 65025) / 255), cap)
    return [r, g, F.least(i - r * 65025 - g * 255, cap)]


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, value): the seven sizes of a model and its weights, in order."""
    v = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("pos", "value"))
    return v.select(F.when(F.col("pos") < 7, "size").otherwise("weight").alias("part"), F.when(F.col("pos") < 7, F.col("pos")).otherwise(F.col("pos") - 7).alias("pos"), F.col("value").cast("double").alias("value"))


def model_text(sizes: list[int], weights: DataFrame) -> DataFrame:
    """One row: the sizes, then the weights (pos, value) in order with nine significant digits.

    A model is a vector of fixed length, so that one row holds it."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.format_string("%.9g", x["value"])), "\n")
    return weights.agg(F.concat_ws("\n", F.lit("\n".join(map(str, sizes))), body).alias("value"))


def read_features(spark: SparkSession, path: str, n_regions: int | None = None) -> DataFrame:
    """(sid, label, idx, value) of lines 'label 1:v1 2:v2 ...'; a value without an index takes its position.

    With n_regions, a file of another number of lines is refused when the rows are read."""
    lines = numbered(spark, path)
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.select(F.col("pos").cast("long").alias("sid"), F.get(parts, F.lit(0)).cast("int").alias("label"), F.slice(parts, 2, 1 << 30).alias("p"))
    if n_regions is not None:
        n = lines.agg(F.count(F.lit(1)).alias("n"))
        rows = rows.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("n") == n_regions, "number of feature lines and of regions differ").isNull()).drop("n")
    e = rows.select("sid", "label", F.posexplode("p").alias("at", "t"))
    own = F.split("t", ":", 2)
    return e.select("sid", "label", F.when(F.contains("t", F.lit(":")), own[0].cast("int") - 1).otherwise(F.col("at")).alias("idx"), F.element_at(own, -1).cast("double").alias("value"))


def feature_lines(features: DataFrame, sparse: bool = False) -> DataFrame:
    """(sid, value) text lines of features (sid, label, f); sparse leaves zeros out."""
    t = F.transform("f", lambda x, i: F.struct((i + 1).alias("i"), x.cast("double").alias("x")))
    t = F.filter(t, lambda p: p["x"] != 0) if sparse else t
    return features.select("sid", F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform(t, lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("string"))), " ")).alias("value"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sid, label): one label a line, in region order."""
    return numbered(spark, path).where("trim(line) <> ''").select(F.col("pos").cast("long").alias("sid"), F.trim("line").cast("int").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Sorted parts of one label a line; the parts in name order make up the file."""
    labels.orderBy("sid").select(F.col("label").cast("string")).write.mode("overwrite").text(path)


def read_probabilities(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """(sid, label, p) of lines 'label cost0 cost1 ...': p = exp(-cost), scaled to sum 1."""
    parts = F.split(F.trim("line"), r"\s+")
    e = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.exp(-x.cast("double")))
    rows = numbered(spark, path).where("trim(line) <> ''").select(F.col("pos").cast("long").alias("sid"), (parts[0].cast("int") - int(one_based)).alias("label"), e.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("sid", "label", F.transform("e", lambda x: x / total).alias("p"))


def read_volume(spark: SparkSession, path: str, width: int, height: int, dtype: str = "int32") -> DataFrame:
    """(path, x, y, z, v) of raw little-endian volumes, z major."""
    kind = np.dtype(dtype).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                v = np.frombuffer(content.as_buffer(), kind)
                for at in range(0, len(v), BATCH):
                    k = np.arange(at, min(at + BATCH, len(v)))
                    cols = [k % width, k // width % height, k // (width * height), v[at : at + BATCH].astype(np.float64 if kind.kind == "f" else np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), *map(pa.array, cols)], names=["path", "x", "y", "z", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, x long, y long, z long, v {'double' if kind.kind == 'f' else 'long'}")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, sid, idx, value) of binary features: rows and columns as uint32, then float32 values, column by column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                buffer = content.as_buffer()
                rows, columns = (int(n) for n in np.frombuffer(buffer, "<u4", 2))
                v = np.frombuffer(buffer, "<f4", rows * columns, 8)
                for at in range(0, len(v), BATCH):
                    k = np.arange(at, min(at + BATCH, len(v)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k % rows), pa.array((k // rows).astype(np.int32)), pa.array(v[at : at + BATCH].astype(np.float64))], names=["path", "sid", "idx", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sid long, idx int, value double")
