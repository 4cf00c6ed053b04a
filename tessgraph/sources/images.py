"""Image and volume files as pixel rows, and back: PNG, TIFF (one page a slice), NRRD, and raw cubes with a text side-car.

Reading: Spark lists and reads the files (so any store it knows will do), one task decodes a file. Writing: one file per
image, encoded where the image is grouped, and stored through the same file systems. Pixel rows are path, x, y, z and c0
(c1, c2 for colors). Files of another depth or compression than named below are an error, never a guess.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NRRD type names and TIFF (bits, sample format) as numpy types.
NRRD = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "int": "i4", "float": "f4", "double": "f8"}
TIFF = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def decode_png(b: bytes) -> np.ndarray:
    """[y, x, channel] of a PNG of 8 or 16 bits, gray, gray with alpha, RGB or RGBA, not interlaced."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at < len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", b[at + 8 : at + 21])
        elif kind == b"IDAT":
            data.append(b[at + 8 : at + 8 + n])
        at += 12 + n
    width, height, bits, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if channels is None or bits not in (8, 16) or interlaced:
        raise ValueError(f"PNG of color type {color}, {bits} bits, interlace {interlaced} is not supported")
    step = channels * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(width, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = line.astype(int).tolist()
            up = above.tolist()
            for i in range(len(line)):
                a, c = (line[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    p = a + up[i] - c
                    guess = min((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + guess) & 255
            line = np.array(line, np.uint8)
        out[y] = above = line
    return out.view(">u2" if bits == 16 else np.uint8).reshape(height, width, channels)


def encode_png(v: np.ndarray) -> bytes:
    """A PNG of 8 or 16 bits of [y, x, channel] with 1 to 4 channels."""
    v = np.atleast_3d(v)
    bits = 16 if v.dtype.itemsize == 2 else 8
    rows = v.astype(">u2" if bits == 16 else np.uint8).reshape(len(v), -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], bits, {1: 0, 2: 4, 3: 2, 4: 6}[v.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_tiff(b: bytes) -> np.ndarray:
    """[z, y, x, channel] of an uncompressed TIFF in strips; pages are slices and must be alike."""
    end = {b"II": "<", b"MM": ">"}.get(b[:2])
    if end is None or struct.unpack(end + "H", b[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    sizes = {1: "B", 3: "H", 4: "I"}
    at, pages = struct.unpack(end + "I", b[4:8])[0], []
    while at:
        n = struct.unpack(end + "H", b[at : at + 2])[0]
        tags = {}
        for k in range(n):
            e = at + 2 + 12 * k
            tag, kind, count = struct.unpack(end + "HHI", b[e : e + 8])
            if kind in sizes:
                size = struct.calcsize(sizes[kind]) * count
                start = e + 8 if size <= 4 else struct.unpack(end + "I", b[e + 8 : e + 12])[0]
                tags[tag] = struct.unpack(f"{end}{count}{sizes[kind]}", b[start : start + size])
        one = lambda t, d: tags.get(t, (d,))[0]
        if one(259, 1) != 1 or one(284, 1) != 1:
            raise ValueError("compressed or planar TIFF files are not supported")
        kind = TIFF.get((one(258, 1), one(339, 1)))
        if kind is None:
            raise ValueError(f"TIFF of {one(258, 1)} bits, sample format {one(339, 1)} is not supported")
        data = b"".join(b[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
        pages.append(np.frombuffer(data, end + kind).reshape(one(257, 0), one(256, 0), one(277, 1)))
        at = struct.unpack(end + "I", b[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return np.stack(pages)


def encode_tiff(v: np.ndarray) -> bytes:
    """An uncompressed little-endian TIFF of [z, y, x, channel], one page a slice, one strip a page."""
    depth, height, width, channels = v.shape
    bits, kind = v.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    out, at = [b"II*\0" + struct.pack("<I", 8)], 8
    for z in range(depth):
        data = v[z].astype(v.dtype.newbyteorder("<")).tobytes()
        tags = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, 1), (262, 3, 2 if channels >= 3 else 1), (273, 4, 0), (277, 3, channels), (278, 4, height), (279, 4, len(data)), (339, 3, kind)]
        more = b"" if channels < 3 else struct.pack(f"<{channels}H", *[bits] * channels) + struct.pack(f"<{channels}H", *[kind] * channels)
        table = 2 + 12 * len(tags) + 4
        start = at + table + len(more)
        entries = []
        for tag, t, x in tags:
            count = 1
            if more and tag in (258, 339):
                count, x = channels, at + table + (0 if tag == 258 else 2 * channels)
            x = start if tag == 273 else x
            entries.append(struct.pack("<HHI", tag, t, count) + (struct.pack("<HH", x, 0) if t == 3 and count == 1 else struct.pack("<I", x)))
        at = start + len(data) + len(data) % 2
        out += [struct.pack("<H", len(tags)), *entries, struct.pack("<I", at if z + 1 < depth else 0), more, data, b"\0" * (len(data) % 2)]
    return b"".join(out)


def decode_nrrd(b: bytes) -> np.ndarray:
    """[z, y, x, 1] of a NRRD file with its data inside, raw or gzip."""
    head, _, data = b.partition(b"\n\n")
    lines = head.decode("ascii", "replace").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not a NRRD file")
    field = dict(x.split(": ", 1) for x in lines[1:] if ": " in x and not x.startswith("#"))
    kind, encoding = NRRD.get(field["type"]), field.get("encoding", "raw")
    if kind is None or encoding not in ("raw", "gzip", "gz") or "data file" in field:
        raise ValueError(f"NRRD of type {field['type']}, encoding {encoding} is not supported")
    sizes = [int(x) for x in field["sizes"].split()]
    sizes += [1] * (3 - len(sizes))
    order = ">" if field.get("endian") == "big" else "<"
    return np.frombuffer(gzip.decompress(data) if encoding != "raw" else data, order + kind).reshape(*reversed(sizes), 1)


def encode_nrrd(v: np.ndarray) -> bytes:
    """A raw NRRD file of [z, y, x, 1]."""
    names = {"u1": "uchar", "u2": "ushort", "u4": "uint", "i4": "int", "f4": "float", "f8": "double"}
    z, y, x, _ = v.shape
    head = f"NRRD0001\ntype: {names[v.dtype.str[1:]]}\ndimension: 3\nsizes: {x} {y} {z}\nendian: little\nencoding: raw\n\n"
    return head.encode() + v.astype(v.dtype.newbyteorder("<")).tobytes()


def decode(path: str, b: bytes) -> np.ndarray:
    """[z, y, x, channel] by the file's own first bytes."""
    if b[:4] == b"NRRD":
        return decode_nrrd(b)
    if b[:2] in (b"II", b"MM"):
        return decode_tiff(b)
    if b[:4] == b"\x89PNG":
        return decode_png(b)[None]
    raise ValueError(f"{path} is neither PNG, TIFF nor NRRD")


def read(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """path, x, y, z, c0 ... of every pixel of the image files at path (a file, folder or pattern); all have that many channels."""
    names = [f"c{k}" for k in range(channels)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at, b in zip(pdf["path"], pdf["content"], strict=True):
                v = decode(at, b)
                if v.shape[3] != channels:
                    raise ValueError(f"{at} has {v.shape[3]} channels, not {channels}")
                for z in range(len(v)):  # a slice at a time
                    y, x = np.indices(v.shape[1:3]).reshape(2, -1)
                    yield pd.DataFrame({"path": at, "x": x, "y": y, "z": z} | {n: v[z, :, :, k].ravel().astype(float) for k, n in enumerate(names)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda parts: run(parts), "path string, x long, y long, z long, " + ", ".join(f"{n} double" for n in names))


def read_slices(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """The images of a folder as one volume: z is the place of a file among the sorted paths."""
    px = read(spark, path, channels)
    order = spark.read.format("binaryFile").load(path).select("path")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    place = order.withColumn("place", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))  # one row a file
    return px.join(place, "path").drop("z", "path").withColumnRenamed("place", "z")


ENCODERS = {"png": lambda v: encode_png(v[0]), "tif": encode_tiff, "nrrd": encode_nrrd}


def encoded(px: DataFrame, values: tuple[str, ...] = ("v",), kind: str = "png", dtype: str = "u1") -> DataFrame:
    """image, content: the file of every image of px (image, x, y[, z], values); pixels that are not there are 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf["z"] if "z" in pdf else pdf["x"] * 0
        v = np.zeros((int(z.max()) + 1, int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, len(values)), dtype)
        for k, name in enumerate(values):
            v[z, pdf["y"], pdf["x"], k] = pdf[name]
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "content": [ENCODERS[kind](v)]})

    return px.groupBy("image").applyInPandas(lambda pdf: run(pdf), "image long, content binary")


def overlay(px: DataFrame, alpha: float = 0.5, colors: tuple[tuple[int, int, int], ...] = ((0, 0, 0), (254, 2, 254), (0, 0, 254))) -> DataFrame:
    """px (image, x, y, v, label) with r, g, b: the gray value mixed with the color of its label."""
    from pyspark.sql import functions as F

    table = [F.array(*[F.lit(c[k]) for c in colors]) for k in range(3)]
    mixed = [(F.col("v") * (1 - alpha) + F.get(table[k], F.col("label")) * alpha).cast("int").alias(n) for k, n in enumerate("rgb")]
    return px.select(*px.columns, *mixed)


def raw_cube(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, v of a raw cube of bytes, its sizes in a side-car path.nfo of lines "cubeDepth n", "cubeHeight n", "cubeWidth n", "type uchar".

    The cube is read in records of one row, so a file of any size is split over tasks."""
    info = dict(line.split(None, 1) for line in spark.sparkContext.wholeTextFiles(path + ".nfo").values().first().splitlines() if line.strip())
    if info.get("type", "uchar").strip() != "uchar":
        raise ValueError(f"cube of type {info['type']} is not supported")
    depth, height, width = (int(info[f"cube{k}"]) for k in ("Depth", "Height", "Width"))
    rows = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "at long, line binary").where(F.col("at") < depth * height)
    value = F.conv(F.hex(F.expr("substring(line, cast(x as int) + 1, 1)")), 16, 10).cast("int")
    return df.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))).select("x", (F.col("at") % height).alias("y"), F.floor(F.col("at") / height).alias("z"), value.alias("v"))
