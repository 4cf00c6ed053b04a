"""Image formats: round trips, files put together by hand, and pixels through Spark."""

import struct
import zlib

import numpy as np
import pytest

from tessgraph.sources import images as G

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 1), (4, 3, 3), (6, 2, 4)])
@pytest.mark.parametrize("dtype", ["u1", "u2"])
def test_png(shape, dtype):
    v = RNG.integers(0, 250, shape).astype(dtype)
    assert (G.decode_png(G.encode_png(v)) == v).all()


def test_png_filters():
    v = RNG.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    raw, up = b"", np.zeros(18, int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = v[y].ravel().astype(int)
        a, c = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = a + up - c
        near = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        raw += bytes([kind]) + ((line - (0 * a, a, up, (a + up) // 2, near)[kind]) % 256).astype(np.uint8).tobytes()
        up = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (G.decode_png(png) == v).all()
    with pytest.raises(ValueError):
        G.decode_png(b"GIF89a")


@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "i4", "f4", "f8"])
@pytest.mark.parametrize("shape", [(1, 2, 3, 1), (3, 5, 3, 1), (2, 3, 4, 3)])
def test_tiff_and_nrrd(shape, dtype):
    v = RNG.integers(0, 250, shape).astype(dtype)
    back = G.decode("t", G.encode_tiff(v))
    assert (back == v).all() and back.dtype == v.dtype
    if shape[3] == 1:
        assert (G.decode("n", G.encode_nrrd(v)) == v).all()


def test_pixels_through_spark(spark, tmp_path):
    v = RNG.integers(0, 256, (2, 3, 4)).astype(np.uint8)
    px = spark.createDataFrame([(m, x, y, int(v[m, y, x])) for m in range(2) for y in range(3) for x in range(4)], "image long, x long, y long, v int")
    for r in G.encoded(px).collect():
        (tmp_path / f"s{r.image}.png").write_bytes(r.content)
    assert {(r.z, r.y, r.x, int(r.c0)) for r in G.read_slices(spark, str(tmp_path)).collect()} == {(m, y, x, int(v[m, y, x])) for m in range(2) for y in range(3) for x in range(4)}
    (tmp_path / "cube").write_bytes(v.tobytes())
    (tmp_path / "cube.nfo").write_text("cubeDepth 2\ncubeHeight 3\ncubeWidth 4\ntype uchar\n")
    assert {tuple(r) for r in G.raw_cube(spark, str(tmp_path / "cube")).collect()} == {(x, y, m, int(v[m, y, x])) for m in range(2) for y in range(3) for x in range(4)}
    mixed = G.overlay(px.selectExpr("*", "cast(x % 3 as int) label")).first()
    assert (mixed.r, mixed.g, mixed.b) == (int(mixed.v * 0.5 + 0.5 * (0, 254, 0)[mixed.label]), int(mixed.v * 0.5 + 0.5 * (0, 2, 0)[mixed.label]), int(mixed.v * 0.5 + 0.5 * (0, 254, 254)[mixed.label]))
