"""Text and raw formats: what is written is read back, and the fixed rules of each reader hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessgraph.operators import models as M
from tessgraph.sources import files


def put(path, text):
    path.write_text(text)
    return str(path)


def test_settings_stop_at_first_line_without_sign(spark, tmp_path):
    p = put(tmp_path / "c", "a=1\nb=x=y\na=2\nend\nc=3\n")
    assert dict(files.read_settings(spark, p).collect()) == {"a": "2", "b": "x=y"}


def test_colormap(spark, tmp_path):
    p = put(tmp_path / "m", "0 0 0 0 0 back\n1 16646655\n2 254\n")
    assert sorted(map(tuple, files.read_colormap(spark, p).collect())) == [(0, 0, 0, 0, 0), (1, 16646655, 255, 255, 255), (2, 254, 0, 0, 254)]


def test_model_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, -2.25), (0, 0.5), (2, 1e-7)], "pos int, value double")
    text = files.model_text([3, 2, 1, 1, 1, 1, 0], w).first()[0]
    back = files.read_model(spark, put(tmp_path / "w", text + "\n")).collect()
    assert [r.value for r in sorted((r for r in back if r.part == "weight"), key=lambda r: r.pos)] == [0.5, -2.25, 1e-7]
    assert [r.value for r in sorted((r for r in back if r.part == "size"), key=lambda r: r.pos)] == [3, 2, 1, 1, 1, 1, 0]


@pytest.mark.parametrize("sparse", [False, True])
def test_feature_round_trip(spark, tmp_path, sparse):
    f = spark.createDataFrame([(0, 1, [0.0, 2.5]), (1, 0, [1.0, 0.0])], "sid long, label int, f array<double>")
    lines = [r.value for r in files.feature_lines(f, sparse).orderBy("sid").collect()]
    got = files.read_features(spark, put(tmp_path / "f", "\n".join(lines) + "\n"), 2).where("value <> 0").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2.5), (1, 0, 0, 1.0)]


def test_feature_file_of_wrong_length_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="differ"):
        files.read_features(spark, put(tmp_path / "f", "1 5 6\n"), 2).collect()


def test_labels_and_probabilities(spark, tmp_path):
    assert sorted(map(tuple, files.read_labels(spark, put(tmp_path / "l", "2\n0\n1\n")).collect())) == [(0, 2), (1, 0), (2, 1)]
    row = files.read_probabilities(spark, put(tmp_path / "p", f"2 {np.log(4)} {np.log(4 / 3)}\n")).first()
    assert row.label == 1 and np.allclose(row.p, [0.25, 0.75])
    d = spark.createDataFrame([(1, 5), (0, 7)], "sid long, label int")
    files.write_labels(d, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split() == ["7", "5"]


def test_raw_volume_and_matrix(spark, tmp_path):
    v = np.arange(24, dtype="<i4").reshape(2, 3, 4)
    (tmp_path / "v.raw").write_bytes(v.tobytes())
    got = files.read_volume(spark, str(tmp_path / "v.raw"), 4, 3).collect()
    assert len(got) == 24 and all(v[r.z, r.y, r.x] == r.v for r in got)
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "m.bin").write_bytes(np.array([2, 3], "<u4").tobytes() + m.tobytes(order="F"))
    assert all(m[r.sid, r.idx] == r.value for r in files.read_matrix(spark, str(tmp_path / "m.bin")).collect())


def test_components_join_at_corners_and_drop_small(spark):
    art = ["##...", "..#..", ".....", "#...#"]
    px = spark.createDataFrame([(y * 5 + x, x, y, int(c == "#")) for y, line in enumerate(art) for x, c in enumerate(line)], "k long, x long, y long, gt int")
    got = sorted(map(tuple, M.mask_components(px, least=2).collect()))
    assert got == [(0, 0, 3), (1, 0, 3), (7, 0, 3)]
    assert M.mask_components(px.where("false")).count() == 0


def test_hops_on_a_path(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(9)], "hi long, lo long")
    got = M.hops(spark.createDataFrame([(0,)], "sid long"), e, 4)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(5)]


def test_two_classes_count_half_for_each_order(spark):
    e = spark.createDataFrame([(1, 0, 1)], "hi long, lo long, gradient_idx int")
    y = spark.createDataFrame([(0, 0), (1, 1)], "sid long, label int")
    assert sorted(map(tuple, M.psi_edges(e, y, 2).collect())) == [(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.5), (1, 2, 0.5)]
    assert M.best_label(y.select("sid", F.explode(F.array(F.lit(1), F.lit(0))).alias("label"), F.lit(1.0).alias("score"))).agg(F.sum("label")).first()[0] == 0
