"""Registry, part three: tiles, edge sets, labels, features, scores and labelings by inference, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import models as M
from ..operators import pixelwise as P
from ..operators import regions as R
from ..operators import slic as S
from ..sources.views import STEP, WIDTH, pixels, voxels
from . import catalog_models as C
from .catalog import ORACLE_SQL, PX, QUERIES, VX, query

__all__ = ["ORACLE_SQL", "QUERIES"]
LONG = ", lg AS (SELECT a.sid AS hi, b.sid AS lo FROM node a, node b WHERE a.sid > b.sid AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 500)"
#: Weights of two classes that favour equal labels, by gradient level; and of three, by the formula of the fixtures, scaled down.
TWO = [x for g in range(5) for x in (2.0 + g, 0.0, 0.0, 2.0 + g)]
THREE = [(p * 37 % 11 - 5) / 4 for p in range(5 * 9)]


def nodes(s, d):
    return R.stats(pixels(s, d))


def of_image(df, image=0):
    return df.withColumn("image", F.lit(image).cast("long"))


def inferred(method, weights, classes, **options):
    def run(s, d):
        sc = C.scores(s, d).where(F.col("label") < classes).select("sid", "label", (F.pmod("score", F.lit(7)) - 3).alias("score"))
        e = C.attributes(s, d).select("hi", "lo", "gradient_idx")
        return I.labeled(of_image(sc), of_image(e), M.pair_model(s, weights, classes, 5), classes, method, **options)

    return run


query("tiles_any_step", f"SELECT k, (x // 7) * CAST(ceil(h / 7) AS BIGINT) + y // 7 AS sid FROM px")(lambda s, d: P.tiles(pixels(s, d), 7, {"x": WIDTH, "y": F.col("h")}).select("k", "sid"))  # noqa: F541
query("whole_image", "SELECT k, 0::BIGINT AS sid FROM px")(lambda s, d: P.tiles(pixels(s, d), -2, {}).select("k", "sid"))
query("cubes_any_step", ", g AS (SELECT (max(z) + 1) AS dz FROM vx), t AS (SELECT least(4, dz) AS t FROM g) SELECT x, y, z, (z // t) * 9 + (x // 4) * 3 + y // 4 AS sid FROM vx, t", VX)(lambda s, d: P.tiles(voxels(s, d).crossJoin(F.broadcast(voxels(s, d).agg((F.max("z") + 1).alias("dz")))), 4, {"z": F.col("dz"), "x": 10, "y": 10}, ("z", "x", "y")).select("x", "y", "z", "sid"))
query("region_at_point", "SELECT sid FROM px WHERE x = 7 AND y = 11")(lambda s, d: P.region_at(pixels(s, d), x=7, y=11))
query("edge_order", "SELECT hi, lo, row_number() OVER (ORDER BY hi, lo) - 1 AS edge_no FROM edge")(lambda s, d: P.edge_order(C.edges(s, d)))
query("directed_edge_ids", ", n AS (SELECT count(*) AS n FROM node), b AS (SELECT hi AS sid, lo AS nb FROM edge UNION ALL SELECT lo, hi FROM edge) SELECT sid, nb, sid * n + nb AS edge_id FROM b, n")(lambda s, d: P.directed_ids(C.edges(s, d), nodes(s, d).agg(F.count(F.lit(1)).alias("n"))))
query("edges_with_long_range", LONG + " SELECT hi, lo, min(far) AS far FROM (SELECT hi, lo, 0 AS far FROM edge UNION ALL SELECT hi, lo, 1 FROM lg) GROUP BY hi, lo")(lambda s, d: P.with_long_edges(C.edges(s, d), R.long_edges(nodes(s, d))))
query("hop_edges", ", b AS (SELECT hi AS a, lo AS b FROM edge UNION SELECT lo, hi FROM edge), h2 AS (SELECT DISTINCT p.a, q.b FROM b p JOIN b q ON p.b = q.a WHERE p.a <> q.b), h3 AS (SELECT DISTINCT p.a, q.b FROM h2 p JOIN b q ON p.b = q.a WHERE p.a <> q.b), u AS (SELECT a, b, 1 AS h FROM b UNION ALL SELECT a, b, 2 FROM h2 UNION ALL SELECT a, b, 3 FROM h3) SELECT a AS hi, b AS lo, min(h) AS hops FROM u WHERE a > b GROUP BY a, b")(lambda s, d: P.hop_edges(C.edges(s, d), 3))
query("labels_or_other", ", c AS (SELECT sid, count(*) AS n, count(*) FILTER (gt = 0) AS b FROM px GROUP BY sid) SELECT sid, CASE WHEN n - b > 0.6::DOUBLE * n THEN 1 WHEN b > 0.6::DOUBLE * n THEN 0 ELSE 2 END AS label FROM c")(lambda s, d: P.label_or_other(pixels(s, d), 0.6))
for _scale, _sql in (("seven", "label * 255 / 7"), ("half", "label / 2 * 255"), ("classes", "label / 2 * 255")):
    query(f"back_projection_{_scale}", f"SELECT k, CAST(trunc({_sql}) AS INT) AS v FROM px JOIN lab ON lab.sid = px.sid")(lambda s, d, z=_scale: P.back_projected(pixels(s, d), C.truth(s, d), z))
query("costs", "SELECT sid, round(-ln(least(1.0::DOUBLE, mean / 256 + 1e-10)), 9) AS cost, round(ln(least(1.0::DOUBLE, mean / 256 + 1e-10)), 9) AS score FROM node")(lambda s, d: P.costs(nodes(s, d).select("sid", (F.col("mean") / 256).alias("p"))).select("sid", F.round("cost", 9).alias("cost"), F.round("score", 9).alias("score")))
query("color_codes", "SELECT k, c, c // 65025 AS r, c % 65025 // 255 AS g, c % 255 AS b FROM (SELECT k, (v % 255) * 65025 + (x * 5 % 255) * 255 + y % 255 AS c FROM px)")(lambda s, d: pixels(s, d).selectExpr("k", "v % 255 r", "x * 5 % 255 g", "y % 255 b").select("k", P.color_code("r", "g", "b").alias("c")).select("k", "c", *P.color_of(F.col("c"))))
query("hsv", ", c AS (SELECT k, v::DOUBLE AS r, (x * 5)::DOUBLE AS g, (y % 256)::DOUBLE AS b FROM px), mm AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS dl FROM c), hh AS (SELECT *, CASE WHEN dl = 0 THEN 0 WHEN mx = r THEN 60 * (g - b) / dl WHEN mx = g THEN 120 + 60 * (b - r) / dl ELSE 240 + 60 * (r - g) / dl END AS hue FROM mm) SELECT k, CAST(floor(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2 + 0.5) AS INT) AS h, CAST(floor(CASE WHEN mx = 0 THEN 0 ELSE 255 * dl / mx END + 0.5) AS INT) AS s, CAST(mx AS INT) AS v FROM hh")(lambda s, d: pixels(s, d).selectExpr("k", "v r", "x * 5 g", "y % 256 b").select("k", *P.hsv("r", "g", "b")))
HIST = ", hs AS (SELECT sid, CAST(v * 10 // 256 AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL)"
query("histogram_l1", HIST + " SELECT sid, bin, n / sum(n) OVER (PARTITION BY sid) AS x FROM hs")(lambda s, d: P.normalized(R.histogram(pixels(s, d))))
query("histogram_squares", HIST + " SELECT sid, bin, n / sum(n * n) OVER (PARTITION BY sid) AS x FROM hs")(lambda s, d: P.normalized(R.histogram(pixels(s, d)), "squares"))
query("feature_norms", "SELECT sid, (n + cx + cy)::DOUBLE AS l1, round(sqrt(n * n + cx * cx + cy * cy), 9) AS l2 FROM node")(lambda s, d: P.norm(P.norm(C.features(s, d), "l1").withColumnRenamed("norm", "l1")).select("sid", "l1", F.round("norm", 9).alias("l2")))
query("combined_features", "SELECT sid, dim, CASE dim WHEN 0 THEN round(n / (n + cx + cy), 9) WHEN 1 THEN round(cx / (n + cx + cy), 9) WHEN 2 THEN round(cy / (n + cx + cy), 9) ELSE 1 END::DOUBLE AS x FROM node, (SELECT unnest([0, 1, 2, 3]) AS dim)")(lambda s, d: P.combined([(C.features(s, d), "l1"), (P.bias(nodes(s, d)), None)]).select("sid", F.posexplode("f").alias("dim", "x")).select("sid", "dim", F.round("x", 9).alias("x")))
query("variance_scaled_features", "WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS var FROM l GROUP BY dim) SELECT vec_id, CAST(l.dim AS INT) AS dim, round((x - m) / CASE WHEN var > 0 THEN var ELSE 1 END, 6) AS z FROM l JOIN m ON l.dim = m.dim", "")(lambda s, d: P.scaled_by_variance(C.vectors(s, d)))
WHITE = ", w AS (SELECT " + ", ".join(f"count(*) FILTER ({a} gt <> 0 AND {b} pred = 1) AS {n}" for a, b, n in (("", "", "tp"), ("NOT", "", "fp"), ("", "NOT", "fn"), ("NOT", "NOT", "tn"))) + " FROM px)"
_white = lambda s, d: P.white_confusion(pixels(s, d), F.col("gt") != 0, F.col("pred") == 1)
query("white_confusion", WHITE + " SELECT * FROM w")(_white)
query("overlap_row", WHITE + ", r AS (SELECT round(tp / (tp + fp + fn), 9) AS f, round(tn / (tn + fp + fn), 9) AS b, * FROM w) SELECT f AS iou_fg, b AS iou_bg, round((f + b) / 2, 9) AS iou_mean, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fn), 9) AS tpr, round(fp / (fp + tn), 9) AS fpr FROM r")(lambda s, d: P.overlap_row(_white(s, d)))
query("summary_scores", f", c AS ({C.confused(C.BY_SIZE)}) SELECT round(sum(tp) / sum(tp + fn), 9) AS global, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 9) AS recall, round(avg(tp / (tp + fp + fn)), 9) AS overlap FROM c WHERE tp + fp + fn > 0", C.MODEL)(lambda s, d: P.summary_scores(C.by_size(s, d)))
query("pairwise_terms_by_distance", ", ed AS (SELECT hi, lo, least(CAST(trunc(abs(a.mean - b.mean) / 115.0::DOUBLE * 5 + 0.5) AS INT), 4) AS g, least(CAST(trunc(((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / 500.0::DOUBLE * 3 + 0.5) AS INT), 2) AS di FROM edge JOIN node a ON a.sid = hi JOIN node b ON b.sid = lo) SELECT hi, lo, CAST(a.label * 3 + b.label AS BIGINT) AS pair, sum((l * 27 + di * 9 + a.label * 3 + b.label) * 37 % 11 - 5)::DOUBLE AS weight FROM ed JOIN lab a ON a.sid = hi JOIN lab b ON b.sid = lo JOIN lv ON l <= g GROUP BY ALL", C.MODEL)(lambda s, d: M.pair_table(C.attributes(s, d).drop("orientation_idx"), C.truth(s, d), M.pair_model(s, C.PAIRWISE, 3, 5, 1, 3), 3))

#: Iterative labelings and regions: tested against brute force on small graphs and images.
QUERIES |= {
    "labels_min_cut": inferred("min_cut", TWO, 2), "labels_max_product": inferred("max_product", THREE, 3), "labels_icm": inferred("icm", THREE, 3), "labels_mean_field": inferred("mean_field", THREE, 3),
    "labels_sampling": inferred("sampling", THREE, 3, chains=3, seed=1), "labels_expansion": inferred("expansion", TWO, 2),
    "slic_2d": lambda s, d: S.segmented(pixels(s, d).select(F.floor(F.col("y") / 300).alias("image"), "x", (F.col("y") % 300).alias("y"), "v"), STEP, 10.0, 10),
    "slic_3d": lambda s, d: S.segmented(voxels(s, d).select(F.floor(F.col("z") / 15).alias("image"), "x", "y", (F.col("z") % 15).alias("z"), "v"), STEP, 10.0, 5, ("x", "y", "z")),
}
