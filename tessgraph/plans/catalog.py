"""Registry of the image-graph queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions as R
from ..sources.views import STEP, WIDTH, pixels, voxels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PX = f"""WITH h AS (SELECT max(o_orderkey) // {WIDTH} + 1 AS h FROM orders),
px AS (SELECT o_orderkey AS k, o_orderkey % {WIDTH} AS x, o_orderkey // {WIDTH} AS y, CAST(floor(o_totalprice) AS BIGINT) % 256 AS v,
 CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS gt, CAST(o_custkey % 3 AS INT) AS pred, h,
 ((o_orderkey % {WIDTH}) // {STEP}) * CAST(ceil(h / {STEP}) AS BIGINT) + (o_orderkey // {WIDTH}) // {STEP} AS sid FROM orders, h),
node AS (SELECT sid, count(*) AS n, sum(x) // count(*) AS cx, sum(y) // count(*) AS cy, sum(v) / count(*) AS mean FROM px GROUP BY sid),
m AS (SELECT max(x) AS mx, max(y) AS my FROM px),
d AS (SELECT unnest([-1, 0, 1]) AS d),
edge AS (SELECT DISTINCT p.sid AS hi, q.sid AS lo FROM px p, m, d a, d b, px q WHERE p.x > 0 AND p.x < mx AND p.y > 0 AND p.y < my AND q.x = p.x + a.d AND q.y = p.y + b.d AND p.sid > q.sid),
cnt AS (SELECT sid, gt, count(*) AS n FROM px GROUP BY ALL),
lab AS (SELECT sid, arg_max(gt, n * 10 - gt) AS label FROM cnt GROUP BY sid)
"""
VX = f"""WITH vx AS (SELECT o_orderkey % 10 AS x, (o_orderkey // 10) % 10 AS y, o_orderkey // 100 AS z, CAST(floor(o_totalprice) AS BIGINT) % 256 AS v, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS gt FROM orders),
px AS (SELECT *, (z // {STEP}) * 4 + (x // {STEP}) * 2 + y // {STEP} AS sid FROM vx),
m AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM px), d AS (SELECT unnest([-1, 0, 1]) AS d)
"""


def query(name: str, sql: str, base: str = PX):
    def add(fn):
        QUERIES[name] = fn
        ORACLE_SQL[name] = base + sql
        return fn

    return add


def graph(spark, sf):
    px = pixels(spark, sf)
    return px, R.stats(px), R.adjacency(px, ("x", "y"))


query("tiles_2d", "SELECT k, x, y, v, sid FROM px")(lambda s, d: pixels(s, d).select("k", "x", "y", "v", "sid"))
query("cubes_3d", "SELECT x, y, z, v, sid FROM px", VX)(lambda s, d: voxels(s, d).select("x", "y", "z", "v", "sid"))
query("region_stats_2d", "SELECT * FROM node")(lambda s, d: R.stats(pixels(s, d)))
query("region_stats_3d", "SELECT sid, count(*) AS n, sum(x) // count(*) AS cx, sum(y) // count(*) AS cy, sum(z) // count(*) AS cz, sum(v) / count(*) AS mean FROM px GROUP BY sid", VX)(lambda s, d: R.stats(voxels(s, d), ("x", "y", "z")))
query("region_deviation", "SELECT px.sid, any_value(mean) AS mean, sum(CAST(trunc(v - mean) AS INT) * CAST(trunc(v - mean) AS INT)) / count(*) AS var FROM px JOIN node ON px.sid = node.sid GROUP BY px.sid")(lambda s, d: R.deviation(pixels(s, d)))
query("adjacency_2d", "SELECT hi, lo FROM edge")(lambda s, d: graph(s, d)[2])
query("adjacency_3d", "SELECT DISTINCT p.sid AS hi, q.sid AS lo FROM px p, m, d a, d b, d c, px q WHERE p.x > 0 AND p.x < mx AND p.y > 0 AND p.y < my AND p.z > 0 AND p.z < mz AND q.x = p.x + a.d AND q.y = p.y + b.d AND q.z = p.z + c.d AND p.sid > q.sid", VX)(lambda s, d: R.adjacency(voxels(s, d), ("x", "y", "z")))
query("edge_attributes", """, e AS (SELECT hi, lo, a.mean - b.mean AS g, a.cx - b.cx AS dx, a.cy - b.cy AS dy FROM edge JOIN node a ON a.sid = hi JOIN node b ON b.sid = lo),
u AS (SELECT *, CAST(trunc(degrees(atan2(dy, dx))) AS INT) + 180 AS ang FROM e)
SELECT hi, lo, least(CAST(trunc(abs(g) / 115.0::DOUBLE * 5 + 0.5) AS INT), 4) AS gradient_idx, CASE WHEN ang > 45 AND ang < 135 THEN 1 WHEN ang > 225 AND ang < 315 THEN 2 ELSE 0 END AS orientation_idx,
least(CAST(trunc((dx * dx + dy * dy) / 500.0::DOUBLE * 3 + 0.5) AS INT), 2) AS distance_idx FROM u""")(lambda s, d: R.edge_attributes(graph(s, d)[2], graph(s, d)[1]))
query("long_range_edges", "SELECT a.sid AS hi, b.sid AS lo FROM node a, node b WHERE a.sid > b.sid AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 500")(lambda s, d: R.long_edges(R.stats(pixels(s, d))))
query("plurality_labels", "SELECT sid, label FROM lab")(lambda s, d: R.plurality(pixels(s, d)))
query("share_labels_3d", "SELECT sid, CASE WHEN sum(gt) / count(*) > 0.25 THEN 1 ELSE 0 END AS label FROM px GROUP BY sid", VX)(lambda s, d: R.share_label(voxels(s, d)))
query("boundary_labels", "SELECT sid, CASE WHEN label = 1 AND sid IN (SELECT hi FROM edge JOIN lab ON lab.sid = lo AND label = 0 UNION SELECT lo FROM edge JOIN lab ON lab.sid = hi AND label = 0) THEN 2 ELSE label END AS label FROM lab")(lambda s, d: R.boundary(R.plurality(pixels(s, d)), graph(s, d)[2]))
query("label_counts", "SELECT label, count(*) AS n FROM lab GROUP BY label")(lambda s, d: R.plurality(pixels(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
query("degree_stats", ", b AS (SELECT hi AS sid FROM edge UNION ALL SELECT lo FROM edge), g AS (SELECT sid, count(*) AS d FROM b GROUP BY sid) SELECT CAST(floor(avg(d)) AS BIGINT) AS mean_degree, min(d) AS min_degree, max(d) AS max_degree FROM g")(lambda s, d: R.degrees(graph(s, d)[2]))
query("intensity_range", "SELECT min(CAST(trunc(mean) AS INT)) AS lo, max(CAST(trunc(mean) AS INT)) AS hi FROM node")(lambda s, d: R.stats(pixels(s, d)).agg(F.expr("min(cast(mean as int)) AS lo"), F.expr("max(cast(mean as int)) AS hi")))
query("gradient_range", "SELECT min(abs(a.mean - b.mean)) AS lo, max(abs(a.mean - b.mean)) AS hi FROM edge JOIN node a ON a.sid = edge.hi JOIN node b ON b.sid = edge.lo")(lambda s, d: R.with_ends(graph(s, d)[2], graph(s, d)[1], "mean").agg(F.expr("min(abs(hi_mean - lo_mean)) AS lo"), F.expr("max(abs(hi_mean - lo_mean)) AS hi")))
query("histogram_features", "SELECT sid, CAST(v * 10 // 256 AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL")(lambda s, d: R.histogram(pixels(s, d)))
query("position_features", "SELECT sid, (cx - 25.0::DOUBLE) / 50 AS px, cy / (SELECT h FROM h) AS py, abs((cx - 25.0::DOUBLE) / 50) AS apx, abs(cy / (SELECT h FROM h)) AS apy FROM node")(lambda s, d: R.position(R.stats(pixels(s, d)).crossJoin(F.broadcast(pixels(s, d).agg(F.max("h").alias("h")))), WIDTH, F.col("h")))
query("glcm_features", ", q AS (SELECT sid, x, y, least(v * 8 // 255, 7) AS l FROM px) SELECT p.sid, CAST(p.l AS INT) AS l1, CAST(q.l AS INT) AS l2, count(*) AS n FROM q p, d a, d b, q WHERE q.sid = p.sid AND q.x = p.x + a.d AND q.y = p.y + b.d AND (a.d <> 0 OR b.d <> 0) GROUP BY ALL")(lambda s, d: R.glcm(pixels(s, d)))
query("confusion", ", c AS (SELECT unnest([0, 1, 2]) AS class) SELECT class, CAST(sum(CASE WHEN gt = class AND pred = class THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN gt <> class AND pred = class THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN gt = class AND pred <> class THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN gt <> class AND pred <> class THEN 1 ELSE 0 END) AS BIGINT) AS tn, sum(CASE WHEN gt = class AND pred = class THEN 1 ELSE 0 END) / sum(CASE WHEN gt = class OR pred = class THEN 1 ELSE 0 END) AS iou FROM px, c GROUP BY class")(lambda s, d: R.confusion(pixels(s, d)))
for _name, _grow, _agg in (("dilate", True, "max"), ("erode", False, "min")):
    query(_name, f", r AS (SELECT unnest(range(-3, 4)) AS r) SELECT p.x, p.y, {_agg}(CASE WHEN q.gt = 1 THEN 1 ELSE 0 END) AS out FROM px p, r a, r b, px q WHERE a.r * a.r + b.r * b.r <= 9 AND q.x = p.x + a.r AND q.y = p.y + b.r GROUP BY p.x, p.y")(lambda s, d, g=_grow: R.morphology(pixels(s, d), g))
query("argmax_labels", "SELECT sid, CASE WHEN mean * 0.5 > mean * 0.25 THEN 1 ELSE 0 END AS label FROM node")(lambda s, d: R.labels_by_score(R.stats(pixels(s, d)), [0.25, 0.5, 0.5]))
query("potts_energy", "SELECT count(*) AS n_edges, CAST(sum(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS cut_edges FROM edge JOIN lab a ON a.sid = hi JOIN lab b ON b.sid = lo")(lambda s, d: R.energy(R.plurality(pixels(s, d)), graph(s, d)[2]))
query("rescale_raw", """, g AS (SELECT v, count(*) AS n FROM px GROUP BY v), t AS (SELECT count(*) AS t FROM px), c AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS c FROM g),
lo AS (SELECT CASE WHEN trunc(t * 0.01::DOUBLE) = 0 THEN 0 ELSE (SELECT min(v) FROM c WHERE c >= trunc(t * 0.01::DOUBLE)) END AS lo FROM t),
hi AS (SELECT min(v) AS hi FROM c, lo, t WHERE v >= lo AND c + (SELECT coalesce(sum(n), 0) FROM g, lo WHERE v = lo) >= trunc(t * 0.99::DOUBLE))
SELECT k, CASE WHEN hi = lo THEN CASE WHEN v > hi THEN 255 ELSE 0 END ELSE CAST(trunc(greatest(least((v - lo) / (hi - lo)::DOUBLE * 255, 255), 0)) AS INT) END AS v FROM px, lo, hi""")(lambda s, d: R.rescaled(pixels(s, d)))
query("z_score_features", "WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS var FROM l GROUP BY dim) SELECT vec_id, CAST(l.dim AS INT) AS dim, round((x - m) / CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END, 6) AS z FROM l JOIN m ON l.dim = m.dim", "")(lambda s, d: R.z_scores(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")))
