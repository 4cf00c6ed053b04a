"""Registry, part two: energies, losses, evaluation, votes, k-hop relations and components, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import regions as R
from ..sources.views import pixels
from .catalog import ORACLE_SQL, PX, QUERIES, graph, query

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Integer class weights of the region features (n, cx, cy) and class offsets, the same on both sides.
WEIGHTS, OFFSETS = [[1, -2, 0], [0, 1, 1], [2, 0, -1]], [3, 0, -1]
#: Pairwise weights of 5 gradient levels, 3 orientations and 3 x 3 labels, by the formula of the fixtures.
PAIRWISE = [p * 37 % 11 - 5 for p in range(5 * 3 * 9)]
MODEL = PX.rstrip() + """,
sc AS (SELECT sid, unnest([0, 1, 2]) AS label, unnest([n - 2 * cx + 3, cx + cy, 2 * n - cy - 1])::DOUBLE AS score FROM node),
arg AS (SELECT sid, arg_max(label, score * 10 - label) AS label FROM sc GROUP BY sid),
att AS (SELECT hi, lo, CAST(trunc(degrees(atan2(a.cy - b.cy, a.cx - b.cx))) AS INT) + 180 AS ang, least(CAST(trunc(abs(a.mean - b.mean) / 115.0::DOUBLE * 5 + 0.5) AS INT), 4) AS g FROM edge JOIN node a ON a.sid = hi JOIN node b ON b.sid = lo),
lv AS (SELECT unnest(range(5)) AS l),
pr AS (SELECT hi, lo, a.label * 3 + b.label AS pair, sum((l * 27 + CASE WHEN ang > 45 AND ang < 135 THEN 1 WHEN ang > 225 AND ang < 315 THEN 2 ELSE 0 END * 9 + a.label * 3 + b.label) * 37 % 11 - 5)::DOUBLE AS weight FROM att JOIN lab a ON a.sid = hi JOIN lab b ON b.sid = lo JOIN lv ON l <= g GROUP BY ALL),
cw AS (SELECT label, n, round(1 / n / (SELECT sum(1 / c.n) FROM (SELECT count(*) AS n FROM lab GROUP BY label) c), 9) AS weight FROM (SELECT label, count(*) AS n FROM lab GROUP BY label)),
cls AS (SELECT unnest([0, 1, 2]) AS class),
nb AS (SELECT hi AS sid, lo AS nb FROM edge UNION ALL SELECT lo, hi FROM edge),
prd AS (SELECT sid, arg_max(pred, n * 10 - pred) AS label FROM (SELECT sid, pred, count(*) AS n FROM px GROUP BY ALL) GROUP BY sid)
"""


def confused(source: str) -> str:
    """SQL: one-vs-rest confusion of source (gt, y, n)."""
    s = lambda a, b: f"CAST(sum(CASE WHEN gt {a} class AND y {b} class THEN n ELSE 0 END) AS BIGINT)"
    return f"SELECT class, {s('=', '=')} AS tp, {s('<>', '=')} AS fp, {s('=', '<>')} AS fn, {s('<>', '<>')} AS tn FROM {source}, cls GROUP BY class"


BY_SIZE = "(SELECT a.label AS gt, b.label AS y, n FROM lab a JOIN prd b ON a.sid = b.sid JOIN node ON node.sid = a.sid)"


BY_COUNT = BY_SIZE.replace("b.label AS y, n ", "b.label AS y, 1 AS n ")


def features(s, d):
    return R.stats(pixels(s, d)).select("sid", F.array(*[F.col(c).cast("double") for c in ("n", "cx", "cy")]).alias("f"))


def scores(s, d):
    return M.unary_scores(features(s, d), WEIGHTS, OFFSETS)


def truth(s, d):
    return R.plurality(pixels(s, d))


def guess(s, d):
    return R.plurality(pixels(s, d), "pred")


def edges(s, d):
    return graph(s, d)[2]


def attributes(s, d):
    return QUERIES["edge_attributes"](s, d)


def pairs(s, d):
    model = M.pair_model(s, PAIRWISE, 3, 5, 3)
    return M.pair_table(attributes(s, d).drop("distance_idx"), truth(s, d), model, 3)


def by_size(s, d):
    return M.region_confusion(truth(s, d), guess(s, d), R.stats(pixels(s, d)))


def vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


query("majority_labels", "SELECT sid, CASE WHEN sum(CASE WHEN gt = 1 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE 0 END AS label FROM px GROUP BY sid")(lambda s, d: M.majority(pixels(s, d)))
query("slice_mean_intensity", "SELECT round(sum(mean) / (count(*) + 1), 6) AS mean FROM node")(lambda s, d: R.stats(pixels(s, d)).agg(F.round(F.sum("mean") / (F.count(F.lit(1)) + 1), 6).alias("mean")))
query("distance_bin_counts", ", e AS (SELECT a.cx - b.cx AS dx, a.cy - b.cy AS dy FROM edge JOIN node a ON a.sid = hi JOIN node b ON b.sid = lo), b AS (SELECT least(CAST(trunc((dx * dx + dy * dy) / 500.0::DOUBLE * 3 + 0.5) AS INT), 2) AS bin FROM e) SELECT r.bin, count(b.bin) AS n FROM (SELECT unnest([0, 1, 2]) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin")(lambda s, d: s.range(3).select(F.col("id").cast("int").alias("bin")).join(attributes(s, d).groupBy(F.col("distance_idx").alias("bin")).agg(F.count(F.lit(1)).alias("m")), "bin", "left").select("bin", F.coalesce("m", F.lit(0)).alias("n")))
query("unary_scores", "SELECT * FROM sc", MODEL)(scores)
query("best_labels", "SELECT * FROM arg", MODEL)(lambda s, d: M.best_label(scores(s, d)))
query("loss_augmented_labels", "SELECT sc.sid, arg_max(sc.label, (score + CASE WHEN sc.label <> lab.label THEN 4 ELSE 0 END) * 10 - sc.label) AS label FROM sc JOIN lab ON lab.sid = sc.sid GROUP BY sc.sid", MODEL)(lambda s, d: M.loss_augmented(scores(s, d), truth(s, d), F.lit(4.0)))
query("pairwise_terms", "SELECT hi, lo, CAST(pair AS BIGINT) AS pair, weight FROM pr", MODEL)(pairs)
query("crf_energy", ", q AS (SELECT sum(score) AS node FROM sc JOIN lab ON lab.sid = sc.sid AND lab.label = sc.label), r AS (SELECT sum(weight)::DOUBLE AS edge FROM pr) SELECT round(node, 6) AS node, edge, round(-node - edge, 6) AS energy FROM q, r", MODEL)(lambda s, d: M.crf_energy(scores(s, d), truth(s, d), pairs(s, d)))
query("psi_nodes", "SELECT label, dim, sum(x)::DOUBLE AS psi FROM (SELECT lab.label, unnest([0, 1, 2]) AS dim, unnest([n, cx, cy]) AS x FROM node JOIN lab ON lab.sid = node.sid) GROUP BY ALL", MODEL)(lambda s, d: M.psi_nodes(features(s, d), truth(s, d)))
query("psi_edges", "SELECT CAST(l AS INT) AS level, CAST(pair AS BIGINT) AS pair, count(*)::DOUBLE AS psi FROM pr JOIN att ON att.hi = pr.hi AND att.lo = pr.lo JOIN lv ON l <= g GROUP BY ALL", MODEL)(lambda s, d: M.psi_edges(attributes(s, d), truth(s, d), 3))
query("class_loss_weights", "SELECT * FROM cw", MODEL)(lambda s, d: M.class_weights(truth(s, d)))
query("hamming_loss", "SELECT CAST(sum(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong, round(sum(CASE WHEN a.label <> b.label THEN weight ELSE 0 END), 6) AS loss FROM lab a JOIN prd b ON a.sid = b.sid JOIN cw ON cw.label = a.label", MODEL)(lambda s, d: M.hamming_loss(truth(s, d), guess(s, d), M.class_weights(truth(s, d))))
query("confusion_by_size", confused(BY_SIZE), MODEL)(by_size)
query("confusion_masked", confused("(SELECT a.label AS gt, b.label AS y, count(*) AS n FROM px JOIN lab a ON a.sid = px.sid JOIN prd b ON b.sid = px.sid WHERE v >= 128 GROUP BY ALL)"), MODEL)(lambda s, d: M.masked_confusion(pixels(s, d), truth(s, d), guess(s, d), F.col("v") >= 128))
query("overlap_loss", f", c AS ({confused(BY_COUNT)}) SELECT count(*) AS n_classes, round(1 - avg(tp / (tp + fp + fn)), 9) AS loss FROM c WHERE tp + fp + fn > 0", MODEL)(lambda s, d: M.overlap_loss(M.region_confusion(truth(s, d), guess(s, d), None)))
query("binary_scores", f", c AS ({confused(BY_SIZE)}) SELECT class, round(tp / (tp + fn), 9) AS tpr, round(fn / (tp + fn), 9) AS fnr, round(fp / (fp + tn), 9) AS fpr, round(tn / (fp + tn), 9) AS tnr, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM c", MODEL)(lambda s, d: M.binary_scores(by_size(s, d)))
query("model_vote", "SELECT a.sid, CASE WHEN ((CASE WHEN a.label = 1 THEN 0.5 ELSE 0 END) + (CASE WHEN b.label = 1 THEN 0.25 ELSE 0 END) + (CASE WHEN c.label = 1 THEN 0.25 ELSE 0 END)) / 3 > 1.0::DOUBLE / 3 THEN 1 ELSE 0 END AS label FROM lab a JOIN prd b ON a.sid = b.sid JOIN arg c ON c.sid = a.sid", MODEL)(lambda s, d: M.vote([(x.select("sid", (F.col("label") == 1).cast("int").alias("label")), a) for x, a in ((truth(s, d), 0.5), (guess(s, d), 0.25), (M.best_label(scores(s, d)), 0.25))]))
query("boundary_postprocess", "SELECT sid, CASE WHEN label = 2 AND sid NOT IN (SELECT nb.sid FROM nb JOIN lab ON lab.sid = nb.nb AND lab.label <> 1) THEN 1 ELSE label END AS label FROM prd", MODEL)(lambda s, d: M.boundary_postprocess(guess(s, d), truth(s, d), edges(s, d)))
query("boundary_distance_loss", """, h0 AS (SELECT sid FROM lab WHERE label = 2), """ + ", ".join(f"h{k} AS (SELECT sid FROM h{k - 1} UNION SELECT nb FROM nb JOIN h{k - 1} ON nb.sid = h{k - 1}.sid)" for k in range(1, 8)) + " SELECT sid, CAST(CASE " + " ".join(f"WHEN sid IN (SELECT sid FROM h{k}) THEN {k + 1}" for k in range(8)) + " ELSE 8 END AS BIGINT) AS loss FROM lab", MODEL)(lambda s, d: M.distance_loss(truth(s, d), edges(s, d)))
query("neighbor_means", "SELECT node.sid, round(mean, 6) AS own, round(coalesce(m, 0), 6) AS around FROM node LEFT JOIN (SELECT nb.sid, avg(mean) AS m FROM nb JOIN node ON node.sid = nb.nb GROUP BY nb.sid) t ON t.sid = node.sid", MODEL)(lambda s, d: M.neighbor_means(R.stats(pixels(s, d)), edges(s, d)))
RANGES = "WITH l AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS dim, unnest(embedding) AS x FROM embeddings), o AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x) AS r, count(*) OVER (PARTITION BY dim) AS t FROM l), rg AS (SELECT dim, min(x) FILTER (r = floor(t * 0.01::DOUBLE) + 1) AS lo, min(x) FILTER (r = floor(t * 0.99::DOUBLE) + 1) AS hi FROM o GROUP BY dim) "
query("feature_ranges", "SELECT * FROM rg", RANGES)(lambda s, d: M.order_range(vectors(s, d)))
query("feature_min_max", "SELECT vec_id, l.dim, round(CASE WHEN hi::DOUBLE - lo::DOUBLE > 1e-4 THEN (x::DOUBLE - lo::DOUBLE) / (hi::DOUBLE - lo::DOUBLE) ELSE x::DOUBLE END, 6) AS x FROM l JOIN rg ON rg.dim = l.dim", RANGES)(lambda s, d: M.min_max(vectors(s, d), M.order_range(vectors(s, d))))
query("median_intensity", "SELECT median(mean) AS median FROM node")(lambda s, d: R.stats(pixels(s, d)).agg(F.percentile("mean", F.lit(0.5)).alias("median")))
query("edge_ids", "SELECT hi, lo, least(hi, lo) * (SELECT count(*) FROM node) + greatest(hi, lo) AS edge_id FROM edge")(lambda s, d: edges(s, d).crossJoin(F.broadcast(R.stats(pixels(s, d)).agg(F.count(F.lit(1)).alias("n")))).select("hi", "lo", (F.least("hi", "lo") * F.col("n") + F.greatest("hi", "lo")).alias("edge_id")))
query("cropped_regions", "SELECT x, y, sid, dense_rank() OVER (ORDER BY sid) - 1 AS new_sid FROM px WHERE x < 23 AND y < 17")(lambda s, d: M.cropped(pixels(s, d), 23, 17))
query("mask_components", ", fg AS (SELECT k, x, y FROM px WHERE gt = 1), li AS (SELECT p.k, q.k AS nb FROM fg p, d a, d b, fg q WHERE q.x = p.x + a.d AND q.y = p.y + b.d), re AS (SELECT k, k AS r FROM fg UNION SELECT re.k, li.nb FROM re JOIN li ON li.k = re.r), co AS (SELECT k, min(r) AS component, count(*) AS n FROM re GROUP BY k) SELECT * FROM co WHERE n >= 3", PX.replace("WITH h AS", "WITH RECURSIVE h AS"))(lambda s, d: M.mask_components(pixels(s, d), least=3))
