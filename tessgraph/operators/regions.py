"""Region graph operators over pixel rows (sid, x, y[, z], v): statistics, adjacency, edge attributes, labels, features, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = F.lit


def stats(px: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Size, truncated center and mean of each region: one partial aggregation, one shuffle."""
    return px.groupBy("sid").agg(F.count(ONE(1)).alias("n"), *[F.floor(F.sum(a) / F.count(ONE(1))).alias("c" + a) for a in axes], (F.sum("v") / F.count(ONE(1))).alias("mean"))


def deviation(px: DataFrame) -> DataFrame:
    """Region mean and variance, differences truncated before squaring."""
    mean = px.groupBy("sid").agg((F.sum("v") / F.count(ONE(1))).alias("mean"))
    d = F.expr("cast(v - mean as int)")
    return px.join(mean, "sid").groupBy("sid").agg(F.first("mean").alias("mean"), (F.sum(d * d) / F.count(ONE(1))).alias("var"))


def adjacency(px: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Undirected edges (hi, lo) between regions that touch at an interior pixel, all neighbors included."""
    ends = px.agg(*[F.max(a).alias("m" + a) for a in axes])  # one row
    inner = px.join(F.broadcast(ends), reduce(lambda p, q: p & q, [(F.col(a) > 0) & (F.col(a) < F.col("m" + a)) for a in axes]))
    moved = inner.select(F.col("sid").alias("s"), *axes)
    for a in axes:
        moved = moved.withColumn(a, F.explode(F.array(F.col(a) - 1, F.col(a), F.col(a) + 1)))
    both = moved.join(px.select("sid", *axes), list(axes)).where("s <> sid")
    # the scan adds an edge at its higher end only
    return both.where("s > sid").select(F.col("s").alias("hi"), F.col("sid").alias("lo")).distinct()


def with_ends(edges: DataFrame, node: DataFrame, *columns: str) -> DataFrame:
    for end in ("hi", "lo"):
        edges = edges.join(node.select(F.col("sid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def edge_attributes(edges: DataFrame, node: DataFrame, levels: int = 5, top: float = 115.0, n_dist: int = 3) -> DataFrame:
    """Gradient bin, orientation bin and distance bin of every edge."""
    e = with_ends(edges, node, "mean", "cx", "cy")
    grad = F.least(F.expr(f"cast(abs(hi_mean - lo_mean) / {top} * {levels} + 0.5 as int)"), ONE(levels - 1))
    dx, dy = F.col("hi_cx") - F.col("lo_cx"), F.col("hi_cy") - F.col("lo_cy")
    # truncated degrees, always plus 180; the bins' ends belong to bin 0
    angle = F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))).cast("int") + 180
    orient = F.when((angle > 45) & (angle < 135), 1).when((angle > 225) & (angle < 315), 2).otherwise(0)
    dist = F.least((((dx * dx + dy * dy) / 500.0 * n_dist) + 0.5).cast("int"), ONE(n_dist - 1))
    return e.select("hi", "lo", grad.alias("gradient_idx"), orient.alias("orientation_idx"), dist.alias("distance_idx"))


def long_edges(node: DataFrame, squared: int = 500) -> DataFrame:
    """Pairs of centers closer than the square root of squared: cells of that width, own and neighboring cells only."""
    w = int(squared**0.5) + 1
    cell = node.select("sid", "cx", "cy", F.floor(F.col("cx") / w).alias("gx"), F.floor(F.col("cy") / w).alias("gy"))
    probe = cell.select(F.col("sid").alias("lo"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), F.explode(F.expr("sequence(gx - 1, gx + 1)")).alias("gx"), "gy").withColumn("gy", F.explode(F.expr("sequence(gy - 1, gy + 1)")))
    near = cell.join(probe, ["gx", "gy"]).where("sid > lo").where(f"(cx - x2) * (cx - x2) + (cy - y2) * (cy - y2) < {squared}")
    return near.select(F.col("sid").alias("hi"), "lo")


def plurality(px: DataFrame, label: str = "gt") -> DataFrame:
    """Most frequent label of each region; ties go to the lowest label."""
    n = px.groupBy("sid", label).agg(F.count(ONE(1)).alias("n"))
    return n.groupBy("sid").agg(F.max(F.struct("n", (-F.col(label)).alias("k"))).alias("best")).select("sid", (-F.col("best.k")).alias("label"))


def share_label(px: DataFrame, least: float = 0.25) -> DataFrame:
    """1 if more than the given share of the region is foreground."""
    return px.groupBy("sid").agg(F.when(F.sum((F.col("gt") == 1).cast("int")) / F.count(ONE(1)) > least, 1).otherwise(0).alias("label"))


def boundary(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Foreground (1) regions that touch background (0) become boundary (2)."""
    both = edges.select(F.col("hi").alias("sid"), F.col("lo").alias("o")).union(edges.select("lo", "hi"))
    bg = labels.where("label = 0").select(F.col("sid").alias("o"))
    touching = both.join(bg, "o", "left_semi").select("sid").distinct().withColumn("t", ONE(True))
    return labels.join(touching, "sid", "left").select("sid", F.when((F.col("label") == 1) & F.col("t"), 2).otherwise(F.col("label")).alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("sid")).union(edges.select("lo"))
    d = both.groupBy("sid").agg(F.count(ONE(1)).alias("d"))
    return d.agg(F.floor(F.avg("d")).alias("mean_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"))


def histogram(px: DataFrame, bins: int = 10) -> DataFrame:
    """Gray histogram of each region in long form."""
    return px.groupBy("sid", F.expr(f"cast(v * {bins} / 256 as int)").alias("bin")).agg(F.count(ONE(1)).alias("n"))


def position(node: DataFrame, width: int, height: Column) -> DataFrame:
    px, py = (F.col("cx") - width / 2) / width, F.col("cy") / height
    return node.select("sid", px.alias("px"), py.alias("py"), F.abs(px).alias("apx"), F.abs(py).alias("apy"))


def glcm(px: DataFrame, levels: int = 8) -> DataFrame:
    """Co-occurrence counts of gray levels of neighboring pixels of the same region."""
    q = px.select("sid", "x", "y", F.least(F.expr(f"cast(v * {levels} / 255 as int)"), ONE(levels - 1)).alias("l"))
    around = q.select("sid", F.col("l").alias("l1"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.expr("sequence(x - 1, x + 1)")).alias("x"), "y").withColumn("y", F.explode(F.expr("sequence(y - 1, y + 1)")))
    return around.where("x <> x0 or y <> y0").join(q.withColumnRenamed("l", "l2"), ["sid", "x", "y"]).groupBy("sid", "l1", "l2").agg(F.count(ONE(1)).alias("n"))


def confusion(px: DataFrame, classes: int = 3) -> DataFrame:
    """One-vs-rest TP, FP, FN, TN and intersection over union of every class, in one pass."""
    t = px.groupBy("gt", "pred").agg(F.count(ONE(1)).alias("n"))
    c = t.select(F.explode(F.sequence(ONE(0), ONE(classes - 1))).alias("class"), "gt", "pred", "n")
    s = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0))
    r = c.groupBy("class").agg(s("gt = class and pred = class").alias("tp"), s("gt <> class and pred = class").alias("fp"), s("gt = class and pred <> class").alias("fn"), s("gt <> class and pred <> class").alias("tn"))
    return r.withColumn("iou", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")))


def morphology(px: DataFrame, grow: bool, radius: int = 3) -> DataFrame:
    """Binary dilation or erosion of gt = 1 by a disc; pixels beyond the border do not count."""
    f = px.select("x", "y", (F.col("gt") == 1).cast("int").alias("f"))
    offs = F.array(*[F.struct(ONE(i).alias("i"), ONE(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])
    sent = f.select(F.explode(offs).alias("o"), "x", "y", "f").select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), "f")
    out = sent.groupBy("x", "y").agg((F.max if grow else F.min)("f").alias("out"))
    return out.join(f.select("x", "y"), ["x", "y"], "left_semi")


def labels_by_score(node: DataFrame, weights: list[float]) -> DataFrame:
    """Independent argmax of linear class scores of the region mean; ties go to the lowest class."""
    scores = [F.struct((F.col("mean") * w).alias("score"), ONE(-k).alias("k")) for k, w in enumerate(weights)]
    return node.select("sid", (-F.greatest(*scores)["k"]).alias("label"))


def energy(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Potts energy: sum of label costs plus the number of edges whose ends differ."""
    e = with_ends(edges, labels, "label")
    return e.agg(F.count(ONE(1)).alias("n_edges"), F.sum((F.col("hi_label") != F.col("lo_label")).cast("int")).alias("cut_edges"))


def rescaled(px: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Gray values stretched between two order statistics to 0..255, clipped and truncated.

    Both limits are found by a running count that reaches the truncated share of the pixels. The count for the upper one
    goes on from the lower limit's bin and takes that bin a second time: the defined behaviour, kept on purpose. If both
    limits are one value, what lies above it becomes 255 and the rest 0."""
    from pyspark.sql import Window

    h = px.groupBy("v").agg(F.count(ONE(1)).alias("n"))  # at most 256 rows
    total = F.sum("n").over(Window.partitionBy())
    c = h.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("c"), total.alias("t")).withColumns({"few": F.expr(f"cast(t * {low}D as int)"), "most": F.expr(f"cast(t * {high}D as int)")})
    lo = c.agg(F.when(F.first("few") == 0, 0).otherwise(F.min(F.when(F.col("c") >= F.col("few"), F.col("v")))).alias("lo"))
    at = c.crossJoin(F.broadcast(lo))  # one row
    again = at.agg(F.coalesce(F.sum(F.when(F.col("v") == F.col("lo"), F.col("n"))), ONE(0)).alias("again"))
    b = at.crossJoin(F.broadcast(again)).where("v >= lo and c + again >= most").agg(F.min("lo").alias("lo"), F.min("v").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.when(F.col("v") > F.col("hi"), 255).otherwise(0)).otherwise(F.expr("cast(greatest(least((v - lo) / cast(hi - lo as double) * 255, 255D), 0D) as int)"))
    return px.crossJoin(F.broadcast(b)).select("k", scaled.alias("v"))


def z_scores(vectors: DataFrame) -> DataFrame:
    """Features standardised per dimension: (x - mean) / sqrt(E[x^2] - mean^2), zero variance as 1."""
    long = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    m = long.groupBy("dim").agg(F.avg("x").alias("m"), (F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")).alias("var"))
    return long.join(F.broadcast(m), "dim").select("vec_id", "dim", F.round((F.col("x") - F.col("m")) / F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0), 6).alias("z"))  # one row per dimension
