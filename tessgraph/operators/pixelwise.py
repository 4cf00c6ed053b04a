"""Small operators over pixels, regions, edges and features, all single projections, aggregations or joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import checkpoint
from .models import both_ways

ONE = F.lit


def tiles(px: DataFrame, step: int, sizes: dict[str, Column | int], order: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """px with sid: square tiles (or cubes) of that step, numbered with the first axis outermost; step <= 0 makes the whole image one region.

    sizes: the length of each axis. A cube's step is clamped to the length of the first axis if there are three."""
    if step <= 0:
        return px.withColumn("sid", ONE(0).cast("long"))
    steps = {a: F.least(ONE(step), sizes[a] if isinstance(sizes[a], Column) else ONE(sizes[a])) if len(order) > 2 and a == order[0] else ONE(step) for a in order}
    sid = ONE(0).cast("long")
    for a in order:
        n = sizes[a] if isinstance(sizes[a], Column) else ONE(sizes[a])
        sid = sid * F.ceil(n / steps[a]) + F.floor(F.col(a) / steps[a])
    return px.withColumn("sid", sid)


def region_at(px: DataFrame, **at: int) -> DataFrame:
    """The region of one pixel."""
    return px.where(reduce(lambda p, q: p & q, [F.col(a) == v for a, v in at.items()])).select("sid")


def edge_order(edges: DataFrame) -> DataFrame:
    """edges with a number from 0 in order of (hi, lo): counts of the edges of each lower region, then the place among its own."""
    from pyspark.sql import Window

    per = edges.groupBy("hi").agg(F.count(ONE(1)).alias("m"))
    # one row a region enters the running sum, none an edge
    first = per.select("hi", (F.sum("m").over(Window.orderBy("hi")) - F.col("m")).alias("first"))
    return edges.join(first, "hi").withColumn("edge_no", (F.col("first") + F.row_number().over(Window.partitionBy("hi").orderBy("lo")) - 1).cast("long")).drop("first")


def directed_ids(edges: DataFrame, count: DataFrame) -> DataFrame:
    """Both directions of every edge with their id a * n + b; count: one row, n."""
    return both_ways(edges).crossJoin(F.broadcast(count)).select("sid", "nb", (F.col("sid") * F.col("n") + F.col("nb")).alias("edge_id"))


def with_long_edges(local: DataFrame, long: DataFrame) -> DataFrame:
    """Local edges and the long-range ones that are not local already; far tells which is which."""
    marked = local.select("hi", "lo", ONE(0).alias("far")).union(long.select("hi", "lo", ONE(1).alias("far")))
    return marked.groupBy("hi", "lo").agg(F.min("far").alias("far"))


def hop_edges(edges: DataFrame, limit: int) -> DataFrame:
    """(hi, lo, hops): pairs of regions at most limit edges apart, with their distance. Every round joins the newest pairs with the edges."""
    pairs = checkpoint(both_ways(edges).distinct())
    rings = [pairs.withColumn("hops", ONE(1))]
    for k in range(2, limit + 1):
        step = rings[-1].select("sid", F.col("nb").alias("via")).join(pairs.select(F.col("sid").alias("via"), "nb"), "via").where("sid <> nb").select("sid", "nb").distinct()
        for ring in rings[-2:]:  # a new pair is in neither of the last two rings: a neighbor of ring k - 1 is in ring k - 2, k - 1 or k
            step = step.join(ring.select("sid", "nb"), ["sid", "nb"], "left_anti")
        rings.append(checkpoint(step).withColumn("hops", ONE(k)))
    return reduce(DataFrame.unionByName, rings).where("sid > nb").select(F.col("sid").alias("hi"), F.col("nb").alias("lo"), "hops")


def label_or_other(px: DataFrame, least: float = 0.5, label: str = "gt", background: int = 0, other: int = 2) -> DataFrame:
    """1 if more than that share of a region is not background, else 0 if more than that share is, else the other label."""
    n = F.count(ONE(1))
    back = F.sum((F.col(label) == background).cast("int"))
    return px.groupBy("sid").agg(F.when(n - back > least * n, 1).when(back > least * n, 0).otherwise(other).alias("label"))


def back_projected(px: DataFrame, labels: DataFrame, scale: str = "classes", classes: int = 3) -> DataFrame:
    """Gray value of every pixel from the label of its region: scale "seven" is label * 255 / 7, "half" label / 2 * 255, "classes" label / (classes - 1) * 255, all truncated."""
    y = F.col("label")
    gray = {"seven": y * 255 / 7, "half": y / 2 * 255, "classes": y / ONE(classes - 1) * 255}[scale]
    return px.join(labels.select("sid", "label"), "sid").select("k", gray.cast("int").alias("v"))


def costs(scores: DataFrame, p: str = "p") -> DataFrame:
    """scores with the cost -log(min(1, p + 1e-10)) of a probability, and its score, the negative of that."""
    s = F.log(F.least(ONE(1.0), F.col(p) + 1e-10))
    return scores.withColumns({"cost": -s, "score": s})


def color_code(r: str, g: str, b: str) -> Column:
    """One number for a color: r * 65025 + g * 255 + b."""
    return F.col(r) * 65025 + F.col(g) * 255 + F.col(b)


def color_of(code: Column) -> list[Column]:
    """r, g, b of such a number with components below 255."""
    return [F.floor(code / 65025).alias("r"), F.floor(code % 65025 / 255).alias("g"), (code % 255).alias("b")]


def hsv(r: str, g: str, b: str) -> list[Column]:
    """Hue in 0..180 (half degrees), saturation and value in 0..255, each rounded half up."""
    c = [F.col(x).cast("double") for x in (r, g, b)]
    v, low = F.greatest(*c), F.least(*c)
    d = v - low
    hue = F.when(d == 0, 0.0).when(v == c[0], 60 * (c[1] - c[2]) / d).when(v == c[1], 120 + 60 * (c[2] - c[0]) / d).otherwise(240 + 60 * (c[0] - c[1]) / d)
    hue = F.when(hue < 0, hue + 360).otherwise(hue) / 2
    return [F.floor(hue + 0.5).cast("int").alias("h"), F.floor(F.when(v == 0, 0.0).otherwise(255 * d / v) + 0.5).cast("int").alias("s"), v.cast("int").alias("v")]


def normalized(histogram: DataFrame, kind: str = "l1") -> DataFrame:
    """Histogram rows (sid, bin, n) divided by their sum ("l1"), or by the sum of their squares ("squares", not its root: the defined behaviour)."""
    total = histogram.groupBy("sid").agg((F.sum("n") if kind == "l1" else F.sum(F.col("n") * F.col("n"))).alias("t"))
    return histogram.join(total, "sid").select("sid", "bin", (F.col("n") / F.col("t")).alias("x"))


def norm(vectors: DataFrame, kind: str = "l2", column: str = "f") -> DataFrame:
    """Sum of a vector's values ("l1", not of their absolute values: the defined behaviour), or the root of the sum of squares."""
    x = F.aggregate(F.transform(column, lambda a: a.cast("double") if kind == "l1" else a.cast("double") * a.cast("double")), ONE(0.0), lambda a, b: a + b)
    return vectors.withColumn("norm", x if kind == "l1" else F.sqrt(x))


def combined(features: list[tuple[DataFrame, str | None]]) -> DataFrame:
    """Features (sid, f) of every region one after the other, each block divided by its norm if it names one ("l1" or "l2"); a zero norm leaves it."""
    blocks = []
    for k, (d, kind) in enumerate(features):
        d = d.select("sid", F.transform("f", lambda a: a.cast("double")).alias("f"))
        if kind:
            d = norm(d, kind).withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
            d = d.select("sid", F.transform("f", lambda a: a / F.col("norm")).alias("f"))
        blocks.append(d.withColumnRenamed("f", f"f{k}"))
    joined = reduce(lambda a, b: a.join(b, "sid"), blocks)
    return joined.select("sid", F.concat(*[f"f{k}" for k in range(len(blocks))]).alias("f"))


def bias(nodes: DataFrame) -> DataFrame:
    return nodes.select("sid", F.array(ONE(1.0)).alias("f"))


def scaled_by_variance(vectors: DataFrame) -> DataFrame:
    """(x - mean) / variance per dimension (variance, not deviation: the defined behaviour); a zero variance counts as 1."""
    long = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    m = long.groupBy("dim").agg(F.avg("x").alias("m"), (F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")).alias("var"))
    return long.join(m, "dim").select("vec_id", "dim", F.round((F.col("x") - F.col("m")) / F.when(F.col("var") > 0, F.col("var")).otherwise(1.0), 6).alias("z"))


def white_confusion(px: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """TP, FP, FN, TN of two conditions on pixels."""
    s = lambda a, b: F.sum((a & b).cast("long"))
    return px.agg(s(truth, guess).alias("tp"), s(~truth, guess).alias("fp"), s(truth, ~guess).alias("fn"), s(~truth, ~guess).alias("tn"))


def overlap_row(c: DataFrame) -> DataFrame:
    """Overlaps of both sides and their mean, accuracy and rates from one row of TP, FP, FN, TN; nothing to overlap counts as null."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    r = lambda a, b: F.round(F.when(b != 0, a / b), 9)
    fore, back = r(tp, tp + fp + fn), r(tn, tn + fp + fn)
    return c.select(fore.alias("iou_fg"), back.alias("iou_bg"), F.round((fore + back) / 2, 9).alias("iou_mean"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"), r(tp, tp + fn).alias("tpr"), r(fp, fp + tn).alias("fpr"))


def summary_scores(confusion: DataFrame) -> DataFrame:
    """Over classes: share of right ones, mean recall and mean overlap, of classes that occur on one side at least."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return confusion.where("tp + fp + fn > 0").agg(
        F.round(F.sum(tp) / F.sum(tp + fn), 9).alias("global"), F.round(F.avg(F.when(tp + fn > 0, tp / (tp + fn))), 9).alias("recall"), F.round(F.avg(tp / (tp + fp + fn)), 9).alias("overlap"))
