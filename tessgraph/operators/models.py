"""Energies, losses, joint feature vectors, labelings by vote, k-hop relations and components over region graphs.

Shared shapes: node scores (sid, label, score), labels (sid, label), edges (hi, lo[, bins]).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.state import checkpoint
from .regions import with_ends

ONE = F.lit


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("hi").alias("sid"), F.col("lo").alias("nb")).union(edges.select("lo", "hi"))


def unary_scores(features: DataFrame, weights: list[list[float]], offsets: list[float], feature: str = "f") -> DataFrame:
    """Linear score of every class: weights[class] . feature + offset, inside one projection."""
    def dot(w: list[float]) -> Column:
        parts = F.zip_with(feature, F.array(*[ONE(float(x)) for x in w]), lambda a, b: a.cast("double") * b)
        return F.aggregate(parts, ONE(0.0), lambda a, b: a + b)

    scores = F.array(*[dot(w) + o for w, o in zip(weights, offsets, strict=True)])
    return features.select("sid", F.posexplode(scores).alias("label", "score"))


def best_label(scores: DataFrame) -> DataFrame:
    """Class of the highest score; ties go to the lowest class."""
    return scores.groupBy("sid").agg(F.max(F.struct("score", (-F.col("label")).alias("k"))).alias("b")).select("sid", (-F.col("b.k")).alias("label"))


def loss_augmented(scores: DataFrame, truth: DataFrame, class_weight: Column) -> DataFrame:
    """The most violating labeling without edges: the loss is added to every class but the true one."""
    t = truth.select("sid", F.col("label").alias("gt"))
    aug = F.col("score") + F.when(F.col("label") != F.col("gt"), class_weight).otherwise(0.0)
    return best_label(scores.join(t, "sid").select("sid", "label", aug.alias("score")))


def pair_model(spark: SparkSession, weights: list[float], classes: int, levels: int, orientations: int = 1, distances: int = 1) -> DataFrame:
    """Pairwise weights as rows (distance_idx, orientation_idx, gradient_idx, pair, weight), cumulative over gradient levels.

    weights is the pairwise part of a model: level major, then distance, orientation, and higher label * classes + lower label."""
    pairs = classes * classes
    step = pairs * orientations * distances
    if len(weights) != step * levels:
        raise ValueError(f"{len(weights)} pairwise weights, expected {step * levels}")
    rows = []
    for at in range(step):
        total = 0.0
        for g in range(levels):
            total += float(weights[g * step + at])
            rows.append((at // (pairs * orientations), at // pairs % orientations, g, at % pairs, total))
    return spark.createDataFrame(rows, "distance_idx int, orientation_idx int, gradient_idx int, pair long, weight double")


def pair_table(edges: DataFrame, labels: DataFrame, model: DataFrame, classes: int) -> DataFrame:
    """Pairwise term of every edge under a labeling: by its bins and by the label of its higher end * classes + that of its lower end.

    Edges have gradient_idx, and orientation_idx and distance_idx if the model tells these apart."""
    e = with_ends(edges, labels, "label").withColumn("pair", (F.col("hi_label") * classes + F.col("lo_label")).cast("long"))
    on = [c for c in ("distance_idx", "orientation_idx", "gradient_idx") if c in edges.columns] + ["pair"]
    if "distance_idx" not in on:
        model = model.where("distance_idx = 0")
    if "orientation_idx" not in on:
        model = model.where("orientation_idx = 0")
    return e.join(model, on).select("hi", "lo", "pair", "weight")


def crf_energy(scores: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Energy of a labeling: minus the sum of its node scores minus the sum of its edge terms."""
    node = scores.join(labels, ["sid", "label"]).agg(F.sum("score").alias("node"))
    edge = pairs.agg(F.coalesce(F.sum("weight"), ONE(0.0)).alias("edge"))
    return node.crossJoin(edge).select(F.round("node", 6).alias("node"), "edge", F.round(-F.col("node") - F.col("edge"), 6).alias("energy"))  # one row each


def psi_nodes(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Node part of the joint feature vector: count and feature sums of every class, in long form."""
    f = features.join(labels, "sid").select("label", F.posexplode("f").alias("dim", "x"))
    return f.groupBy("label", "dim").agg(F.sum(F.col("x").cast("double")).alias("psi"))


def psi_edges(edges: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Pair part: cumulative counts (an edge of level g counts in every level up to g) of each label pair.

    With two classes an edge counts half for either order of its labels."""
    e = with_ends(edges, labels, "label").select(F.explode(F.sequence(ONE(0), F.col("gradient_idx"))).alias("level"), "hi_label", "lo_label")
    ways = [(F.col("hi_label"), F.col("lo_label"))] if classes > 2 else [(F.col("hi_label"), F.col("lo_label")), (F.col("lo_label"), F.col("hi_label"))]
    out = reduce(DataFrame.unionByName, [e.select("level", (a * classes + b).cast("long").alias("pair"), ONE(1.0 / len(ways)).alias("one")) for a, b in ways])
    return out.groupBy("level", "pair").agg(F.sum("one").alias("psi"))


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse class frequencies, scaled to sum to 1."""
    c = labels.groupBy("label").agg(F.count(ONE(1)).alias("n"))
    total = c.agg(F.sum(1 / F.col("n")).alias("t"))
    return c.crossJoin(F.broadcast(total)).select("label", "n", F.round(1 / F.col("n") / F.col("t"), 9).alias("weight"))  # one row


def hamming_loss(truth: DataFrame, guess: DataFrame, weights: DataFrame) -> DataFrame:
    g = guess.select("sid", F.col("label").alias("y"))
    return truth.join(g, "sid").join(weights.select("label", "weight"), "label").agg(
        F.sum((F.col("label") != F.col("y")).cast("long")).alias("n_wrong"), F.round(F.sum(F.when(F.col("label") != F.col("y"), F.col("weight")).otherwise(0.0)), 6).alias("loss"))


def region_confusion(truth: DataFrame, guess: DataFrame, sizes: DataFrame | None, classes: int = 3) -> DataFrame:
    """One-vs-rest confusion of region labels, weighted by region size if sizes (sid, n) is given."""
    j = truth.select("sid", F.col("label").alias("gt")).join(guess.select("sid", F.col("label").alias("y")), "sid")
    j = j.join(sizes.select("sid", "n"), "sid") if sizes is not None else j.withColumn("n", ONE(1))
    t = j.groupBy("gt", "y").agg(F.sum("n").alias("n"))
    c = t.select(F.explode(F.sequence(ONE(0), ONE(classes - 1))).alias("class"), "gt", "y", "n")
    s = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0))
    return c.groupBy("class").agg(s("gt = class and y = class").alias("tp"), s("gt <> class and y = class").alias("fp"), s("gt = class and y <> class").alias("fn"), s("gt <> class and y <> class").alias("tn"))


def overlap_loss(confusion: DataFrame) -> DataFrame:
    """One minus the mean intersection over union of the classes present on either side."""
    c = confusion.where("tp + fp + fn > 0")
    return c.agg(F.count(ONE(1)).alias("n_classes"), F.round(1 - F.avg(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))), 9).alias("loss"))


def binary_scores(confusion: DataFrame) -> DataFrame:
    """Rates derived from the confusion of each class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    r = lambda a, b: F.round(a / b, 9)
    return confusion.select("class", r(tp, tp + fn).alias("tpr"), r(fn, tp + fn).alias("fnr"), r(fp, fp + tn).alias("fpr"), r(tn, fp + tn).alias("tnr"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def masked_confusion(px: DataFrame, labels: DataFrame, guess: DataFrame, mask: Column, classes: int = 3) -> DataFrame:
    """Confusion over the masked pixels; the truth is the label of the region, not of the pixel."""
    n = px.where(mask).groupBy("sid").agg(F.count(ONE(1)).alias("n"))
    return region_confusion(labels, guess, n, classes)


def majority(px: DataFrame, label: str = "gt") -> DataFrame:
    """1 if more pixels are foreground than not; a tie is background."""
    return px.groupBy("sid").agg(F.when(F.sum(F.when(F.col(label) == 1, 1).otherwise(-1)) > 0, 1).otherwise(0).alias("label"))


def vote(labelings: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted vote of binary labelings: foreground where the weighted sum, divided by their number, exceeds a third of all weight."""
    total = sum(a for _, a in labelings)
    rows = reduce(DataFrame.unionByName, [d.select("sid", (F.col("label") * ONE(a)).alias("v")) for d, a in labelings])
    return rows.groupBy("sid").agg(F.when(F.sum("v") / len(labelings) > ONE(total / 3), 1).otherwise(0).alias("label"))


def boundary_postprocess(guess: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Boundary (2) regions none of whose neighbors has a stored label other than foreground (1) become foreground."""
    other = both_ways(edges).join(truth.where("label <> 1").select(F.col("sid").alias("nb")), "nb", "left_semi").select("sid").distinct().withColumn("o", ONE(True))
    return guess.join(other, "sid", "left").select("sid", F.when((F.col("label") == 2) & F.col("o").isNull(), 1).otherwise(F.col("label")).alias("label"))


def hops(sources: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(sid, hops) of regions within limit edges of a source: one checkpointed frontier a round.

    A neighbor of the last frontier is new unless it lies in that frontier or the one before."""
    pairs = checkpoint(both_ways(edges))
    rings = [checkpoint(sources.select("sid").distinct())]
    for _ in range(limit):
        step = rings[-1].join(pairs, "sid").select(F.col("nb").alias("sid")).distinct()
        for ring in rings[-2:]:
            step = step.join(ring, "sid", "left_anti")
        rings.append(checkpoint(step))
    return reduce(DataFrame.unionByName, [r.withColumn("hops", ONE(k)) for k, r in enumerate(rings)])


def distance_loss(labels: DataFrame, edges: DataFrame, limit: int = 7) -> DataFrame:
    """Hops to the nearest boundary region, at most limit, plus 1."""
    h = hops(labels.where("label = 2"), edges, limit)
    return labels.join(h, "sid", "left").select("sid", (F.coalesce("hops", ONE(limit)) + 1).cast("long").alias("loss"))


def neighbor_means(values: DataFrame, edges: DataFrame, value: str = "mean") -> DataFrame:
    """A region's own value and the mean over its direct neighbors (0 without neighbors)."""
    n = both_ways(edges).join(values.select(F.col("sid").alias("nb"), F.col(value).alias("x")), "nb").groupBy("sid").agg(F.avg("x").alias("m"))
    return values.join(n, "sid", "left").select("sid", F.round(value, 6).alias("own"), F.round(F.coalesce("m", ONE(0.0)), 6).alias("around"))


def order_range(vectors: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per dimension the order statistics at index floor(share * N).

    A counting form: values are aggregated first and only distinct values enter the running sum of their dimension."""
    from pyspark.sql import Window

    long = vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim", "x").agg(F.count(ONE(1)).alias("n"))
    w = Window.partitionBy("dim")
    c = long.withColumn("c", F.sum("n").over(w.orderBy("x"))).withColumn("t", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("c") > F.floor(F.col("t") * p), F.col("x")))
    return c.groupBy("dim").agg(at(low).alias("lo"), at(high).alias("hi"))


def min_max(vectors: DataFrame, ranges: DataFrame) -> DataFrame:
    """(x - lo) / (hi - lo) per dimension, not clipped; dimensions narrower than 1e-4 stay as they are."""
    r = F.broadcast(ranges)  # one row per dimension
    d = F.col("hi").cast("double") - F.col("lo").cast("double")
    x = F.col("x").cast("double")
    return vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).join(r, "dim").select("vec_id", "dim", F.round(F.when(d > 1e-4, (x - F.col("lo").cast("double")) / d).otherwise(x), 6).alias("x"))


def cropped(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of the corner, regions numbered anew from 0 in their old order.

    The ids in use are one row per region; the running number is taken over those alone."""
    from pyspark.sql import Window

    inside = px.where((F.col("x") < width) & (F.col("y") < height))
    ids = inside.select("sid").distinct().withColumn("new_sid", (F.row_number().over(Window.orderBy("sid")) - 1).cast("long"))
    return inside.join(ids, "sid").select("x", "y", "sid", "new_sid")


def mask_components(px: DataFrame, axes: tuple[str, ...] = ("x", "y"), least: int = 1, label: str = "gt") -> DataFrame:
    """Fully connected components of the pixels with label 1: (k, component = smallest k), small ones dropped.

    Minimum labels with pointer jumping: each round takes the least root around a pixel and then that root's root."""
    fg = px.where(F.col(label) == 1).select("k", *axes)
    around = fg.select(F.col("k").alias("nb"), *axes)
    for a in axes:
        around = around.withColumn(a, F.explode(F.array(F.col(a) - 1, F.col(a), F.col(a) + 1)))
    links = checkpoint(around.join(fg, list(axes)).select("k", "nb"))  # a pixel is its own neighbor
    state = checkpoint(links.groupBy("k").agg(F.min("nb").alias("r")))
    while True:
        best = links.join(state.select(F.col("k").alias("nb"), "r"), "nb").groupBy("k").agg(F.min("r").alias("m"))
        # the root of a root learns of it too, then every pixel jumps
        up = best.join(state, "k").groupBy(F.col("r").alias("k")).agg(F.min("m").alias("u"))
        nxt = best.join(up, "k", "left").select("k", F.least("m", F.coalesce("u", "m")).alias("m"))
        jump = nxt.select(F.col("k").alias("m"), F.col("m").alias("j"))
        nxt = checkpoint(nxt.join(jump, "m").select("k", F.col("j").alias("r")))
        if nxt.join(state.withColumnRenamed("r", "old"), "k").where("r <> old").isEmpty():
            break
        state = nxt
    size = state.groupBy("r").agg(F.count(ONE(1)).alias("n")).where(F.col("n") >= least)
    return state.join(size, "r").select("k", F.col("r").alias("component"), "n")
