"""Operators against values worked out by hand, and inference, learning and over-segmentation against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessgraph.operators import inference as I
from tessgraph.operators import learning as L
from tessgraph.operators import models as M
from tessgraph.operators import regions as R
from tessgraph.operators import slic as S

GRAPHS = {"chain4": (4, [(1, 0), (2, 1), (3, 2)]), "cycle4": (4, [(1, 0), (2, 1), (3, 2), (3, 0)]), "grid3x3": (9, [(k + 1, k) for k in range(9) if k % 3 < 2] + [(k + 3, k) for k in range(6)]), "alone": (3, [])}


def graph(name, classes, seed, attract=False):
    n, ends = GRAPHS[name]
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(len(ends), classes, classes))
    if attract:
        w = np.stack([np.diag([abs(x)] * classes) for x in rng.normal(size=len(ends))]) if ends else w
    return rng.normal(size=(n, classes)), np.array(ends, int).reshape(-1, 2), w


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("seed", range(8))
def test_labelings_reach_the_smallest_energy(name, seed):
    u, ends, w = graph(name, 2, seed, True)
    best = I.energy(u, ends, w, I.exact(u, ends, w))
    assert I.energy(u, ends, w, I.min_cut(u, ends, w)) == pytest.approx(best)
    assert I.energy(u, ends, w, I.expansion(u, ends, w)) == pytest.approx(best)
    u, ends, w = graph(name, 3, seed)
    best = I.energy(u, ends, w, I.exact(u, ends, w))
    if name in ("chain4", "alone"):  # exact on trees
        assert I.energy(u, ends, w, I.max_product(u, ends, w)[0]) == pytest.approx(best)
    start = I.energy(u, ends, w, np.argmax(u, 1))
    for y in (I.icm(u, ends, w), I.expansion(u, ends, w), I.sampling(u, ends, w, 0.01, 5, 3)):
        assert best - 1e-9 <= I.energy(u, ends, w, y)
    assert I.energy(u, ends, w, I.icm(u, ends, w)) <= start + 1e-9
    assert I.mean_field(u, ends, w)[1].sum(1) == pytest.approx(1)


def test_cut_needs_attraction_and_ties_take_the_lowest_class():
    u, ends, w = np.zeros((2, 2)), np.array([[1, 0]]), np.array([[[0.0, 1.0], [1.0, 0.0]]])
    with pytest.raises(ValueError):
        I.min_cut(u, ends, w)
    assert I.chosen("max_product", ends, w) == "max_product" and I.chosen("icm", ends, -w) == "min_cut" and I.chosen("icm", ends[:0], w[:0]) == "max"
    assert I.min_cut(u, ends, -w).tolist() == [0, 0] == np.argmax(u, 1).tolist()


def test_images_are_solved_apart(spark):
    scores = [(m, i, c, float((i * 3 + c * 5 + m) % 4)) for m in (0, 1) for i in range(4) for c in range(3)]
    edges = [(m, i + 1, i, (i + m) % 2) for m in (0, 1) for i in range(3)]
    weights = [(p * 37 % 11 - 5) / 4 for p in range(18)]

    def run(images):
        s = spark.createDataFrame([r for r in scores if r[0] in images], "image long, sid long, label int, score double")
        e = spark.createDataFrame([r for r in edges if r[0] in images], "image long, hi long, lo long, gradient_idx int")
        return {tuple(r) for r in I.labeled(s, e, M.pair_model(spark, weights, 3, 2), 3, "exact").collect()}

    assert run((0, 1)) == run((0,)) | run((1,)) and len(run((0, 1))) == 8
    s = spark.createDataFrame(scores, "image long, sid long, label int, score double")
    assert I.labeled(s.limit(0), s.limit(0).selectExpr("image", "sid hi", "sid lo", "label gradient_idx"), M.pair_model(spark, weights, 3, 2), 3).count() == 0


@pytest.mark.parametrize(("dx", "dy", "bin"), [(1, 0, 0), (0, 5, 2), (0, -5, 1), (-1, 0, 0), (3, 3, 0), (-3, -3, 0), (1, 5, 2), (-1, -5, 1), (1, -5, 1)])
def test_orientation_by_hand(spark, dx, dy, bin):
    node = spark.createDataFrame([(0, 10, 10, 5.0), (1, 10 + dx, 10 + dy, 28.0)], "sid long, cx long, cy long, mean double")
    got = R.edge_attributes(spark.createDataFrame([(1, 0)], "hi long, lo long"), node).first()
    # 23 / 115 * 5 + 0.5 = 1.5 -> 1; (dx^2 + dy^2) / 500 * 3 + 0.5 < 1 -> 0
    assert (got.gradient_idx, got.orientation_idx, got.distance_idx) == (1, bin, 0)


def test_vote_divides_by_the_number_of_models(spark):
    one, none = (spark.createDataFrame([(0, x)], "sid long, label int") for x in (1, 0))
    # (0.5 * 1 + 0.5 * 0) / 2 = 0.25 is not above 1 / 3; alone, 1 / 1 is; (0.9 + 0) / 2 = 0.45 is
    assert M.vote([(one, 0.5), (none, 0.5)]).first().label == 0 and M.vote([(one, 1.0)]).first().label == 1 and M.vote([(one, 0.9), (none, 0.1)]).first().label == 1


def test_rescaling_counts_the_lower_bin_twice(spark):
    px = lambda vs: spark.createDataFrame(list(enumerate(vs)), "k long, v int")
    # 100 pixels: 60 of 10, 39 of 20, 1 of 200. few = 1 -> lo 10; 60 + 60 >= 99 -> hi 10 as well: one value
    assert {(r.v) for r in R.rescaled(px([10] * 60 + [20] * 39 + [200])).collect()} == {0, 255}
    # 20 of 10, 50 of 20, 30 of 30: lo 10; 20 + 20, + 50 = 90, + 30 -> hi 30; 20 -> 127
    assert sorted({r.v for r in R.rescaled(px([10] * 20 + [20] * 50 + [30] * 30)).collect()}) == [0, 127, 255]
    # fewer than 100 pixels: the truncated lower share is 0, reached by the empty bin 0
    assert {r.k: r.v for r in R.rescaled(px([51, 255])).collect()} == {0: 255, 1: 255}


def test_pair_weights_are_cumulative_and_oriented(spark):
    model = M.pair_model(spark, list(range(2 * 3 * 4)), 2, 2, 3)
    edges = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 0, 0)], "hi long, lo long, gradient_idx int, orientation_idx int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "sid long, label int")
    # edge 1: pair 0 * 2 + 1, orientation 2: (8 + 1) + (12 + 8 + 1); edge 2: pair 3 of level 0
    assert {(r.hi, r.pair, r.weight) for r in M.pair_table(edges, labels, model, 2).collect()} == {(1, 1, 30.0), (2, 3, 3.0)}


def test_learning_steps_by_hand():
    w, truth, guess = np.array([1.0, 2.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert L.margin(w, truth, guess, 0.5) == 1.5 and L.gradient(w, truth, guess, 0.5).tolist() == [-1, 1] and not L.gradient(w, truth, guess, -2.0).any()
    new, step = L.updated(w, np.array([-1.0, 1.0]), 0.1, 0.5)
    assert new == pytest.approx([1.05, 1.8]) and step == pytest.approx([-0.05, 0.2])
    assert L.updated(w, np.zeros(2), 0.1, 0.0, (np.array([1.0, 1.0]), 0.9))[0] == pytest.approx([0.1, 1.1])
    assert L.projected(w, 1.5) == pytest.approx([0.5, 1.0]) and L.projected(np.array([-5.0, 1.0]), 1.5).tolist() == [-5, 1]
    kept = L.WorkingSet(truth, 2)
    assert kept.add(w, guess, 1.0) and not kept.add(w, guess.copy(), 1.0) and kept.add(w, np.array([0.0, 0.5]), 0.0) and kept.add(w, np.array([2.0, 2.0]), 0.0)
    assert len(kept) == 2 and kept.most_violated(w)[0].tolist() == [2, 2]
    assert L.best_iteration([(1, 0.5), (2, 0.9), (3, 0.9)]) == 2
    assert L.attractive(np.array([[1.0, 0, 0, 1]])) and not L.attractive(np.array([[1.0, 0, 0, 1], [0, 3, 0, 0]]))


def test_training_separates():
    rng = np.random.default_rng(0)
    xs, ys = rng.normal(size=(30, 2)), None
    ys = (xs[:, 0] > 0).astype(int)
    psi = lambda x, y: np.concatenate([x * (y == 0), x * (y == 1)])

    def oracle(k, w):
        y = max((0, 1), key=lambda c: w @ psi(xs[k], c) + (c != ys[k]))
        return psi(xs[k], y), float(y != ys[k])

    w, trace = L.train(np.zeros(4), [psi(x, y) for x, y in zip(xs, ys, strict=True)], oracle, 30)
    assert trace[-1] < trace[0] / 3 and np.mean([(w @ psi(x, 1) > w @ psi(x, 0)) == y for x, y in zip(xs, ys, strict=True)]) > 0.9


def test_slic_by_parts(spark):
    v = np.zeros((12, 12, 1))
    v[:, 6:] = 200
    sid = S.connected(S.clustered(v, 4, 10.0, 10), 4)
    assert all(len(np.unique(v[sid == k])) == 1 for k in np.unique(sid)) and sid[0, 0] == 0 and sorted(np.unique(sid)) == list(range(sid.max() + 1))
    assert S.seeds((10, 20), 5).tolist()[:2] == [[2, 2], [2, 7]] and len(S.seeds((10, 20), 5)) == 8
    # the lone pixel joins the neighbor on its left
    assert S.connected(np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]]), 2).tolist() == [[0] * 3] * 3
    assert S.edge_strength(np.arange(9.0).reshape(3, 3, 1)).tolist() == [[0, 0, 0], [0, 40, 0], [0, 0, 0]]
    assert S.lab(np.array([[0, 0, 0], [255, 255, 255]]))[:, 0] == pytest.approx([0, 100])
    rows = [(m, x, y, int(v[y, x, 0])) for m in (0, 1) for x in range(12) for y in range(12)]
    got = S.segmented(spark.createDataFrame(rows, "image long, x long, y long, v int"), 4).collect()
    assert len(got) == 288 and all(r.sid == sid[r.y, r.x] for r in got)


def test_adjacency_needs_an_interior(spark):
    px = spark.createDataFrame([(x, y, x) for x in range(2) for y in range(2)], "x long, y long, sid long")
    assert R.adjacency(px, ("x", "y")).count() == 0 and F is not None
