"""Quality rules: gradient-boosted trees over document statistics (op5).

Trees are fitted on at most MAX_LABELLED labelled rows (drawn by a hash of the id), kept as flat node
arrays and scored level by level in numpy. Monotonic constraints: more symbols, repeated lines or
repeated words never raise a score; splits that break this are refused and bounds pass down to the leaves.

Null or blank text: zero statistics, base_failed (fewer than 50 words), not kept. Repeated rows get
equal results; extra columns are ignored (kept by keep_rows); an empty table gives an empty table;
without both kinds of label the base rules alone decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, released, text_slices, word_arrays

MAX_LABELLED = 20_000
#: Share of good labelled rows that the trees' verdict may at most reject.
LOSS = 0.005
SYMBOLS = "#*$%&|<>"
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punct", "mean_line")
#: -1: the score may not rise with the feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
STATS = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeat_words(w: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    if len(w) < 4:
        return 0
    _, w = np.unique(w, return_inverse=True)
    size = len(w) + 1
    _, pair = np.unique(w[:-1].astype(np.int64) * size + w[1:], return_inverse=True)
    _, inv, n = np.unique(pair[:-1].astype(np.int64) * size + w[2:], return_inverse=True, return_counts=True)
    hit = n[inv] > 1
    cover = np.zeros(len(w), bool)
    for k in range(3):
        cover[k : len(w) - 2 + k] |= hit
    return int(cover.sum())


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics as in STATS, features as in FEATURES) of each text."""
    idx, counts, _ = word_arrays(texts)
    base, feats, at = np.zeros((len(texts), 5), np.int64), np.zeros((len(texts), len(FEATURES))), 0
    for i, (t, n) in enumerate(zip(texts, counts, strict=True)):
        w = idx[at : at + n]
        at += n
        if not n:
            continue
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        chars = len(t) - sum(map(t.count, " \t\n\r\x0b\x0c"))
        base[i] = n, chars, sum(map(t.count, SYMBOLS)), sum(c - 1 for c in Counter(lines).values()), repeat_words(w)
        code = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        upper, digit = ((code > 64) & (code < 91)).sum(), ((code > 47) & (code < 58)).sum()
        punct = ((code > 32) & (code < 48) | (code > 57) & (code < 65) | (code > 90) & (code < 97) | (code > 122) & (code < 127)).sum()
        feats[i] = np.log(n), chars / n, base[i, 2] / n, base[i, 3] / len(lines), base[i, 4] / n, len(np.unique(w)) / n ** 0.8, upper / chars, digit / chars, punct / chars, n / len(lines)
    return base, feats


class Trees:
    """Complete trees of one depth as flat arrays: node k has children 2k+1 and 2k+2; leaves are the last level."""

    def __init__(self, depth: int = 3):
        self.depth, self.start = depth, 0.0
        self.feature, self.limit, self.leaf = [], [], []

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    model = Trees(depth)
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin <= k exactly if x <= cuts[k]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(mean / (1 - mean)))
    score, inner = np.full(len(y), model.start), (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for k in range(inner):
            low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
            m = np.flatnonzero(at == k)
            best = (1e-6, None)
            gt, ht = g[m].sum(), h[m].sum()
            for j, c in enumerate(cuts):
                if not len(m) or not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[m, j], g[m], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[m, j], h[m], len(c) + 1))[:-1]
                gr, hr = gt - gl, ht - hl
                vl, vr = np.clip(gl / (hl + ridge), low[k], high[k]), np.clip(gr / (hr + ridge), low[k], high[k])
                gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl**2 - (hr + ridge) * vr**2
                gain[(hl < 1) | (hr < 1) | (sign[j] * (vr - vl) < 0)] = -np.inf
                b = int(np.argmax(gain))
                own = np.clip(gt / (ht + ridge), low[k], high[k])
                gain_b = gain[b] - (2 * gt * own - (ht + ridge) * own**2)
                if gain_b > best[0]:
                    best = (gain_b, (j, b, (vl[b] + vr[b]) / 2))
            if best[1] is not None:
                j, b, mid = best[1]
                feature[k], limit[k] = j, cuts[j][b]
                if sign[j] < 0:
                    low[2 * k + 1], high[2 * k + 2] = max(low[k], mid), min(high[k], mid)
            at[m] = 2 * k + 1 + (x[m, feature[k]] > limit[k])
        leaf = np.array([np.clip(g[at == k].sum() / (h[at == k].sum() + ridge), low[k], high[k]) for k in range(inner, 2 * inner + 1)]) * rate
        model.feature.append(feature), model.limit.append(limit), model.leaf.append(leaf)
        score = score + leaf[at - inner]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, where: str = "quality is not null") -> DataFrame:
    """doc_id, text, lang, quality of at most bound labelled rows, drawn by a hash of the id; an id's labels are averaged."""
    some = labels.where(where).where("doc_id is not null").groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]).join(F.broadcast(some), "doc_id")  # at most bound small rows


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[Trees, float] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(list(statistics(texts)[1]), pa.list_(pa.float64()))], names=["good", "x"])

    rows = labelled_sample(docs, labels, bound).mapInArrow(run, "good boolean, x array<double>").limit(2 * bound).toArrow()
    y = rows.column("good").to_numpy().astype(float)
    if len(y) < 40 or y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist())
    o = np.lexsort((*x.T, y))  # rows arrive in any order; the model does not depend on it
    model = fit(x[o], y[o])
    good = np.sort(model.score(x[y > 0.5]))
    return model, min(0.0, float(good[int(LOSS * len(good))]) - 1e-9)


def verdict(base: np.ndarray, feats: np.ndarray, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    score = np.zeros(len(base)) if model is None else model[0].score(feats)
    return failed, score, ~failed & (score >= (-np.inf if model is None else model[1]))


def judge(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of every row."""
    model = learn(docs, labels, bound)
    schema = pa.schema([("doc_id", pa.int64()), *STATS, ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                base, feats = statistics(texts)
                yield batch_of(schema, [part.column("doc_id"), *base.T, *verdict(base, feats, model)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    model = learn(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(verdict(*statistics(texts), model)[2]))
        released()

    return docs.mapInArrow(run, docs.schema)
