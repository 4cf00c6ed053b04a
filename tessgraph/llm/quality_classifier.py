"""Quality classifier: interpolated modified Kneser-Ney model of byte n-grams (op4).

Trained on trusted text: every row labelled good (a caller may bound that: then about so many rows, drawn by a
hash of the id as evenly by language as there are rows). Counts are summed in Spark, sharded by n-gram. Every
trusted row of 200 characters or more is then measured by a model that has not seen it, and these perplexities
give each language's limit (a quantile, with an allowance for short texts); a document above it is rejected.
The model has one entry for each distinct byte n-gram of the trusted rows, which grow much slower than the rows,
so it is sent to the scorers instead of joining every n-gram of the corpus with it.

Null or empty text: perplexity null, not kept. A null or rare language takes the limit of all
languages together. Without trusted text everything that is not empty is kept. Repeated rows get equal
results; extra columns are ignored (kept by keep_rows); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bitmap_of, checkpoint, inside, released, text_slices

ORDER = 4
#: n-grams that a task holds before it adds them up.
HELD_GRAMS = 1 << 22
#: Held-out quantile of log perplexity, and allowance for short texts (divided by the root of their bytes).
QUANTILE, SHORT = 0.99, 2.0
#: Parts of the trusted rows, each measured by a model of the other parts; rows that a language's own limit takes.
FOLDS, LEAST_HELD_OUT = 5, 20


def grams(text: str) -> np.ndarray:
    """The byte n-grams of a text, each as one number; the text is preceded by line ends."""
    b = np.frombuffer(b"\n" * (ORDER - 1) + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    key = b[: len(b) - ORDER + 1].copy()
    for k in range(1, ORDER):
        key = key << 8 | b[k : len(b) - ORDER + 1 + k]
    return key


class KneserNey:
    """keys[k], mass[k]: (k+1)-grams and their discounted shares; contexts[k], backoff[k]: what their contexts leave to the shorter model."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.mass, self.contexts, self.backoff = [], [], [], []
        o = np.argsort(keys)
        keys, counts = keys[o], counts[o]
        for order in range(ORDER, 0, -1):
            n = [max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = np.array([0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) for k in (1, 2, 3))])
            cut = d[np.minimum(counts, 3)]
            ctx, inv = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(inv, counts)
            self.keys.insert(0, keys)
            self.mass.insert(0, (counts - cut) / total[inv])
            self.contexts.insert(0, ctx)
            self.backoff.insert(0, np.bincount(inv, cut) / total)
            # continuation counts: in how many contexts each shorter n-gram was seen
            keys, counts = np.unique(keys & ((1 << 8 * (order - 1)) - 1), return_counts=True)

    def log_perplexity(self, text: str) -> float | None:
        full = grams(text)
        if not len(full):
            return None
        distinct, times = np.unique(full, return_counts=True)
        p = np.full(len(distinct), 1 / 256)
        for k in range(ORDER):
            key = distinct & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            own = np.where(self.keys[k][at] == key, self.mass[k][at], 0.0)
            c = np.minimum(np.searchsorted(self.contexts[k], key >> 8), len(self.contexts[k]) - 1)
            p = own + np.where(self.contexts[k][c] == key >> 8, self.backoff[k][c], 1.0) * p
        return float(-(np.log(p) * times).sum() / times.sum())


def shares(counts: dict, bound: int) -> dict:
    """The share of each key's rows to draw, so that about bound rows are drawn, as evenly by key as the counts allow."""
    out, left = {}, bound
    for k, (key, n) in enumerate(sorted(counts.items(), key=lambda kn: kn[1])):
        some = min(n, left / (len(counts) - k))
        out[key] = some / n
        left -= some
    return out


def drawn(docs: DataFrame, ids: DataFrame, bound: int) -> DataFrame:
    """The ids of about bound trusted rows."""
    trusted = docs.select("doc_id", "lang").join(ids.select("doc_id"), "doc_id")
    counts = {r["lang"]: r["count"] for r in trusted.groupBy("lang").count().collect()}  # one row a language
    share = docs.sparkSession.createDataFrame(list(shares(counts, bound).items()), "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return trusted.join(F.broadcast(share), trusted.lang.eqNullSafe(share.lang)).where(draw < F.col("share")).select("doc_id").distinct()


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold, k, n: the n-grams of the texts of each fold, added up for every HELD_GRAMS of them."""
    held, size = {}, 0

    def added() -> Iterator[pa.RecordBatch]:
        for f, parts in held.items():
            k, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f)), pa.array(k), pa.array(n)], names=["fold", "k", "n"])

    for batch in batches:
        for part, texts in text_slices(batch):
            for f, t in zip(part.column("fold").to_pylist(), texts, strict=True):
                if t:
                    held.setdefault(f, []).append(grams(t))
                    size += len(held[f][-1])
            if size > HELD_GRAMS:
                yield from added()
                held, size = {}, 0
    yield from added()
    held.clear()
    released()


def learn(docs: DataFrame, labels: DataFrame, bound: int | None = None):
    """(model, limits by language, limit of all), or None without trusted text. bound: train on about so many trusted rows, not on all."""
    spark = docs.sparkSession
    ids = checkpoint(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id")))
    if ids.isEmpty():
        return None
    maybe = spark.sparkContext.broadcast(bitmap_of(ids, "h"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).alias("fold")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(inside(maybe.value, batch.column("h").to_numpy().view(np.uint64)))).drop_columns(["h"])

    # only texts that are likely to be trusted are moved; the join says which ones are (the same join at every size)
    texts = docs.where("doc_id is not null").select("doc_id", "text", fold, F.xxhash64("doc_id").alias("h")).mapInArrow(likely, "doc_id long, text string, fold long")
    chosen = ids.select("doc_id") if bound is None else drawn(docs, ids, bound)
    rows = texts.join(chosen.hint("merge"), "doc_id", "left_semi").select("fold", "text").mapInArrow(count, "fold long, k long, n long").groupBy("fold", "k").agg(F.sum("n").alias("n")).toArrow()
    if not len(rows):
        return None
    folds, key, n = (rows.column(c).to_numpy() for c in ("fold", "k", "n"))

    def model_of(used: np.ndarray) -> KneserNey | None:
        k, inv = np.unique(key[used], return_inverse=True)
        return KneserNey(k, np.bincount(inv, n[used]).astype(np.int64)) if len(k) else None

    # a trusted row is measured by the model that has not seen its fold
    unseen = spark.sparkContext.broadcast([model_of(folds != f) for f in range(FOLDS)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(inside(maybe.value, batch.column("h").to_numpy().view(np.uint64))))
            for part, texts in text_slices(batch):
                models = [unseen.value[f] for f in part.column("fold").to_pylist()]
                lps = [m.log_perplexity(t) if m and len(t) >= 200 else None for m, t in zip(models, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(lps, pa.float64())], names=["doc_id", "lang", "lp"])
        released()

    some = docs.where("doc_id is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"), fold)
    held = some.mapInArrow(score, "doc_id long, lang string, lp double").where("lp is not null").join(ids, "doc_id", "left_semi")
    limit = F.percentile_approx("lp", F.lit(QUANTILE), F.lit(10000)).alias("limit")
    found = [r for r in held.rollup("lang").agg(F.grouping("lang").alias("all"), F.count(F.lit(1)).alias("n"), limit).collect() if r["n"]]
    by = {r["lang"]: r["limit"] for r in found if not r["all"] and r["lang"] is not None and r["n"] >= LEAST_HELD_OUT}
    return model_of(folds >= 0), by, max([r["limit"] for r in found if r["all"]], default=float("inf"))


def verdict(texts: list[str], langs: list, model) -> tuple[list, list, list]:
    lps, limits = [], []
    for t, x in zip(texts, langs, strict=True):
        lp = None if model is None or not t else model[0].log_perplexity(t)
        lps.append(lp)
        limits.append(None if lp is None else model[1].get(x, model[2]) + SHORT / len(t.encode("utf-8", "surrogatepass")) ** 0.5)
    return lps, limits, [bool(t) and (a is None or a <= b) for t, a, b in zip(texts, lps, limits, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, bound: int | None = None) -> DataFrame:
    """doc_id, lang, log_perplexity (per byte), log_limit, kept of every row."""
    model = learn(docs, labels, bound)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("log_perplexity", pa.float64()), ("log_limit", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                langs = part.column("lang")
                yield batch_of(schema, [part.column("doc_id"), langs, *verdict(texts, langs.to_pylist(), model)])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, log_perplexity double, log_limit double, kept boolean")


def keep_rows(docs: DataFrame, labels: DataFrame, bound: int | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    model = learn(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(verdict(texts, part.column("lang").to_pylist(), model)[2]))
        released()

    return docs.mapInArrow(run, docs.schema)
