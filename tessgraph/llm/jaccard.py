"""Exact set-similarity join on word shingles with set-relation skipping (op9).

Every text becomes its set of distinct word shingles (64-bit keys). Equal sets form one class (a 128-bit key)
and are joined once. Blocks of documents ask in how many classes each of their shingles occurs (see blocks.py);
every class is ordered from its rarest shingle on, and its first ones go into index lists (prefix filter). Shingles
of one class alone need no list, so a text that has too many of them to link with anything is left out at once.

Lists are opened by blocks of set sizes and positions: sizes must allow the threshold, positions bound the overlap
that is still possible, and other blocks are skipped. In each list all sets are compared with a few pivot sets, the
same in as many lists as possible: a round takes PIVOTS comparisons a list entry at most. Sets linked with one pivot
are connected. What is left between components is derived from the overlaps with a common pivot: they bound the overlap of two sets from
both sides, and only pairs that the bounds leave open are compared. groups() needs no links inside a component;
answers() gives these too, derived in the same way from the overlaps with the component's root.

Null or blank text: empty set, linked with nothing, its own component. Null doc_id: linked with nothing, null
component. Repeated rows and ids: one output row per input row. Ties at the threshold link. Extra columns are
ignored; an empty table gives an empty table. Equal 64-bit keys are taken as equal shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, BLOCK_CHARS, Block, Shard, asked, blocks_of, distinct, question, shard_bits, squeeze_words, told
from .common import checkpoint_few, components, mix, released, tidy

FIRST, FREQUENCY = 0, 1
#: Pivots of a list and round. The same order picks them in all lists, so that lists share them.
PIVOTS = 8
#: Comparisons with one pivot that one task takes.
FANOUT = 2048
#: Rows of 32 bytes that are broadcast at most.
BROADCAST_ROWS = 200_000
MEMBER = "doc_id long, n long, cid binary, block long, at long"


def shingles(block: Block, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle keys of each text; a text with fewer words is one shingle."""
    w = block.keys[block.words]
    rolled = {}
    with np.errstate(over="ignore"):
        for k in range(1, width + 1):
            h = np.full(max(len(w) - k + 1, 0), np.uint64(k))
            for j in range(k):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
            rolled[k] = h
    out, at = [], 0
    for n in block.counts.tolist():
        k = min(width, n)
        out.append(np.unique(rolled[k][at : at + n - k + 1]) if n else np.zeros(0, np.uint64))
        at += n
    return out


def class_key(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n keys with any set it links to: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def members_of(row: pa.Table, width: int) -> pa.Table:
    b = Block(row, None)
    sets = shingles(b, width)
    cids = [class_key(s) if len(s) and i is not None else None for s, i in zip(sets, b.ids, strict=True)]
    return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "cid": pa.array(cids, pa.binary()), "block": pa.array([b.block] * len(sets), pa.int64()), "at": pa.array(range(len(sets)), pa.int64())})


def chosen(rows: pa.Table) -> pa.Table:
    """The rows of a block that stand for their classes, as an answer to it."""
    at = np.sort(rows.column("at").to_numpy())
    return pa.table({"block": rows.column("block")[:1], "kind": pa.array([FIRST], pa.int32()), "level": pa.array([0], pa.int32()), "shard": pa.array([0], pa.int64()), "known": pa.array([squeeze_words(at)], pa.binary())})


def own_sets(row: pa.Table, got: pa.Table | None, width: int) -> tuple[Block, list[np.ndarray], np.ndarray, np.ndarray]:
    """(block, sets that stand for their class, their distinct keys, how many of the sets have each)."""
    b = Block(row, got)
    first = set(b.given(FIRST, 0).tolist())
    sets = [s for i, s in enumerate(shingles(b, width)) if i in first]
    keys, _, inv = distinct(np.concatenate([np.zeros(0, np.uint64), *sets]))
    return b, sets, keys, np.bincount(inv, minlength=len(keys)).astype(np.uint64)


def live_sets(row: pa.Table, got: pa.Table, width: int, percent: int) -> pa.Table:
    """cid, n, keys (rarest first) and the places of those that go into lists, of the classes that may link."""
    b, sets, keys, _ = own_sets(row, got, width)
    often = b.answer(FREQUENCY, 0, len(keys))
    rows = []
    for s in sets:
        f = often[np.searchsorted(keys, s)]
        o = np.lexsort((s, f))
        top = np.flatnonzero(f[o[: len(s) - needed(len(s), percent) + 1]] > 1)
        if len(top):
            rows.append((class_key(s), len(s), s[o].view(np.int64), top))
    cid, n, all_keys, top = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"cid": pa.array(cid, pa.binary()), "n": pa.array(n, pa.int64()), "keys": pa.array(all_keys, pa.list_(pa.int64())), "top": pa.array(top, pa.list_(pa.int32()))})


def prepared(docs: DataFrame, width: int, percent: int, max_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets that may link: cid, n, keys; index lists of two or more classes: key, cid, n, pos)."""
    blocks = blocks_of(docs, max_chars)
    bits = shard_bits(blocks)
    members = checkpoint_few(told(blocks, None, lambda b, _: released(members_of(b, width)), MEMBER))
    first = members.where("cid is not null").groupBy("cid").agg(F.min(F.struct("block", "at")).alias("r")).select("r.*")
    reps = checkpoint_few(first.groupBy("block").applyInArrow(lambda rows: chosen(rows), ANSWER))

    def ask(row: pa.Table, got: pa.Table | None) -> pa.Table:
        b, _, keys, counts = own_sets(row, got, width)
        return released(question(b.block, FREQUENCY, 0, keys, counts, bits))

    def answer(rows: pa.Table) -> pa.Table:
        s = Shard(rows, bits)
        return s.answers(s.total(s.sent[0])[s.at])

    often = asked(blocks, reps, ask, answer)
    live = checkpoint_few(told(blocks, reps.union(often), lambda b, a: released(live_sets(b, a, width, percent)), "cid binary, n long, keys array<long>, top array<int>"))
    del blocks
    tidy(docs.sparkSession)
    posted = live.select("cid", "n", "keys", F.expr("top[0]").alias("lone"), F.explode("top").alias("pos")).select(F.expr("keys[pos]").alias("key"), "cid", "n", "pos", "lone")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    return members, live.select("cid", "n", "keys"), checkpoint_few(posted.join(shared, "key", "left_semi"))


def overlaps(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """a, b, na, nb, o of pairs of classes; b may be in any number of pairs: it is sent once for every FANOUT of them."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FANOUT).cast("int").alias("parts"))
    right = parts.join(whole, parts.b == whole.cid).select("b", F.col("keys").alias("kb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    spread = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    left = spread.join(whole, spread.a == whole.cid).select("a", "b", "part", F.col("keys").alias("ka"))
    return left.join(right, ["b", "part"]).select("a", "b", F.size("ka").alias("na"), F.size("kb").alias("nb"), F.size(F.array_intersect("ka", "kb")).alias("o"))


def links_if(o: str, percent: int) -> str:
    return f"{100 + percent} * ({o}) >= {percent} * (na + nb)"


def connected(docs: DataFrame, width: int = 4, percent: int = 85, max_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members; components: node, root; index lists: key, cid, n, pos; sets: cid, n, keys) over classes of equal sets."""
    members, whole, lists = prepared(docs, width, percent, max_chars)
    label = checkpoint_few(lists.select("cid", F.col("cid").alias("c")).distinct())
    with_pivot, turn = None, 0
    while True:
        labelled = lists.join(label, "cid")
        # every other pivot is one of the sets with the smallest share of keys of their own: it lies in the middle of its near copies
        share = lambda k: F.col("lone") / F.col("n") if k % 2 else F.lit(0.0)
        picked = [F.min_by(F.struct("cid", "n", "pos", "c"), F.struct(share(k), F.xxhash64("cid", F.lit(PIVOTS * turn + k)), "cid")) for k in range(PIVOTS)]
        pivot = labelled.groupBy("key").agg(F.array_distinct(F.array(*picked)).alias("ps"), F.max("c").alias("hi"), F.min("c").alias("lo")).where("hi > lo").select("key", F.explode("ps").alias("p"))
        near = labelled.join(pivot, "key").where("c <> p.c").where(F.expr(may_link("n", "pos", "p.n", "p.pos", percent)))
        pairs = checkpoint_few(near.select(F.col("cid").alias("a"), F.col("c").alias("ca"), F.col("p.cid").alias("b"), F.col("p.c").alias("cb")).distinct())
        tried = pairs.count()
        if not tried:
            break
        o = checkpoint_few(overlaps(pairs.select("a", "b"), whole))
        with_pivot = o if with_pivot is None else with_pivot.union(o)
        linked = o.where(links_if("o", percent)).select("a", "b")
        new = checkpoint_few(pairs.join(linked, ["a", "b"], "left_semi").select("ca", "cb").distinct())
        label = relabelled(label, new)
        turn += 1
        tidy(docs.sparkSession)
        if 50 * new.count() < tried:  # the sets that are left hardly link with any pivot
            break
    if with_pivot is not None:
        # what remains between components, list by list
        rest = opened(lists.join(label, "cid"), percent, "c <> c2", ["key"]).select("a", "b").distinct()
        links = derived(rest, with_pivot, whole, percent)
        of = lambda end: label.select(F.col("cid").alias(end), F.col("c").alias("c" + end))
        label = relabelled(label, checkpoint_few(links.join(of("a"), "a").join(of("b"), "b").select("ca", "cb").distinct()))
    return members, label.select(F.col("cid").alias("node"), F.col("c").alias("root")), lists, whole


def relabelled(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label (cid, c) after the components ca and cb of every edge have become one."""
    roots = components(edges, "ca", "cb")
    # a component of very many classes is one hot key: small tables of changes are broadcast, others left to skew joins
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    return checkpoint_few(label.join(roots, F.col("c") == F.col("node"), "left").select("cid", F.coalesce("root", "c").alias("c")))


def may_link(n: str, pos: str, m: str, pos_m: str, percent: int) -> str:
    """Sizes n, m allow the threshold, and so do the overlaps that are possible from these positions on."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({n} - {pos}, {m} - {pos_m}) * {100 + percent} >= {percent} * ({n} + {m})"


def derived(pairs: DataFrame, with_pivot: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b): from overlaps with a common pivot where these decide, else by comparing."""
    base = with_pivot.groupBy("a").agg(F.min_by(F.struct(F.col("b").alias("p"), F.col("nb").alias("m"), "o", F.col("na").alias("n")), F.struct(-F.col("o"), "b")).alias("r"))
    x, y = (base.select(F.col("a").alias(c), F.col("r").alias("r" + c)) for c in "ab")
    both = pairs.join(x, "a", "left").join(y, "b", "left").withColumns({"na": F.col("ra.n"), "nb": F.col("rb.n")})
    same = "coalesce(ra.p = rb.p, false)"
    high, low = links_if("least(ra.o, rb.o) + least(na - ra.o, nb - rb.o)", percent), links_if("ra.o + rb.o - ra.m", percent)
    known = checkpoint_few(both.where(f"not {same} or {high}").select("a", "b", F.expr(f"{same} and {low}").alias("sure")))
    return known.where("sure").select("a", "b").union(overlaps(known.where("not sure").select("a", "b"), whole).where(links_if("o", percent)).select("a", "b"))


def opened(lists: DataFrame, percent: int, where: str, on: list[str]) -> DataFrame:
    """a, b, c: pairs of one list (key, cid, n, pos, c) that may link: blocks of sizes, then exact size and position bounds."""
    step = float(np.log(100 / percent))
    block = F.floor(F.log(F.col("n").cast("double")) / step)
    left = lists.withColumn("block", block)
    right = lists.select(*on, F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), *([] if "c" in on else [F.col("c").alias("c2")]), F.explode(F.sequence(block - 1, block + 1)).alias("block"))
    once = F.expr("n < n2 or n = n2 and cid < cid2") & F.expr(may_link("n", "pos", "n2", "pos2", percent))
    return left.join(right, [*on, "block"]).where(where).where(once).select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"), "c")


def answers(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, n, cid; links: a, b): every pair a < b of classes that links, inside components too.

    The overlaps of all sets of a component with its root bound those among them from both sides; the whole
    sets are compared only where these bounds leave a pair open."""
    members, comp, live, whole = connected(docs, width, percent)
    own = whole.join(comp, whole.cid == comp.node)
    near = overlaps(own.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), whole)
    roots = own.where("node = root").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), F.col("n").alias("o"))
    lists = live.join(comp, live.cid == comp.node).select(*live.columns, F.col("root").alias("c"))
    pairs = opened(lists, percent, "true", ["c", "key"]).select("a", "b").distinct()
    return members, derived(pairs, checkpoint_few(near.union(roots)), whole, percent)


def link_counts(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_links of every row: how many other rows its text links with, equal sets included."""
    members, links = answers(docs, width, percent)
    weight = members.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("w"))
    ends = links.select("a", "b").union(links.select("b", "a"))
    more = ends.join(weight, ends.b == weight.cid).groupBy("a").agg(F.sum("w").alias("k"))
    per = weight.join(more, weight.cid == more.a, "left").select("cid", (F.col("w") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"))
    return members.join(per, "cid", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def groups(docs: DataFrame, width: int = 4, percent: int = 85, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    members, comp, _, _ = connected(docs, width, percent, max_chars)
    classes = members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comp, classes.cid == comp.node, "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    found = classes.join(least, "root").select("cid", "component")
    # a class of very many rows has one row a block here, so that no key of the two joins is hot
    per_block = members.where("cid is not null").select("cid", "block").distinct().join(found, "cid")
    rows = members.join(per_block, ["cid", "block"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
