"""Token blocks, and questions about keys that blocks put to shards (op7, op9).

A block is a run of whole documents as word keys. It sends the sorted distinct keys it wants to know
something about to shards, which are ranges of the key space; a shard adds up what all blocks sent for a
key and answers each block by an array in the order of its question. A block sends a frequent key once,
so no key is hot, and a shard's size does not depend on which keys are frequent. Questions and answers are
packed, and what a block knows is computed again from its words and the answers: nothing else is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hash_words, text_slices, tidy

#: Characters of a block (or one longer document), and keys of a shard.
BLOCK_CHARS, SHARD_KEYS = 1 << 22, 1 << 21
BLOCK = "block long, tokens long, ids array<long>, counts binary, words binary, keys binary"
ASKED = "kind int, level int, shard long, block long, keys binary, sent binary"
ANSWER = "block long, kind int, level int, shard long, known binary"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def spread(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def squeeze_words(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, none negative: each byte of theirs is a plane of its own, as far as the largest has any."""
    n = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([n]) + squeeze(np.concatenate([(x >> 8 * k).astype(np.uint8) for k in range(n)]))


def spread_words(b: bytes) -> np.ndarray:
    planes = spread(memoryview(b)[1:], np.uint8).reshape(b[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, b[0]):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def split_parts(b: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(b):
        size = int.from_bytes(b[at : at + 8], "little")
        parts.append(b[at + 8 : at + 8 + size])
        at += 8 + size
    return parts


def pieces(width: int) -> list[tuple[int, int]]:
    """(bytes, their first bit) of the standard integers that make up a number of so many bytes."""
    out, at = [], 0
    for size in (8, 4, 2, 1):
        if width & size:
            out.append((size, at))
            at += 8 * size
    return out


def pack_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys from base on as differences of equal width, piece by piece."""
    step = np.diff(keys, prepend=np.uint64(base))
    width = max((int(step.max()).bit_length() + 7) // 8, 1)
    return bytes([width]) + b"".join((step >> np.uint64(at)).astype(f"<u{size}").tobytes() for size, at in pieces(width))


def unpack_keys(b: bytes, base: int) -> np.ndarray:
    n, start = (len(b) - 1) // b[0], 1
    out = np.zeros(n, np.uint64)
    for size, at in pieces(b[0]):
        out |= np.frombuffer(b, f"<u{size}", n, start).astype(np.uint64) << np.uint64(at)
        start += n * size
    return np.cumsum(out, dtype=np.uint64) + np.uint64(base)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, index of each word, keys of the distinct words) of lower-cased ``[^\\x20\\x09-\\x0D]+``, split in C++."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.not_equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], ends])])
    return counts, at[real], hash_words(flat.dictionary.cast(pa.binary()))


def blocks_of(docs: DataFrame, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents (doc_id, text) as blocks, made once and dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        names = [f.split(" ")[0] for f in BLOCK.split(", ")]

        def made() -> pa.RecordBatch:
            ids = [i for part, _ in held for i in part]
            counts, words, keys = words_of(pa.concat_arrays([t for _, t in held]))
            row = [[block], [int(counts.sum())], pa.array([ids], pa.list_(pa.int64())), [squeeze(counts.astype(np.uint32))], [squeeze_words(words)], [keys.tobytes()]]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in row], names=names)

        for batch in batches:
            for part, _ in text_slices(batch, max_chars=max_chars, values=False):
                n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + n > max_chars:
                    yield made()
                    block, held, size = block + 1, [], 0
                held.append((part.column("doc_id").to_pylist(), part.column("text")))
                size += n
        if held:
            yield made()

    conf = docs.sparkSession.conf
    dealt = docs.select("doc_id", "text").mapInArrow(run, BLOCK).repartition(int(conf.get("spark.sql.shuffle.partitions")), "block")
    # written once in the shared folder, dealt by block: no round moves it again, no lost executor takes it along
    name = "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        out = checkpoint(dealt)
    finally:
        conf.set(name, before)
    del dealt
    tidy(docs.sparkSession)
    return out


def shard_bits(blocks: DataFrame) -> int:
    """Bits of a key that name its shard: by the number of tokens, and so that every task has some."""
    total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = max(2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_KEYS, 1)
    return min(wanted.bit_length(), 40)


class Block:
    """One block in memory: its words (with end, one more after each document) as indices into keys, and the answers it has got."""

    def __init__(self, row: pa.Table, answers: pa.Table | None, end: int | None = None):
        one = row.slice(0, 1).to_pylist()[0]
        self.block, self.ids = one["block"], one["ids"]
        self.counts = spread(one["counts"], np.uint32).astype(np.int64)
        keys = np.frombuffer(one["keys"], np.uint64)
        words = spread_words(one["words"])
        if end is not None:
            stops = np.cumsum(self.counts)
            words, keys = np.insert(words, stops, len(keys)), np.append(keys, np.uint64(end))
            self.counts = self.counts + 1
        self.keys, self.words = keys, words
        self.known: dict[tuple[int, int], list[bytes]] = {}
        if answers is not None:
            rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "level", "shard", "known")), strict=True), key=lambda r: r[:3])
            for kind, level, _, known in rows:
                self.known.setdefault((kind, level), []).append(known)

    def given(self, kind: int, level: int) -> np.ndarray:
        """The numbers of that kind and level in order of the shards, none if there are none."""
        return np.concatenate([np.zeros(0, np.uint64), *(spread_words(b).view(np.uint64) for b in self.known.get((kind, level), []))])

    def answer(self, kind: int, level: int, n: int) -> np.ndarray:
        """The answers to the n keys of that question."""
        got = self.given(kind, level)
        if len(got) != n:
            raise ValueError(f"block {self.block} asked for {n} keys, and got {len(got)} answers")
        return got


def grouped(keys: np.ndarray, same: int = 0) -> np.ndarray:
    """np.argsort(keys, stable) for hashes whose first same bits agree, in one sort of numbers.

    A number is the key's leading bits with its index below them. The few keys that agree in these bits alone are put right after."""
    low = np.uint64((1 << max(len(keys) - 1, 1).bit_length()) - 1)
    packed = ((keys << np.uint64(same)) & ~low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 1000:  # no hashes
        return np.argsort(keys, kind="stable")
    for i in wrong:
        lead = packed[i] & ~low
        a, z = np.searchsorted(packed, lead), np.searchsorted(packed, lead | low, side="right")
        part = np.sort(order[a:z])
        order[a:z] = part[np.argsort(keys[part], kind="stable")]
    return order


def distinct(keys: np.ndarray, places: bool = True, same: int = 0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """np.unique with first index (if places) and inverse, of hashes whose first same bits agree."""
    order = grouped(keys, same)
    found = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    inv = np.empty(len(keys), np.int64)
    inv[order] = np.cumsum(new) - 1
    return found[new], order[new] if places else None, inv


def question(block: int, kind: int, level: int, keys: np.ndarray, sent: np.ndarray, bits: int) -> pa.Table:
    """Rows of ASKED, one a shard: sorted keys, and a whole number (or several, sent column by column) for each."""
    shard = keys >> np.uint64(64 - bits)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    cuts = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    shards = [int(shard[a]) for a, _ in cuts]
    n = len(cuts)
    return pa.table({
        "kind": pa.array([kind] * n, pa.int32()), "level": pa.array([level] * n, pa.int32()), "shard": pa.array(shards, pa.int64()), "block": pa.array([block] * n, pa.int64()),
        "keys": pa.array([pack_keys(keys[a:b], s << (64 - bits)) for (a, b), s in zip(cuts, shards, strict=True)], pa.binary()), "sent": pa.array([join_parts([squeeze_words(x) for x in np.atleast_2d(sent[a:b].T)]) for a, b in cuts], pa.binary())})


class Shard:
    """What blocks asked one shard: distinct keys; at: the key of every question, in order of the blocks."""

    def __init__(self, rows: pa.Table, bits: int):
        self.kind, self.level, self.shard = (rows.column(c)[0].as_py() for c in ("kind", "level", "shard"))
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("block", "keys", "sent")), strict=True), key=lambda r: r[0])
        self.blocks = [b for b, _, _ in parts]
        asked = [unpack_keys(keys, self.shard << (64 - bits)) for _, keys, _ in parts]
        self.sizes = [len(a) for a in asked]
        # columns of numbers, one for each key asked
        self.sent = [np.concatenate(c) for c in zip(*([spread_words(x) for x in split_parts(sent)] for _, _, sent in parts), strict=True)]
        self.keys, _, self.at = distinct(np.concatenate(asked), places=False, same=bits)

    def total(self, column: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, column, len(self.keys))

    def answers(self, known: np.ndarray, summary: np.ndarray | None = None) -> pa.Table:
        """Rows of ANSWER from an array over all questions; summary goes to block -1."""
        cuts = np.cumsum([0, *self.sizes])
        rows = [(b, squeeze_words(known[a:z].astype(np.uint64))) for b, a, z in zip(self.blocks, cuts[:-1], cuts[1:], strict=True)]
        rows += [] if summary is None else [(-1, squeeze_words(summary.astype(np.uint64)))]
        n = len(rows)
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([self.kind] * n, pa.int32()), "level": pa.array([self.level] * n, pa.int32()), "shard": pa.array([self.shard] * n, pa.int64()), "known": pa.array([r[1] for r in rows], pa.binary())})


def told(blocks: DataFrame, answers: DataFrame | None, each: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """each(block, its answers) of every block. Only the answers are moved: blocks are dealt by block already."""
    if answers is None:
        return blocks.groupBy("block").applyInArrow(lambda b: each(b, None), schema)
    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(lambda b, a: each(b, a), schema)


def asked(blocks: DataFrame, answers: DataFrame | None, ask, answer) -> DataFrame:
    """One round: all blocks ask, all shards answer; the answers are written."""
    questions = told(blocks, answers, ask, ASKED)
    out = checkpoint(questions.groupBy("kind", "level", "shard").applyInArrow(lambda rows: answer(rows), ANSWER))
    del questions
    tidy(blocks.sparkSession)
    return out


def summary(answers: DataFrame, kind: int, level: int) -> np.ndarray:
    """Sum of the shards' summaries: one small row a shard."""
    rows = answers.where(f"block = -1 and kind = {kind} and level = {level}").select("known").toArrow().column("known").to_pylist()
    return np.sum([spread_words(b).astype(np.float64) for b in rows], 0) if rows else np.zeros(2)
