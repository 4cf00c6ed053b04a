"""Packing into fixed windows by minimum bin slack (op3).

Documents are encoded, closed with one id, and cut into full windows and one remainder. The remainders'
lengths form a histogram of at most capacity-1 numbers, whatever the corpus. On it the plan is made:
the longest length left opens a window, a bitset subset-sum finds the multiset of other lengths that
comes closest to the capacity, counts are backtracked, and that window is repeated as often as the
counts allow. Documents are then dealt to the planned places by their number within their length:
counts per partition give each partition its first number, so no group of equal lengths meets in one task.

Null text is the empty text (one id, the end). Null ids stay null. Rows are packed one by one, repeated or
not; equal lengths are dealt in the order of their numbers; an empty table gives an empty table; extra
columns are ignored. The vocabulary's ids must follow its merge order, as in the file that is the default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, vocabulary
from .common import batch_of, checkpoint, text_slices, tokenizer_path

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])


#: Rows of a plan that is broadcast, some 50 bytes each.
PLAN_ROWS = 200_000
_loaded: dict = {}


def encoder(path: str):
    """One encoder per Python worker and file: the library's byte-pair encoder, with the file's tokens and their ids as ranks."""
    if path not in _loaded:
        import tiktoken

        _, ranks, special = vocabulary(path)
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, with part and nth: its number within its length in its partition."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen, end = encoder(path).encode_to_numpy, TaskContext.get().partitionId(), [0] * (capacity + 1), end_id.to_bytes(4, "little")
        for batch in batches:
            for rows, texts in text_slices(batch):
                out = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                    ids = encode(text, allowed_special="all").astype("<u4").tobytes() + end
                    total = len(ids) // 4
                    for at in range(0, total, capacity):
                        cut = ids[4 * at : 4 * (at + capacity)]
                        n = len(cut) // 4
                        out.append((doc, at, n, zlib.crc32(cut), total, part, seen[n]))
                        seen[n] += 1
                yield batch_of(PIECE, [list(c) for c in zip(*out, strict=True)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum <= room: bitset subset sums, longest lengths first, then backtracked."""
    steps, reach = [], 1
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k_now = min(k, left)
            steps.append((length, k_now, reach))
            reach |= (reach << (length * k_now)) & mask
            left -= k_now
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, per window, first window, offset) for every length of every planned window kind."""
    left = {k: v for k, v in counts.items() if v}
    used: dict[int, int] = dict.fromkeys(left, 0)
    out, window = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        kind = fullest(left, capacity - longest)
        left[longest] += 1
        kind[longest] = kind.get(longest, 0) + 1
        times, offset = min(left[x] // m for x, m in kind.items()), 0
        for x in sorted(kind, reverse=True):
            m = kind[x]
            out.append((x, used[x], m * times, m, window, offset))
            used[x] += m * times
            offset += x * m
            left[x] -= m * times
            if not left[x]:
                del left[x]
        window += times
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, capacity, end_id, path))
    # at most capacity rows reach the driver; the first number of each (length, partition) stays in Spark
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("m"))
    from pyspark.sql import Window

    first = by_part.withColumn("first", F.sum("m").over(Window.partitionBy("length").orderBy("part")) - F.col("m")).select("length", "part", "first")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("m")).collect()}
    rows = plan(counts, capacity)
    # an Arrow table, as rows would start Python workers of another kind, which stay beside those of the other steps
    names = ["length", "lo", "numbers", "each", "window", "base"]
    planned = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows or [(0, 0, 0, 1, 0, 0)], strict=True)], names=names))
    numbered = cut.join(first, ["length", "part"]).withColumn("number", F.col("first") + F.col("nth"))
    # each window kind uses up a length, so the plan is bounded by the capacity; broadcast only if it is small indeed
    small = F.broadcast(planned) if len(rows) <= PLAN_ROWS else planned
    dealt = numbered.join(small, ["length"]).where("number >= lo and number < lo + numbers")
    return dealt.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("window") + F.floor((F.col("number") - F.col("lo")) / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (F.col("number") - F.col("lo")) % F.col("each") * F.col("length")).alias("offset"))
