"""Probabilistic suffix tree for language-model scoring (op7).

Contexts of every length are candidates; no length is set. A context is retained if its suffix is, if it
occurs twice in training, and if a leave-one-out divergence test says that its next-symbol distribution
predicts its own training tokens better than its suffix's by more than PRICE nats. Distributions are
smoothed by their suffix's: p(w|s) = (c(s,w) + ALPHA p(w|suffix)) / (c(s) + ALPHA). A token is scored by
the longest retained suffix of what precedes it in its document. Growing ends with the level that retains none.

The tree grows with the corpus and stays distributed: shards of the key space hold its counts, and blocks of
documents ask for what their own tokens need (see blocks.py). Level d takes one question for the pairs
(context of d tokens, next token) and, a round later, one for the contexts; pairs of level d+1 go with the
contexts of level d. Few positions reach the deeper levels: from round SAVED on a block's question carries
where it stands, the shards hand that back, and the next round goes on from there instead of from level 1, with
no older answers. Tokens that are left behind are summed up by document, so scoring reads the last state alone.
A pair is counted, here and in c(s), only if its shorter pair (suffix, token) is counted
twice or more: a token seen once after a context tells nothing more after a longer one.

Null or blank text: the end token alone. Repeated rows get one equal result each. Null doc_id: its
remainder is that of the empty string. A context whose gain equals PRICE is not retained. Without training
text every token has probability 1 / (0 + 0 + 1). Extra columns are ignored; an empty table gives an empty
table. Equal 64-bit keys are taken as equal words and contexts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BLOCK_CHARS, Block, Shard, asked, blocks_of, distinct, join_parts, question, shard_bits, split_parts, spread, spread_words, squeeze, squeeze_words, summary, told
from .common import mix

ALPHA, PRICE = 2.0, 4.0
END = 0x5EED
GOLD = np.uint64(0x9E3779B97F4A7C15)
PAIR, CONTEXT, STATE = 0, 1, 2
#: The first round that hands its state on. It stands at level 2, where p follows from counts of level 1.
SAVED = 3


def held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def gain(c: np.ndarray, repeated: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Leave-one-out gain of a context over its suffix, in nats.

    c: its tokens; repeated: those of pairs seen twice or more; terms: the sum of n ln((n - 1 + ALPHA q) / q) over
    these pairs. A pair seen once is left with ALPHA q alone, whatever q is."""
    return terms + (c - repeated) * np.log(ALPHA) - c * np.log(np.maximum(c - 1, 0) + ALPHA)


def of_words(words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """distinct() of the contexts of one token, given as indices of words: nothing but the words is hashed."""
    used = np.flatnonzero(np.bincount(words, minlength=len(keys)))
    with np.errstate(over="ignore"):
        h = mix(GOLD + keys[used])
    order, rank = np.argsort(h), np.empty(len(keys), np.int64)
    rank[used[order]] = np.arange(len(order))
    return h[order], rank[words]


def smoothed(count: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The probability of a token counted so often after a context with c tokens, from that by its suffix."""
    return (count + ALPHA * q) / (c + ALPHA)


class Walk:
    """A block's positions, level by level, as far as the first k rounds of answers go.

    questions: the distinct keys to ask for in this round, with what the block itself has to add, as (kind, level,
    keys, numbers); sums: by document its known tokens, its base score, and the logarithms of p of all tokens that
    are no candidates any more, p being the probability by the longest retained context so far; state: the candidates
    of level k-1, from which the next round goes on (resume) with nothing but this round's answers. The last walk
    asks nothing: where no context of level k-2 is retained, sums are complete."""

    def __init__(self, block: Block, k: int, folds: int, fold: int, totals: tuple[float, float] | None, resume: bool = False, last: bool = False):
        self.block, self.questions, self.state, self.adds = block, [], b"", last or k >= SAVED
        self.held = np.array([held_out(d, folds, fold) for d in block.ids], bool)
        n, words = len(block.words), block.words
        if k == 0:
            own = np.bincount(words[np.repeat(~self.held, block.counts)], minlength=len(block.keys))
            order = np.argsort(block.keys)
            self.questions.append((PAIR, 0, block.keys[order], own[order].astype(np.uint64)))
            return
        doc = np.repeat(np.arange(len(self.held)), block.counts)
        starts = np.cumsum(block.counts) - block.counts
        # candidates of a level: positions, if their context one level shorter is retained, and the count of that with the token
        if resume:
            start = k - 2
            parts = split_parts(block.known[STATE, k - 1][0])
            at, count = np.cumsum(spread_words(parts[0])), spread_words(parts[1])
            more = np.unpackbits(spread(parts[2], np.uint8), count=len(at)).astype(bool)
            self.sums = spread(parts[3], np.float64).reshape(3, -1).copy()
            # 1 where sums hold the logarithm already
            self.p, some = np.ones(n), at[count > 0]
            if k == SAVED + 1:
                one, n0, c1 = map(spread_words, parts[4:])
                self.p[some] = smoothed(one, c1[words[some - 1]], ((n0 + 1) / (totals[0] + totals[1] + 1))[words[some]])
            else:
                self.p[some] = spread(parts[4], np.float64)
        else:
            start, order = 1, np.argsort(block.keys)
            n0 = np.zeros(len(block.keys), np.int64)
            n0[order] = block.answer(PAIR, 0, len(block.keys)) >> np.uint64(1)
            q0 = (n0 + 1) / (totals[0] + totals[1] + 1)
            self.p = q0[words]
            self.sums = np.zeros((3, len(self.held)))
            if self.adds:
                self.sums[0], self.sums[1] = np.bincount(doc, (n0 > 0)[words], len(self.held)), np.bincount(doc, np.log(q0)[words], len(self.held))
            live = (n0 >= 2)[words]
            live = np.append(False, live[:-1])
            live[starts] = False
            at = np.flatnonzero(live)
            self.end(doc, np.flatnonzero(~live))
            before, kept = n0[words[at]], np.ones(len(at), bool)
        if last and resume:
            self.end(doc, at)
            return
        # by distinct word, as far as one word alone decides
        with np.errstate(over="ignore"):
            last_word, sym = mix(GOLD + block.keys), mix(~block.keys)
            h = last_word[words[at - 1]]
            for d in range(2, start + resume):
                h = mix((h + np.uint64(1)) * GOLD + block.keys[words[at - d]])
        for d in range(start, k + 1):
            if not (resume and d == start):
                if d > 1:
                    with np.errstate(over="ignore"):
                        h = mix((h + np.uint64(1)) * GOLD + block.keys[words[at - d]])
                if last and d == k - 1:
                    self.end(doc, at)
                    return
                ask = np.flatnonzero(before >= 2)
                pairs, first, inv = distinct(mix(h[ask] ^ sym[words[at[ask]]]), places=d + 1 == k)
                if d == k:
                    seen = inv[~self.held[doc[at[ask]]]]
                    self.questions.append((PAIR, d, pairs, np.bincount(seen, minlength=len(pairs)).astype(np.uint64)))
                    return
                got = block.answer(PAIR, d, len(pairs))
                count = np.zeros(len(at), np.int64)
                count[ask] = (got >> np.uint64(1)).astype(np.int64)[inv]
                # a longer context must occur twice; where it was counted, as a pair that ends one token earlier, that is known
                more = np.ones(n, bool)
                more[at] = count >= 2
                more = (at - starts[doc[at]] > d) & more[at - 1]
                if d + 1 == k:
                    # the pairs that this block adds up for all
                    mine = np.flatnonzero((got & np.uint64(1) == 1) & (got >= 4))
                    spots, times = at[ask[first[mine]]], (got[mine] >> np.uint64(1)).astype(np.float64)
                    here = (before >= 2) & ~self.held[doc[at]]
                    here = here[kept]
                # only now is it known which contexts of the level before are retained
                self.end(doc, at[~kept])
                at, h, count, more = at[kept], h[kept], count[kept], more[kept]
            if d == 1:
                contexts, inv = of_words(words[at - 1], block.keys)
            else:
                contexts, _, inv = distinct(h, places=False)
            if d + 1 == k:
                index = np.full(n, -1, np.int64)
                index[at] = inv
                row = index[spots]
                row, times, q = row[row >= 0], times[row >= 0], self.p[spots[row >= 0]]
                sums = [np.bincount(inv[here], minlength=len(contexts)), np.bincount(row, times, len(contexts)), np.bincount(row, times * np.log((times - 1 + ALPHA * q) / q), len(contexts))]
                self.questions.append((CONTEXT, d, contexts, np.stack([sums[0].astype(np.uint64), sums[1].astype(np.uint64), sums[2].astype(np.float64).view(np.uint64)], 1)))
                if k >= SAVED:
                    self.end(doc, at[count == 0])
                    some = at[count > 0]
                    parts = [squeeze_words(one[some]), squeeze_words(n0), squeeze_words(c1)] if k == SAVED else [squeeze(self.p[some])]
                    self.state = join_parts([squeeze_words(np.diff(at, prepend=0)), squeeze_words(count), squeeze(np.packbits(more)), squeeze(self.sums), *parts])
                keep = np.zeros(len(at), bool)
            else:
                c = block.answer(CONTEXT, d, len(contexts)).astype(np.int64)[inv]
                keep = c > 0
                self.p[at[keep]] = smoothed(count[keep], c[keep], self.p[at[keep]])
                if d == 1 and k == SAVED:
                    # all that p of level 2 depends on, in less than p takes
                    one, c1 = np.zeros(n, np.int64), np.zeros(len(block.keys), np.int64)
                    one[at], c1[words[at - 1]] = count, c
                self.end(doc, at[~more])
            at, h, before, kept = at[more], h[more], count[more], keep[more]

    def end(self, doc: np.ndarray, at: np.ndarray) -> None:
        """Adds to sums what the tokens at these positions still have to add."""
        if self.adds:
            self.sums[2] += np.bincount(doc[at], np.log(self.p[at]), len(self.held))


def answered(rows: pa.Table, bits: int, price: float) -> pa.Table:
    """A shard's answers: of pairs twice their count, plus 1 for the first block that has it in training; of contexts their
    count if they are retained, else 0."""
    kind = rows.column("kind")[0].as_py()
    if kind == STATE:  # the next round's
        return rows.select(["block", "kind", "level", "shard", "keys"]).rename_columns(["block", "kind", "level", "shard", "known"])
    if kind == PAIR:
        s = Shard(rows, bits)
        n = s.total(s.sent[0]).astype(np.uint64)
        known = n[s.at] * np.uint64(2)
        has = np.flatnonzero(s.sent[0])
        first = np.full(len(s.keys), -1)
        first[s.at[has[::-1]]] = has[::-1]
        known[first[first >= 0]] += np.uint64(1)
        return s.answers(known, np.array([int(n.sum()), int((n > 0).sum())]))
    s = Shard(rows, bits)
    c, repeated, terms = (s.total(x) for x in (s.sent[0], s.sent[1], s.sent[2].view(np.float64)))
    kept = (c > 1) & (gain(c, repeated, terms) > price)
    return s.answers(np.where(kept, c, 0)[s.at], np.array([int(kept.sum()), len(c)]))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, folds: int = 7, fold: int = 2, price: float = PRICE, max_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    blocks = blocks_of(docs, max_chars)
    bits, answers, totals, k = shard_bits(blocks), None, None, 0
    while True:

        def ask(row: pa.Table, got: pa.Table | None, k=k, totals=totals) -> pa.Table:
            w = Walk(Block(row, got, END), k, folds, fold, totals, k > SAVED)
            none = question(0, 0, 0, np.zeros(0, np.uint64), np.zeros(0), bits)
            b = w.block.block
            state = pa.table([[STATE], [k], [b], [b], [w.state], [b""]], schema=none.schema) if k >= SAVED else none
            return pa.concat_tables([none, state, *(question(b, *q, bits) for q in w.questions)])

        new = asked(blocks, answers, ask, lambda rows: answered(rows, bits, price))
        # a state holds what earlier answers have told
        answers = new if answers is None or k >= SAVED else answers.union(new)
        if k == 0:
            totals = tuple(summary(new, PAIR, 0))
        k += 1
        # round k - 1 has answered the pairs of level k - 1 and the contexts of level k - 2
        if k > 2 and summary(new, CONTEXT, k - 2)[0] == 0:
            break

    def score(row: pa.Table, got: pa.Table) -> pa.Table:
        w = Walk(Block(row, got, END), k, folds, fold, totals, k > SAVED, last=True)
        known, base, total = w.sums
        return pa.table({
            "doc_id": pa.array(w.block.ids, pa.int64()), "held_out": w.held, "n_tokens": w.block.counts, "n_known": known.astype(np.int64),
            "train_tokens": np.full(len(w.held), int(totals[0]), np.int64), "base_score": base / np.log(10), "score": total / np.log(10)})

    return told(blocks, answers.where(f"kind = {STATE}") if k > SAVED else answers, score, OUT)
