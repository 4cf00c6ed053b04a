"""BPE encoding and decoding by prefix-sharing trie traversal (op1).

Distinct words of a slice go into one trie. Depth first, every node learns the last token of the
encoding of its prefix from the states of its ancestors: token t (a suffix of the prefix) is the
last one exactly if the encoding of what precedes it ends in a token with which t forms a pair that
merging would leave alone. So a prefix that many words share is encoded once, and a word's ids are
read backwards along its path.

Row contract of ``encode``: one row per input row, in place; null text is the empty text (no ids);
repeated rows give repeated results; extra columns pass only if named in ``keep``; an empty table
gives an empty table. Memory is bounded by ENCODE_CHARS of text (or one longer text), and by CACHE_CHUNKS cached chunks beside those of one slice.
The empty token list decodes to the empty text; repeated special tokens stand for one id each.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch_of, text_slices, tokenizer_path

#: The pre-tokeniser's pattern, as documented with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words never cross such a place, so what lies between two of them can be encoded, and cached, alone.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Cached chunks, and the longest chunk that is cached.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 200
#: Characters whose distinct words share one trie.
ENCODE_CHARS = 1 << 22
FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict, dict[bytes, int], dict[str, int]]:
    """(the file, ids of tokens by their bytes, ids of special tokens by their text)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return spec, {bytes(letter[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}, special


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        spec, self.vocab, self.special = vocabulary(path)
        self.bytes = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        letter = byte_letters()
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.vocab[bytes(letter[c] for c in s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            c = self.vocab[self.bytes[a] + self.bytes[b]]
            self.merged[a, b] = rank
            self.parts.setdefault(c, (a, b, rank))
        self.stable: dict[tuple[int, int], bool] = {}
        self.fits: dict[int, bool] = {}  # left << 20 | right -> leaves(left, right)
        # the automaton of all tokens: a node is the longest end of what was read that begins a token
        self.nodes = [b"", *{token[:k] for token in self.vocab for k in range(1, len(token) + 1)}]
        self.node = {b: i for i, b in enumerate(self.nodes)}
        self.moves: dict[int, tuple[int, tuple]] = {}  # node << 8 | byte -> (next node, the tokens that end there)
        self.le = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.decimal = {i: str(i) for i in self.bytes}
        self.findall = regex.compile(PATTERN).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}  # what follows a space -> the ids of its chunk
        # the same two by id, for many ids at once
        self.written, self.read = (np.array([x.get(i) for i in range(max(x) + 1)], object) for x in (self.decimal, self.bytes))

    def leaves(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would end in just these two.

        Merges are undone from the last one: across the border, a pair may not exist whose merge comes
        before the merges that formed its two sides."""
        known = self.stable.get((left, right))
        if known is not None:
            return known
        a, b, rank_a, rank_b, ok = left, right, FAR, FAR, True
        while True:
            rank = self.merged.get((a, b), FAR)
            # a exists until its merge rank_a into a larger token, b until rank_b; ties: the left one is merged first
            if rank < rank_a and rank <= rank_b and rank < FAR:
                ok = False
                break
            up_a, up_b = self.parts.get(a), self.parts.get(b)
            if up_a is None and up_b is None:
                break
            if up_b is None or up_a is not None and up_a[2] > up_b[2]:
                a, rank_a = up_a[1], up_a[2]
            elif up_a is None or up_b[2] > up_a[2]:
                b, rank_b = up_b[0], up_b[2]
            else:  # the same merge on both sides happens left first: undo the right one first
                b, rank_b = up_b[0], up_b[2]
        if len(self.stable) > 2_000_000:
            self.stable.clear()
        self.stable[left, right] = ok
        return ok

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Of distinct words the ids, as little-endian 32-bit numbers.

        Sorted order is the trie's depth-first order: the path of states (last token of each prefix, node of the automaton)
        is cut back to the prefix shared with the next word and grown by its other bytes; the ids are read backwards along it.
        The tokens that end at a byte come from the automaton, longest first."""
        moves, fits, le, raw = self.moves, self.fits, self.le, self.bytes
        out: dict[bytes, bytes] = {}
        last, path, before = [-1], [0], b""
        for x in (fits, moves):
            if len(x) > 2_000_000:
                x.clear()
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], path[shared + 1 :]
            node = path[shared]
            for at in range(shared, len(word)):
                move = node << 8 | word[at]
                node, ends = moves.get(move) or self.moved(move)
                path.append(node)
                for n, t in ends:
                    start = at + 1 - n
                    key = last[start] << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self.leaves(last[start], t) if start else self.whole(t)
                    if ok:
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token ends {word[: at + 1]!r}")
            before = word
            at, ids = len(word), []
            while at:
                t = last[at]
                ids.append(le[t])
                at -= len(raw[t])
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def moved(self, move: int) -> tuple[int, tuple]:
        """The automaton's next node after node << 8 | byte, and (length, id) of the tokens that end there, longest first."""
        end = self.nodes[move >> 8] + bytes([move & 255])
        while end not in self.node:
            end = end[1:]
        ends = (end[k:] for k in range(len(end)))
        self.moves[move] = found = self.node[end], tuple((len(b), self.vocab[b]) for b in ends if b in self.vocab)
        return found

    def whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token."""
        up = self.parts.get(token)
        return up is None or self.leaves_inside(token)

    def leaves_inside(self, token: int) -> bool:
        key = (token, -1)
        if key not in self.stable:
            a, b, _ = self.parts[token]
            # both parts are reached by merging alone, and nothing across their border comes before
            self.stable[key] = self.whole(a) and self.whole(b) and self.reached(a, b)
        return self.stable[key]

    def reached(self, left: int, right: int) -> bool:
        """Like leaves(), but the pair itself may merge."""
        rank = self.merged.pop((left, right))
        known = self.stable.pop((left, right), None)
        ok = self.leaves(left, right)
        self.merged[left, right] = rank
        self.stable.pop((left, right), None)
        if known is not None:
            self.stable[left, right] = known
        return ok

    def of_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Of each chunk its ids, by one trie over the distinct words that are not yet known."""
        one, more = {}, {}  # chunks of one word, and of any number
        for c in chunks:
            if c.isascii() and (c.isalpha() or c[0] == " " and c[1:].isalpha()):
                one[c] = c.encode()
            elif c not in self.special:
                more[c] = [w.encode() for w in self.findall(c)]
        distinct = {w for ws in more.values() for w in ws}
        distinct.update(one.values())
        ids = self.words
        if len(ids) + len(distinct) > CACHE_CHUNKS:
            ids.clear()
        new = self.encode_words(distinct - ids.keys())
        ids.update(new)
        out = {c: ids[w] for c, w in one.items()}
        out.update((c, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for c, ws in more.items())
        for w in new:
            if len(w) >= CACHE_CHARS:
                del ids[w]
        return out | {c: self.le[i] for c, i in self.special.items() if c in chunks}

    def chunks(self, text: str) -> list[str]:
        """The text cut into chunks; a special token's text is a chunk of its own."""
        if self.split_special and any(s in text for s in self.special):
            return [c for k, part in enumerate(self.split_special(text)) if part for c in ([part] if k % 2 else CUT.split(part))]
        return CUT.split(text) if text else []

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text its ids. Python's search for reference cycles rests meanwhile: very many objects are made, without any."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.looked_up(texts) if texts else []
        finally:
            if on:
                gc.enable()

    def looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text its ids.

        A text is cut at its spaces if every one lies between two characters that are not white space: then
        each is a place that no word crosses. Other texts, and texts with special tokens, are cut by chunks().
        Chunks are looked up by what follows their space, once for each distinct one; only those not yet known are encoded."""
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        special = [any(s in t for s in self.special) for t in texts]
        parts = pc.split_pattern(pa.array(["" if x else t for t, x in zip(texts, special, strict=True)], pa.string()), " ")
        flat = parts.flatten().dictionary_encode()
        at, starts = flat.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()[:-1]
        distinct = flat.dictionary.to_pylist()
        found = list(map(known.get, distinct))
        missing = [i for i, f in enumerate(found) if f is None]
        bad = np.zeros(len(distinct), bool)  # a known one is not
        bad[[i for i in missing if not (p := distinct[i]) or p[0].isspace() or p[-1].isspace()]] = True
        plain = ~np.logical_or.reduceat(bad[at], starts)  # "" is bad too
        wanted = [(i, distinct[i]) for i in missing if not bad[i]]
        # the first chunk of a text has no space before it
        rows = [[distinct[at[start]]] if ok else self.chunks(t) for t, start, ok in zip(texts, starts.tolist(), plain.tolist(), strict=True)]
        more = self.of_chunks({" " + p for _, p in wanted}.union(*rows))
        for i, p in wanted:
            found[i] = more[" " + p]
            if len(p) < CACHE_CHARS:
                known[p] = found[i]
        for i in np.flatnonzero(bad).tolist():
            found[i] = b""
        # the texts that are not plain are one chunk here
        found += [b"".join([more[c] for c in cs]) for cs in rows]
        at[starts] = len(distinct) + np.arange(len(texts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = np.cumsum(sizes) - sizes, sizes[at]
        n[~np.repeat(plain, np.diff(parts.offsets.to_numpy()))] = 0
        n[starts] = sizes[at[starts]]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])]
        return np.split(ids, (ends - n)[starts[1:]])

    def digested(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of its ids, and the digests of its ids in decimal and of the text decoded from them."""
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for ids in self.encoded(texts):
            raw = b"".join(self.read[ids].tolist())
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            yield len(ids), sha(",".join(self.written[ids].tolist()).encode()), sha(raw)

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder, with its cache, per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids array<int>, decoded string: every whole text encoded, and decoded again from its ids."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part, texts in text_slices(batch, column, ENCODE_CHARS):
                ids = [x.view(np.int32) for x in bpe.encoded(texts)]
                out = [part.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", "decoded"])

    return docs.select(*keep, column).mapInArrow(run, schema)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, from the same encoder and decoder as encode().

    The digests are made where the ids are, so no id leaves the worker."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part, texts in text_slices(batch, max_chars=ENCODE_CHARS):
                yield batch_of(DIGEST, [part.column("doc_id"), *map(list, zip(*bpe.digested(texts), strict=True))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
