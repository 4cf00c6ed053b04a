"""Token counts by count-only Viterbi (op6).

A unigram vocabulary (pieces with scores) is matched by an Aho-Corasick automaton; dynamic programming
carries the best score and its number of pieces for every end, never the pieces. Ties go to the earliest
start, as in the tokenizers library's Unigram model: starts are taken in order and only a better score
replaces. A character without a piece of its own is unknown, at the lowest score minus 10; unknowns in a
row count once. Distinct words of a slice are solved once.

No public file at hand has unigram scores: the pieces of piece_bpe_32k.model are used, with
-ln(position + 1) as score, fixed by rule and never trained.

Null or blank text: 0 tokens. Repeated rows get equal results; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, text_slices, tokenizer_path

CACHED = 400_000
SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score); the first is the unknown piece. Control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [("<unk>", 0.0)] + [(p, -math.log(k + 1)) for k, p in enumerate(plain)]


class CountViterbi:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in vocab[1:]:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(s for _, s in vocab) - 10.0
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.found.iter(word):
            ends[last + 1].append((last + 1 - length, score))
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            single = False
            for start, score in sorted(ends[end]):
                single |= start == end - 1
                if top is None or best[start] + score > top:
                    top, pieces[end], unknown[end] = best[start] + score, pieces[start] + 1, False
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, pieces[end], unknown[end] = best[end - 1] + self.unknown, pieces[end - 1] + (not unknown[end - 1]), True
            best[end] = top
        return pieces[n]

    def text(self, text: str) -> int:
        total = 0
        for word, times in Counter(text.split()).items():
            n = self.known.get(word)
            if n is None:
                if len(self.known) >= CACHED:
                    self.known.clear()
                n = self.known[word] = self.count(SPACE + word)
            total += n * times
        return total


_loaded: dict[str, CountViterbi] = {}


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every whole text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = CountViterbi(vocabulary(path))
        model = _loaded[path]
        for batch in batches:
            for part, texts in text_slices(batch):
                yield batch_of(schema, [part.column("doc_id"), [model.text(t) for t in texts]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
