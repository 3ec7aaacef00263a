"""Token counts under a unigram vocabulary, without making the tokens.

The text is cut at spaces as the tokenizer's word marker does ("▁word"), so words are independent and each distinct word is
solved once per worker. An Aho-Corasick automaton of the vocabulary lists the pieces that end at each character, longest first;
dynamic programming keeps the best score and its number of tokens for every prefix. Ties follow the tokenizer: scores
add up from the left in double precision, and of equal scores the piece that starts first (the longest) stays. A
character that is no piece itself may stand as unknown, at ten below the lowest score, and counts one token per byte (byte fallback).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000


class Counter:
    """Counts tokens of words of one vocabulary: (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best, tokens, single = [0.0] * (n + 1), [0] * (n + 1), 0
        at = 0  # prefixes up to here are done

        def unknown(end: int) -> None:
            best[end] = best[end - 1] + self.unknown
            tokens[end] = tokens[end - 1] + len(word[end - 1].encode())

        found: list[tuple[int, float]] = []
        end = 0
        for last, (length, score) in [*self.automaton.iter(word), (n, (0, 0.0))]:
            if last + 1 != end:
                if end:  # close the prefix whose pieces have been listed
                    for j in range(at + 1, end):
                        unknown(j)
                    top, count, single = None, 0, 0
                    for size, value in found:
                        candidate = value + best[end - size]
                        if top is None or candidate > top:
                            top, count = candidate, tokens[end - size] + 1
                        single |= size == 1
                    if not single and (candidate := self.unknown + best[end - 1]) > top:
                        top, count = candidate, tokens[end - 1] + len(word[end - 1].encode())
                    best[end], tokens[end], at = top, count, end
                found = []
                end = last + 1
            found.append((length, score))
        for j in range(at + 1, n + 1):
            unknown(j)
        return tokens[n]

    def text(self, text: str) -> int:
        words = text.replace(" ", MARK).split(MARK)
        if not words[0]:  # an opening space is the marker already
            words = words[1:]
        counts = list(map(self.cache.get, words))
        if None in counts:
            for i, count in enumerate(counts):
                if count is None:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    counts[i] = self.cache[words[i]] = self.word(MARK + words[i])
        return sum(counts)


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_counters: dict[int, Counter] = {}


def token_counts(df: DataFrame, text: Column, pieces: list[tuple[str, float]]) -> Column:
    """Number of tokens (bigint) of a whole text; null and empty texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: bounded by its tokenizer
    number = zlib.crc32(repr(pieces).encode())

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        if number not in _counters:
            _counters[number] = Counter(shared.value)
        counter = _counters[number]
        return pa.array(np.array([counter.text(t) if t else 0 for t in texts.to_pylist()], np.int64))

    return counted(text)
