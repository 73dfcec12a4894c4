"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces that end at a position;
the dynamic programme carries the best score and the number of pieces, no
segmentation. Ties follow the unigram model of the ``tokenizers`` library: scores
are added from left to right in double precision, a later candidate replaces an
earlier one only when strictly better, candidates of one end come with the
earliest start first, and a character without a piece of its own costs the lowest
score minus ten and counts one piece per byte. A vocabulary without pieces for all
bytes makes one unknown piece of neighbouring characters instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.workers import kept

MARK = "▁"
UNKNOWN = "￾<unk>￾"
UNKNOWN_PENALTY = 10.0
# Offset of the Zipf law that gives piece number r the score -log(r + offset).
ZIPF_OFFSET = 2.7
# Words of a Python worker whose counts are remembered, and the longest word remembered.
MEMO_WORDS = 400_000
MEMO_CHARS = 48


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces with their scores; bytes stand in for characters without a piece."""

    pieces: tuple[tuple[str, float], ...]

    @property
    def has_bytes(self) -> bool:
        """Is there a piece for every byte?"""
        names = {name for name, _ in self.pieces}
        return all(f"<0x{b:02X}>" in names for b in range(256))

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.pieces) - UNKNOWN_PENALTY


def unigram_from_pieces(path: str) -> UnigramVocabulary:
    """The pieces of a SentencePiece file as a unigram vocabulary, scored by Zipf's law on their order in the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, order = [(UNKNOWN, 0.0)], 0
    last = -math.log(model.get_piece_size() + ZIPF_OFFSET)
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i):
            continue
        if model.is_byte(i):
            pieces.append((model.id_to_piece(i), last))
        else:
            pieces.append((model.id_to_piece(i), -math.log(order + ZIPF_OFFSET)))
            order += 1
    return UnigramVocabulary(tuple(pieces))


class ViterbiCounter(dict):
    """Piece counts of words, computed when first asked for; a bounded memo."""

    def __init__(self, vocabulary: UnigramVocabulary):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.unknown_score
        self.bytes = vocabulary.has_bytes
        self.names = {name for name, _ in vocabulary.pieces}

    def fused(self, word: str) -> int:
        """Pieces of one word where some bytes have no piece: neighbours without a piece are one unknown, or its bytes if all have one."""
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, (length, score) in self.automaton.iter(word):
            ends[last + 1].append((length, score))
        best: list[float] = [0.0] * (size + 1)
        back: list[tuple[int, bool]] = [(0, False)] * (size + 1)
        for end in range(1, size + 1):
            reached = False
            for length, score in ends[end]:
                candidate = best[end - length] + score
                if not reached or candidate > best[end]:
                    best[end], back[end], reached = candidate, (length, False), True
            if all(length != 1 for length, _ in ends[end]):
                candidate = best[end - 1] + self.unknown
                if not reached or candidate > best[end]:
                    best[end], back[end] = candidate, (1, True)
        count, end = 0, size
        while end:
            length, unknown = back[end]
            start = end - length
            if unknown:
                while start and back[start][1]:
                    start -= 1
                lost = word[start:end].encode("utf-8", "surrogatepass")
                count += len(lost) if all(f"<0x{b:02X}>" in self.names for b in lost) else 1
            else:
                count += 1
            end = start
        return count

    def word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        size = len(word)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        end, reached, single = 0, True, True  # the end in work: has it a path, and a piece of one character?

        def close(at: int) -> None:
            if not single:
                score = best[at - 1] + self.unknown
                if not reached or score > best[at]:
                    best[at], count[at] = score, count[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))

        for last, (length, score) in self.automaton.iter(word):
            if last + 1 != end:
                close(end)
                reached = single = False
                for end in range(end + 1, last + 1):  # ends without a piece
                    close(end)
                end = last + 1
            candidate = best[end - length] + score
            if not reached or candidate > best[end]:
                best[end], count[end], reached = candidate, count[end - length] + 1, True
            single = single or length == 1
        close(end)
        reached = single = False
        for end in range(end + 1, size + 1):
            close(end)
        return count[size]

    def __missing__(self, word: str) -> int:
        found = self.word(MARK + word) if self.bytes else self.fused(MARK + word)
        if len(word) <= MEMO_CHARS:
            self[word] = found
        return found

    def text(self, text: str | None) -> int:
        """Pieces of a text: words begin at spaces, other white space is part of a word."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        if len(self) > MEMO_WORDS:
            self.clear()
        return sum(map(self.__getitem__, words))


def token_counter(spark: SparkSession, vocabulary: UnigramVocabulary):
    """A column function text -> number of tokens. The vocabulary is broadcast: its size does not follow the data."""
    shared = spark.sparkContext.broadcast({"pieces": vocabulary.pieces})

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept(shared.value, lambda: ViterbiCounter(UnigramVocabulary(shared.value["pieces"])))
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return count


def token_counts(docs: DataFrame, vocabulary: UnigramVocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row, repeated rows included.

    Null and empty texts have no tokens; whole texts are counted however long they
    are; nothing is shuffled. Other columns of ``docs`` play no part.
    """
    counter = token_counter(docs.sparkSession, vocabulary)
    counted: Column = counter(F.col(text))
    return docs.select(F.col(key).alias("doc_id"), counted.alias("n_tokens"))
