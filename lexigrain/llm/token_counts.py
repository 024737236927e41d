"""Token counts without tokenizing: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each position of a word; dynamic
programming carries, for each position, the best score and the number of pieces on that best way. Ties
are the tokenizer's: of ways with equal scores the one whose last piece is longest stays, and a character
without a piece of its own may also be unknown, at 10 below the least score. Unknown runs become their
UTF-8 bytes if the vocabulary falls back to bytes, else one piece. No piece goes on after a word's end,
so words are counted once for each worker and looked up afterwards.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import Memo, id_and_text

SPACE = "▁"
#: Words with the spaces before them: no piece has a space after another character, or has a line feed.
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
SPACED = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores; ``byte_fallback``: unknown text is spelled in bytes."""

    pieces: dict[str, float]
    byte_fallback: bool

    @property
    def unknown_score(self) -> float:
        return min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY


def load_vocabulary(path: str) -> Vocabulary:
    """The normal pieces of a vocabulary file with scores; marks and byte pieces aren't matched in text."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [k for k in range(file.get_piece_size()) if not (file.is_control(k) or file.is_unknown(k) or file.is_byte(k) or file.is_unused(k))]
    pieces = {file.id_to_piece(k): file.get_score(k) for k in normal}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece goes on after a word's end")
    return Vocabulary(pieces, any(map(file.is_byte, range(file.get_piece_size()))))


class Counter(Memo):
    """Piece counts and scores of texts, kept for ``most`` words of at most 64 characters.

    Unknown runs that aren't spelled in bytes are one piece even across words, so there a line feed,
    which is unknown, stays with its neighbours.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        super().__init__(self.word, most)
        self.fallback, self.unknown = vocabulary.byte_fallback, vocabulary.unknown_score
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.singles = {p for p in vocabulary.pieces if len(p) == 1}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word. ``ways[k]``: score, pieces and whether the last is unknown."""
        if self.singles.issuperset(word):  # nothing in it can be unknown
            scores, counts = [None] * len(word) + [0.0], [0] * (len(word) + 1)
            for last, (length, score) in self.automaton.iter(word):  # in the order of the ends, the longest first
                way = scores[last - length] + score
                if scores[last] is None or way > scores[last]:
                    scores[last], counts[last] = way, counts[last - length] + 1
            return counts[len(word) - 1], scores[len(word) - 1]
        ends: dict[int, list[tuple[int, float]]] = {}
        if len(self.automaton):
            for last, piece in self.automaton.iter(word):
                ends.setdefault(last, []).append(piece)
        ways: list[tuple[float, int, bool]] = [(0.0, 0, False)]
        for last, char in enumerate(word):
            best, alone = None, False
            for length, score in sorted(ends.get(last, ()), reverse=True):  # the longest first; later ones must be better
                alone = alone or length == 1
                before = ways[last + 1 - length]
                if best is None or before[0] + score > best[0]:
                    best = (before[0] + score, before[1] + 1, False)
            if not alone:
                before = ways[last]
                if best is None or before[0] + self.unknown > best[0]:
                    more = len(char.encode("utf-8", "surrogatepass")) if self.fallback else 0 if before[2] else 1
                    best = (before[0] + self.unknown, before[1] + more, True)
            ways.append(best)
        return ways[-1][1], ways[-1][0]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score); words' scores are added in order."""
        if not text:
            return 0, 0.0
        if not self.fallback:
            words = SPACED.findall(SPACE + text.replace(" ", SPACE))
        elif "  " in text or SPACE in text or text[0] == " ":
            words = WORD.findall(SPACE + text.replace(" ", SPACE))
        else:  # no space follows another, so the words are what stands between spaces
            words = (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
        counts, scores = zip(*map(self.__getitem__, words), strict=True)
        return sum(counts), sum(scores)


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """The counter of this worker, which keeps its words from task to task."""
    return Counter(load_vocabulary(path))


def count_tokens(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, score (of the best segmentation).

    Spaces become the vocabulary's word mark, one is put before the text; nothing else is normalised.
    Null counts as empty and has no tokens; rows repeated with one identifier are counted each; null
    identifiers are kept; an empty table gives no rows. Words are kept for later texts only up to 64
    characters; a longer one, which may be a whole text, takes memory in proportion while it is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path).text
        for batch in batches:
            found = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")
