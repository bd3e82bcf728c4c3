"""Token counts by a count-only Viterbi over a unigram vocabulary (operator 2).

An Aho-Corasick automaton finds every vocabulary piece in a stretch of text; dynamic programming carries
the best score and its number of pieces, and no piece is ever written out. Text is parted only where no piece
can reach across, so stretches are independent and their counts are remembered.
"""

from __future__ import annotations

import re
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import append_columns

#: Sign for a blank inside pieces.
BLANK = "▁"
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
KNOWN_STRETCHES = 600_000


def read_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Scores of the ordinary pieces of a ``sentencepiece`` file, and whether it has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    bytes_ = sum(model.is_byte(i) for i in ids)
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}, bytes_ == 256


class UnigramCounter:
    """Number of pieces, and score, of the best segmentation of texts.

    The rules are those of the public unigram tokenizers: among segmentations of equal score the one whose last
    piece begins earliest wins, at every place; a character where no piece of one character begins may stand alone at the unknown
    score, and counts its UTF-8 bytes if the vocabulary has byte pieces (else neighbouring ones count once together).
    """

    def __init__(self, pieces: dict[str, float], byte_pieces: bool) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        lines = any("\n" in p for p in pieces)
        inner = BLANK if lines else f"{BLANK}\n"
        parted = f"{BLANK}*[^{inner}]+|{BLANK}+" + ("" if lines else "|\n")
        #: Where text may be parted; unknown characters that count together must not be.
        self.stretches = re.compile(parted if byte_pieces and not crossing else "(?s:.+)").findall
        self.counts: dict[str, int] = _Remembered(self, 0)
        self.scores: dict[str, float] = _Remembered(self, 1)

    def best(self, stretch: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a stretch."""
        n = len(stretch)
        score, count, unknown = [0.0] + [-inf] * n, [0] * (n + 1), [False] * (n + 1)
        found: dict[int, list[tuple[int, float]]] = {}
        for end, (length, value) in self.automaton.iter(stretch):
            found.setdefault(end + 1, []).append((end + 1 - length, value))
        for end in range(1, n + 1):
            options = found.get(end, ())
            for start, value in sorted(options):
                if score[start] + value > score[end]:
                    score[end], count[end], unknown[end] = score[start] + value, count[start] + 1, False
            c = stretch[end - 1]
            if c not in self.single and score[end - 1] + self.unknown > score[end]:
                more = len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else int(not unknown[end - 1])
                score[end], count[end], unknown[end] = score[end - 1] + self.unknown, count[end - 1] + more, True
        return count[n], score[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = self.stretches(BLANK + text.replace(" ", BLANK))
        return sum(map(self.counts.__getitem__, parts)), sum(map(self.scores.__getitem__, parts))


class _Remembered(dict):
    """Counts or scores of stretches, up to a bound."""

    def __init__(self, counter: UnigramCounter, which: int) -> None:
        super().__init__()
        self.counter, self.which = counter, which

    def __missing__(self, stretch: str):
        both = self.counter.counts, self.counter.scores
        for known in both:
            if len(known) > KNOWN_STRETCHES:
                known.clear()
        for known, value in zip(both, self.counter.best(stretch), strict=True):
            known[stretch] = value
        return self[stretch]


_counters: dict[str, UnigramCounter] = {}


def counter_of(path: str) -> UnigramCounter:
    """The counter of a vocabulary file, built once in each worker process."""
    if path not in _counters:
        _counters[path] = UnigramCounter(*read_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``best_score``, the sum of the piece scores.

    A blank goes before a text that is not empty, as these vocabularies expect. Null and empty texts have no tokens and score 0.
    ``vocabulary`` is a ``sentencepiece`` file that every executor can read. An input column with the name of a new one gives way to it.
    """

    def count(texts: pa.Array) -> list[pa.Array]:
        counter = counter_of(vocabulary)
        found = [counter(t) for t in texts.to_pylist()]
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]

    return append_columns(docs, [text], "n_tokens long, best_score double", count)
