"""Noisy-channel restoration of disguised words: a character lattice, decoded by Viterbi under a character model.

The channel may have replaced letters by look-alikes, repeated letters, and put separators between them. A trigram
model of characters, counted over all documents, says which restoration is likely.
"""

from __future__ import annotations

import re
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.functions.parsing import column
from tablewright.llm.common import summed_arrays

# The letters that the model knows; every other character is a word boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôûùñíóáúœæ"
SYMBOLS = len(LETTERS) + 1
BOUNDARY = 0

# Look-alikes of letters in disguised words.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "§": "s",
    "µ": "u",
}

# Costs of the channel, in nats.
LOOKALIKE_COST = 1.0
DOUBLE_COST = 5.0  # the second of two equal characters is an insertion
REPEAT_COST = 0.3  # each further one
LOOKALIKE_DROP_COST = 8.0
SEPARATOR_DROP_COST = 0.5
BREAK_COST = 4.0
SPACE_DROP_COST = 0.2
SPACE_BREAK_COST = 0.7
SMOOTHING = 0.01

_CLASS = np.zeros(0x250, np.int64)
for _k, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _k + 1
_INDEX = {c: k + 1 for k, c in enumerate(LETTERS)}

#: Single characters with one blank between them: a word that has been spaced out, with its neighbours.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_THRICE = re.compile(r"(.)\1\1")


def _classes(texts: pa.Array) -> np.ndarray:
    joined = "\n".join(t.lower() for t in texts.to_pylist() if t is not None)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], BOUNDARY)


def train_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Cost in nats of each character after the two before it, from the trigrams of all texts.

    An array of SYMBOLS ** 3 counts is summed over all documents. Without documents all characters cost alike.
    """

    def add(total: np.ndarray, texts: pa.Array) -> None:
        c = np.concatenate([[BOUNDARY, BOUNDARY], _classes(texts), [BOUNDARY]])
        c = c[np.append(True, (c[1:] != BOUNDARY) | (c[:-1] != BOUNDARY))]  # runs of boundaries are one
        c = np.concatenate([[BOUNDARY], c])
        np.add(total, np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3), out=total)

    counts = summed_arrays(docs.select(column(text).cast("string").alias("text")), SYMBOLS**3, add).reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    pairs = counts.sum(0) + SMOOTHING
    after_one = pairs / pairs.sum(1, keepdims=True)
    mixed = (counts + 2 * after_one[None]) / (counts.sum(2, keepdims=True) + 2)
    return -np.log(mixed)


class Restorer:
    """Most likely letters of a token. Results are remembered, up to a bound."""

    KNOWN = 100_000

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > self.KNOWN:
                self.known.clear()
            found = self.known[token] = self.decode(token)
        return found

    def options(self, token: str, at: int) -> list[tuple[str, float]]:
        """What the character may stand for: letters, nothing (``""``) or a break (``" "``), with their costs."""
        c = token[at]
        again = REPEAT_COST if token[max(at - 2, 0) : at] == c + c else DOUBLE_COST if at and token[at - 1] == c else inf
        if c in _INDEX:
            return [(c, 0.0), ("", again)] if again < inf else [(c, 0.0)]
        if c in " \t":
            return [("", SPACE_DROP_COST), (" ", SPACE_BREAK_COST)]
        if c.isalpha():
            return [(" ", BREAK_COST)]
        out = [(x, LOOKALIKE_COST) for x in LOOKALIKES.get(c, "")]
        out.append(("", min(again, LOOKALIKE_DROP_COST if out else SEPARATOR_DROP_COST)))
        out.append((" ", BREAK_COST))
        return out

    def decode(self, token: str) -> str:
        """Viterbi over the lattice; the state is the last two symbols. Ties go to the option named first."""
        token = token.lower()
        best: dict[tuple[int, int], tuple[float, tuple]] = {(BOUNDARY, BOUNDARY): (0.0, ())}
        for at in range(len(token)):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for letter, cost in self.options(token, at):
                for (p, q), (before, path) in best.items():
                    if letter == "":
                        state, total, way = (p, q), before + cost, path
                    else:
                        x = _INDEX.get(letter, BOUNDARY)
                        if x == BOUNDARY == q:
                            continue
                        state, total, way = (q, x), before + cost + self.costs[p][q][x], (path, letter)
                    if total < step.get(state, (inf,))[0]:
                        step[state] = (total, way)
            best = step or best
        total, path = min(((b + (self.costs[p][q][BOUNDARY] if q != BOUNDARY else 0.0), i, w) for i, ((p, q), (b, w)) in enumerate(best.items())))[::2]
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)).strip()


def is_plain(token: str) -> bool:
    """Whether a token has only one way through the lattice worth a look: letters, none of them thrice in a row."""
    return token.isalpha() and _THRICE.search(token) is None


def spaced_words(text: str, restore: Restorer) -> list[str]:
    """Words restored from runs of single characters such as ``i d i o t``.

    Where words begin in such a run is unsure, so the eight letters from each place on are given as well.
    """
    out = []
    for m in SPACED.finditer(text):
        words = restore(m.group(0)).split()
        joined = "".join(words)
        out += [*words, *(joined[i : i + 8] for i in range(1, len(joined) - 2))]
    return out


_EDGES = ".,;:\"'?%&*#-–—…<>[]{}()/\\=~^`_"


def read_words(token: str, restore: Restorer) -> list[str]:
    """The words, in lower case and in order, that a white-space-free token is most likely to stand for."""
    if is_plain(token):
        return [token.lower()]
    bare = token.strip(_EDGES).lower()
    if not any(c.isalpha() for c in bare):
        return []
    return [bare] if is_plain(bare) else restore(bare).split()


def restored_words(token: str, restore: Restorer) -> list[str]:
    """The words of a token, and the one that is left if look-alikes at its edges are punctuation."""
    words = read_words(token, restore)
    bare = token.strip(_EDGES).lower()
    if is_plain(token) or is_plain(bare) or not any(c.isalpha() for c in bare):
        return words
    tail = bare.strip("".join(LOOKALIKES))
    if tail != bare and is_plain(tail):
        words.append(tail)  # a look-alike at the edge may as well be punctuation
    return words


def restore_text(text: str, restore: Restorer) -> str:
    """A whole text with its disguised words restored; white space and plain words stay."""
    text = SPACED.sub(lambda m: restore(m.group(0)), text)

    def word(m: re.Match) -> str:
        return m.group(0) if is_plain(m.group(0)) else " ".join(read_words(m.group(0), restore)) or m.group(0)

    return re.sub(r"\S+", word, text)
