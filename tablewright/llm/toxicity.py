"""Toxicity of restored text (operator 1).

Words are restored by the noisy channel of :mod:`deobfuscation`; whole words and their beginnings are the features.
How much more often a feature occurs in toxic texts is counted on labelled rows, in two halves, so that the
logistic model over a document's strongest words learns from words that were rated on other rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns, summed_arrays
from tablewright.llm.deobfuscation import SPACED, Restorer, restore_text, restored_words, spaced_words, train_characters
from tablewright.session import stored

#: Labelled rows that the classifier learns from at most, chosen by the hash of their id.
MAX_LABELLED = 12_000
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature counts if it is in at least so many toxic texts, and beyond chance by so many standard deviations.
LEAST_TEXTS, LEAST_SIGMA = 5, 4.0
KNOWN_WORDS = 300_000
N_SUMMARY = 8
_PLACE = (1 << FEATURE_BITS) - 1


def features(word: str) -> list[str]:
    """A word, marked by its end, and its beginnings."""
    return [f"{word}\n", *(word[:n] for n in PREFIXES if len(word) >= n)]


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & _PLACE


class WordRater(dict):
    """Rating of a white-space-free token: the highest of its restored words; remembered up to a bound."""

    def __init__(self, ratings: dict[str, float], restore: Restorer) -> None:
        super().__init__()
        self.ratings, self.restore = ratings, restore
        self.heads = {f[:3] for f in ratings}

    def rate(self, words: list[str]) -> float:
        return max((self.ratings.get(f, 0.0) for w in words if f"{w}\n"[:3] in self.heads for f in features(w)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[token] = self.rate(restored_words(token, self.restore))
        return found

    def summary(self, text: str | None) -> list[float]:
        """What the model sees of a text: its strongest words, how many are strong, and its length."""
        tokens = (text or "").split()
        rated = np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))
        hidden = [self.rate([w]) for w in spaced_words(text or "", self.restore)] if SPACED.search(text or "") else []
        rated = np.append(rated, hidden)
        rated = rated[rated > 0]
        top = np.sort(np.append(rated, np.zeros(3)))[:-4:-1]
        strong = (rated >= 2).sum()
        n = max(len(tokens), 1)
        return [*top, np.log1p(strong), np.log1p(100 * strong / n), np.log1p(rated.sum()), np.log1p(100 * rated.sum() / n), np.log(n)]


@dataclass
class ToxicityModel:
    """Everything a task needs to score a text."""

    costs: np.ndarray
    ratings: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        x = np.column_stack([(summaries - self.mean) / self.scale, np.ones(len(summaries))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def rate_features(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of features that are in more toxic texts than chance explains, else 0."""
    expected = (toxic + clean) * n_toxic / max(n_toxic + n_clean, 1)
    sigma = (toxic - expected) / np.sqrt(np.maximum(expected, 0.25))
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((toxic >= LEAST_TEXTS) & (sigma >= LEAST_SIGMA) & (odds > 0.5), odds, 0.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the inputs, and weights (the constant last), by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


_restorers: dict[str, Restorer] = {}
_raters: dict[str, WordRater] = {}


def _once(cache: dict, shared, make):
    """An object that each worker process makes once from a broadcast value; ``shared`` is (name, value)."""
    name, value = shared.value
    if name not in cache:
        cache.clear()
        cache[name] = make(value)
    return cache[name]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from the labelled rows where ``learn`` (an expression over the labels) holds.

    The character model counts all documents; words are rated on at most ``max_labelled`` labelled rows, taken in the order of a
    hash of their id. Rows without label or id are left out. With labels of one kind only, or none, every text gets
    that kind's share, or 0.
    """
    sc = docs.sparkSession.sparkContext
    costs = train_characters(docs, text)
    rows = labels.where(learn).select(column(doc_id).alias("doc_id"), column(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "label").limit(max_labelled)  # max_labelled rows of 12 bytes
    known = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    train = stored(known.join(F.broadcast(chosen), "doc_id").select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")))

    restorer = sc.broadcast((uuid.uuid4().hex, costs))
    places = 1 << FEATURE_BITS

    def found(text: str | None) -> set[str]:
        restore = _once(_restorers, restorer, Restorer)
        words = set(chain(*(restored_words(w, restore) for w in set((text or "").split())), spaced_words(text or "", restore)))
        return set(chain.from_iterable(map(features, words)))

    def add(total: np.ndarray, texts: pa.Array, label: pa.Array, half: pa.Array) -> None:
        for t, y, h in zip(texts.to_pylist(), label.to_pylist(), half.to_pylist(), strict=True):
            at = (2 * h + y) * (places + 1)
            total[at + np.array(sorted({place(f) for f in found(t)}), np.int64)] += 1
            total[at + places] += 1  # texts of this half and kind

    # First by hashed places, which fit in an array; then by name, for the few places that stand out.
    counts = summed_arrays(train, 4 * (places + 1), add).reshape(2, 2, places + 1)
    texts_of = counts[:, :, -1]
    choices = ([0, 1], [0], [1])
    outstanding = [np.flatnonzero(rate_features(counts[h, 1, :-1].sum(0), counts[h, 0, :-1].sum(0), texts_of[h, 1].sum(), texts_of[h, 0].sum())) for h in choices]
    wanted = sc.broadcast(frozenset(np.concatenate(outstanding).tolist()))

    def name(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[f for f in sorted(found(t)) if place(f) in wanted.value] for t in texts.to_pylist()], pa.list_(pa.string()))]

    named = append_columns(train, ["text"], "features array<string>", name).select(F.explode("features").alias("feature"), "half", "label")
    seen = named.groupBy("feature", "half", "label").count().collect()  # features of outstanding places
    index = {f: k for k, f in enumerate(sorted({r["feature"] for r in seen}))}
    exact = np.zeros((2, 2, len(index)), np.int64)
    for r in seen:
        exact[r["half"], r["label"], index[r["feature"]]] = r["count"]

    def ratings(halves: list[int]) -> dict[str, float]:
        odds = rate_features(exact[halves, 1].sum(0), exact[halves, 0].sum(0), texts_of[halves, 1].sum(), texts_of[halves, 0].sum())
        return {f: float(odds[k]) for f, k in index.items() if odds[k] > 0}

    by_other = sc.broadcast((uuid.uuid4().hex, [(costs, ratings([1])), (costs, ratings([0]))]))

    def summaries(texts: pa.Array, half: pa.Array) -> list[pa.Array]:
        raters = _once(_raters, by_other, lambda both: [WordRater(r, Restorer(c)) for c, r in both])
        return [pa.array([raters[h].summary(t) for t, h in zip(texts.to_pylist(), half.to_pylist(), strict=True)], pa.list_(pa.float64()))]

    seen = append_columns(train, ["text", "half"], "summary array<double>", summaries).select("summary", "label").toPandas()
    y = seen["label"].to_numpy(np.float64)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        constant = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return ToxicityModel(costs, {}, np.zeros(N_SUMMARY), np.ones(N_SUMMARY), np.append(np.zeros(N_SUMMARY), constant))
    mean, scale, weights = fit_logistic(np.stack(seen["summary"].to_numpy()), y)
    return ToxicityModel(costs, ratings([0, 1]), mean, scale, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", restored: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, the probability of a toxic label) and ``predicted`` (1 from 0.5 on).

    With ``restored`` the text after restoration is added as ``restored_text``. Null and empty texts have no words and get
    the score of such texts. An input column with the name of a new one gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    schema = "score double, predicted int" + ", restored_text string" * restored

    def score(texts: pa.Array) -> list[pa.Array]:
        rater = _once(_raters, shared, lambda m: WordRater(m.ratings, Restorer(m.costs)))
        rows = texts.to_pylist()
        found = model_scores(np.array([rater.summary(t) for t in rows]))
        out = [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
        if restored:
            out.append(pa.array([None if t is None else restore_text(t, rater.restore) for t in rows], pa.string()))
        return out

    model_scores = model.scores
    return append_columns(docs, [text], schema, score)


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
