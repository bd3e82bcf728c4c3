"""Quality classification from positive and unlabelled texts (operator 7).

Trusted positives are labelled texts of good quality; everything else is unlabelled web text, a mixture whose share of
good texts, the class prior, is estimated. A small network minimises the non-negative unbiased risk (Kiryo et
al. 2017).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns
from tablewright.llm.words import LOWER, Words, mix
from tablewright.session import stored

#: Positives, and unlabelled texts, that the network is fitted on at most, chosen by the hash of their id.
MAX_POSITIVES, MAX_UNLABELLED = 20_000, 30_000
HIDDEN, ROUNDS, BATCH, RATE = 16, 60, 512, 0.01

_KINDS = np.zeros(256, np.uint8)  # other
_KINDS[0x61:0x7B] = 1  # lower case
_KINDS[0x41:0x5B] = 2  # upper case
_KINDS[0x30:0x3A] = 3  # digits
_KINDS[[0x20, 0x09, 0x0D, 0x0B, 0x0C]] = 4
_KINDS[0x0A] = 5
_KINDS[[ord(c) for c in ".,;:"]] = 6
_KINDS[[ord(c) for c in "!?"]] = 7
_KINDS[[ord(c) for c in "#*$%&|<>=+@^~\\{}[]/_"]] = 8
_KINDS[0x80:0xC0] = 9  # inside a character
_KINDS[0xC0:] = 10  # a character beyond ASCII begins
_N_KINDS = 11
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
N_FEATURES = 20


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of measures for each text: shares of characters, lengths, and how much repeats. Empty texts have zeros."""
    w = Words(texts, _NOT_SPACE, None)
    n = w.n_texts
    kinds = _KINDS[w.data]
    text_of_byte = np.repeat(np.arange(n), np.diff(w.bounds))
    count = np.bincount(text_of_byte * _N_KINDS + kinds, minlength=n * _N_KINDS).reshape(n, _N_KINDS).astype(np.float64)
    chars = np.maximum(count.sum(1) - count[:, 9], 1)
    words = np.maximum(w.counts, 1).astype(np.float64)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[w.first[1:]] - sums[w.first[:-1]]

    def distinct(hashes: np.ndarray, of: np.ndarray, total: np.ndarray) -> np.ndarray:
        key = np.unique(mix(hashes + np.uint64(1) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(hashes) else hashes, return_index=True)[1]
        return np.bincount(of[key], minlength=n) / np.maximum(total, 1)

    length = (w.ends - w.starts).astype(np.float64)
    folded = Words(texts, _NOT_SPACE, LOWER).hashes()
    first, last = kinds[w.starts], kinds[w.ends - 1]
    pairs, at2 = w.windows(folded, 2)
    eights, at8 = w.windows(folded, 8)
    lines = Words(texts, np.arange(256) != 0x0A, None)
    line_hash = lines.hashes()
    short = per_text(length <= 3)
    return np.column_stack([
        count[:, 1] / chars,
        count[:, 2] / chars,
        count[:, 3] / chars,
        count[:, 4] / chars,
        count[:, 5] / chars,
        count[:, 6] / chars,
        count[:, 7] / chars,
        count[:, 8] / chars,
        count[:, 10] / chars,
        per_text(length) / words / 10,
        np.sqrt(np.maximum(per_text(length**2) / words - (per_text(length) / words) ** 2, 0)) / 10,
        short / words,
        per_text((first == 2) & (last == 2)) / words,
        per_text(last == 8) / words,
        per_text(last == 7) / words,
        per_text((first == 8) | (length == 1)) / words,
        distinct(folded, w.text, w.counts) ** 2,
        distinct(pairs, w.text[at2], np.maximum(w.counts - 1, 1)),
        np.where(w.counts >= 8, distinct(eights, w.text[at8], np.maximum(w.counts - 7, 1)), 1.0),
        distinct(line_hash, lines.text, lines.counts) * np.minimum(np.log1p(words) / 8, 1),
    ]) * (w.counts > 0)[:, None]


@dataclass
class Network:
    """One hidden layer of tanh units over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self(x), -30, 30)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, weigh, rounds: int, seed: int) -> Network:
    """Fits a network by Adam; ``weigh(g_p, g_u)`` gives the slopes of the risk at the outputs of a batch."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), np.maximum(both.std(0), 1e-6), rng.normal(0, 0.4, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    p, u = [np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled)]
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    step = 0
    steps = max(1, -(-len(u) // BATCH))
    for _ in range(rounds):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(steps):
            x_u = u[order_u[k * BATCH : (k + 1) * BATCH]]
            x_p = p[order_p[np.arange(k * BATCH, (k + 1) * BATCH) % len(p)]]
            x = np.concatenate([x_p, x_u])
            h = np.tanh(x @ values[0] + values[1])
            g = h @ values[2] + values[3]
            slope = weigh(g[: len(x_p)], g[len(x_p) :])
            back = slope[:, None] * values[2] * (1 - h**2)
            slopes = [x.T @ back + 1e-4 * values[0], back.sum(0), h.T @ slope + 1e-4 * values[2], np.array([slope.sum()])]
            step += 1
            for v, d, m in zip(values, slopes, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.999 * m[1] + 0.001 * d**2
                v -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Share of positives among the unlabelled texts.

    For any set A of texts the unlabelled share in A is at least prior times the positive share in A, so their
    ratio bounds the prior from above, tightly where negatives are rare. A plain classifier of positive against unlabelled,
    fitted on one half, orders the other half; the least ratio over its upper sets that hold a fifth of the positives or more is taken, plus one standard
    error so that chance does not choose.
    """
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    found = []
    for (fit_p, fit_u), (p, u) in (halves, halves[::-1]):
        net = _train(fit_p, fit_u, lambda a, b: np.concatenate([(_sigmoid(a) - 1) / len(a), _sigmoid(b) / len(b)]), ROUNDS // 3, seed)
        g_p, g_u = np.sort(net(p)), np.sort(net(u))
        cuts = np.quantile(g_p, np.linspace(0, 0.8, 161))
        in_p = 1 - np.searchsorted(g_p, cuts) / len(g_p)
        in_u = 1 - np.searchsorted(g_u, cuts) / len(g_u)
        error = np.sqrt(in_p * (1 - in_p) / len(g_p) + in_u * (1 - in_u) / len(g_u)) / np.maximum(in_p, 1e-9)
        found.append(np.min((in_u / np.maximum(in_p, 1e-9) + error)[in_p >= 0.2], initial=1.0))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Minimises prior R_p(+) + max(0, R_u(-) - prior R_p(-)) with the logistic loss.

    Where the second part is negative, its own slope is followed backwards, as its authors advise.
    """

    def weigh(g_p: np.ndarray, g_u: np.ndarray) -> np.ndarray:
        up, uu = _sigmoid(g_p), _sigmoid(g_u)
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        rest = np.concatenate([-prior * up / len(g_p), uu / len(g_u)])
        if negative < 0:
            return -rest
        return np.concatenate([prior * (up - 1) / len(g_p), np.zeros(len(g_u))]) + rest

    net = _train(positive, unlabelled, weigh, ROUNDS, seed)
    net.prior = prior
    return net


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Network | None:
    """Fits on positives (labelled 1 where ``learn`` holds) against texts of the table taken without looking at labels.

    Both are bounded samples in the order of a hash of the id; negative labels are never used. Without positives, or without
    texts, there is no model.
    """
    positives = labels.where(learn & (column(label) == 1)).select(column(doc_id).alias("doc_id")).where("doc_id is not null").distinct()
    chosen = positives.orderBy(F.xxhash64("doc_id")).limit(max_positives)  # ids alone
    known = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    unlabelled = known.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_unlabelled).distinct()
    wanted = stored(chosen.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False))))
    rows = known.join(F.broadcast(wanted), "doc_id").select("text", "positive")
    seen = append_columns(rows, ["text"], "x array<double>", lambda t: [_rows(text_features(t))]).select("x", "positive").toPandas()
    x = np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, N_FEATURES))
    positive, unlabelled_x = x[seen["positive"].to_numpy(bool)], x[~seen["positive"].to_numpy(bool)]
    order = [np.lexsort(a.T) for a in (positive, unlabelled_x)]  # the same whatever order rows arrive in
    positive, unlabelled_x = [a[o][np.random.default_rng(1).permutation(len(a))] for a, o in zip((positive, unlabelled_x), order, strict=True)]
    if len(positive) < 4 or len(unlabelled_x) < 4:
        return None
    return fit_non_negative(positive, unlabelled_x, estimate_prior(positive, unlabelled_x))


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def score_quality(docs: DataFrame, model: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good quality likelier) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have all measures zero and the score of such texts; without a model every score is 0.5. An input column with the name of
    a new one gives way to it.
    """
    if model is None:
        return docs.select(*[column(c) for c in docs.columns if c.lower() not in ("score", "predicted")], F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def score(texts: pa.Array) -> list[pa.Array]:
        found = shared.value[1].scores(text_features(texts))
        return [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]

    return append_columns(docs, [text], "score double, predicted int", score)
