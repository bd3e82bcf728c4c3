"""Importance resampling towards a target distribution, over hashed runs of words (operator 11).

Words are found by one byte table and ``bytes.split``; the hash of a run of words goes on from the hash of the run without
its last word. Each task counts buckets in a ``Counter``; the sums have a fixed number of buckets however large the corpus is. A second
reading gives every document its weight, and only a few numbers of each document are sorted to draw the sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns, map_arrow, others
from tablewright.llm.words import ALNUM, LOWER, slices, text_bytes
from tablewright.operators.rowindex import dense_index
from tablewright.session import stored

BUCKETS = 10_000
LONGEST = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7

#: Lower-cases A-Z and turns every byte that is not part of a word into a blank.
TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def features(raw: bytes, longest: int = LONGEST) -> tuple[int, list[int]]:
    """Number of words of a UTF-8 text, and the crc32 of every run of 1 to ``longest`` words joined by one space."""
    words = raw.translate(TABLE).split()
    runs = list(map(crc32, words))
    found = runs[:]
    for n in range(1, longest):
        runs = list(map(crc32, words[n:], map(crc32, repeat(b" "), runs)))
        found += runs
    return len(words), found


def _texts(texts: pa.Array) -> Iterator[bytes]:
    data, bounds = text_bytes(texts)
    whole = data.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield whole[a:b]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; null and empty texts have none, an empty table gives zeros.

    A task hands on one row for each bucket that it met, so the shuffle grows with tasks, not with texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for raw in _texts(batch.column(0).slice(a, b - a)):
                    total.update([c % buckets for c in features(raw, longest)[1]])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    sums = map_arrow(docs.select(column(text).cast("string").alias("text")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row for each bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target than in the corpus, one added to each count."""
    b = len(corpus)
    whole, wanted = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(float(t + 1) * whole / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a text's features.

    Null, empty and wordless texts have no features and weight 0. Repeated rows are weighed each by itself. An input
    column with the name of a new one gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(texts: pa.Array) -> list[pa.Array]:
        gains = shared.value
        words, sizes, weights = [], [], []
        for raw in _texts(texts):
            n, found = features(raw, longest)
            words.append(n)
            sizes.append(len(found))
            weights.append(int(gains[np.array(found, np.int64) % len(gains)].sum()) // len(found) if found else 0)
        return [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())]

    plain = docs.select(*[column(c).cast("string").alias(c) if c == text else column(c) for c in docs.columns])
    return append_columns(plain, [text], "n_words long, n_features long, weight long", weigh)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that the name of a document decides; a null name draws as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(weighted: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rows of :func:`importance_weights` with ``score`` and ``rank``; ``rank`` is null for those that are not drawn.

    Of the documents with at least ``least_words`` words the ``percent`` per cent with the highest scores are drawn,
    rounded down, and numbered from 1. Ties go to the smaller ``doc_id`` (null last), then to fewer features; rows
    that are equal in all of these share the places left in any order. An empty table gives no rows.
    """
    own = others(weighted, ["score", "rank"])
    held = weighted.select(
        F.struct(*own).alias("held"),
        column(doc_id).alias("doc_id"),
        F.col("n_words").alias("n_words"),
        F.col("n_features").alias("n_features"),
        (F.col("weight") + noise(column(doc_id), seed)).alias("score"),
    )
    held = stored(held)
    drawable = F.col("n_words") >= least_words
    some = held.where(drawable)
    drawn = some.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = dense_index(some, order, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    out = placed.select("held", "score", "rank").unionByName(held.where(~drawable).select("held", "score", F.lit(None).cast("long").alias("rank")))
    names = held.schema["held"].dataType.names
    return out.select(*[F.col("held").getField(c).alias(c) for c in names], "score", "rank")
