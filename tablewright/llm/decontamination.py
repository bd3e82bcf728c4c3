"""Benchmark decontamination by n-grams (operator 10).

The normalised windows of the benchmark texts are a table of their own. It is broadcast as a hash set;
beyond ``BLOCK_BYTES`` it is cut into blocks, and the documents pass one block after the other, so the set in
memory is bounded however large the benchmark is. Documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns
from tablewright.llm.words import Words
from tablewright.session import cut

WINDOW = 13
#: Share of a document's words that must be hit for it to count as contaminated: 1 in 20.
SHARE = (1, 20)
#: Bytes of windows and item names in one broadcast set.
BLOCK_BYTES = 32 << 20

_HITS = "array<struct<start:int,end:int>>"
_FILTER_BITS = 20


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct rows ``(n, key, item)``: each window of ``window`` words of each item.

    An item of fewer words, but not none, is one window of all its words. ``key`` has the words with a space
    between them. Items without a name keep their windows; ``item`` is null there.
    """

    def windows(texts: pa.Array, items: pa.Array) -> list[pa.Array]:
        w = Words(texts)
        made = []
        for i, count in enumerate(w.counts):
            n = min(window, int(count))
            made.append([{"n": n, "key": w.joined(k, n).decode()} for k in range(w.first[i], w.first[i + 1] - n + 1)] if n else [])
        return [pa.array(made, pa.list_(pa.struct([("n", pa.int32()), ("key", pa.string())])))]

    source = benchmark.select(column(text).cast("string").alias("text"), column(item).cast("string").alias("item"))
    rows = append_columns(source, ["text", "item"], "found array<struct<n:int,key:string>>", windows)
    return rows.select(F.explode("found").alias("w"), "item").select("w.n", "w.key", "item").distinct()


class WindowSet:
    """Windows of one block, found by hash and confirmed by their words."""

    def __init__(self, rows: list[tuple[int, str, str | None]]) -> None:
        by_length: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        for n, key, item in rows:
            named = by_length[n].setdefault(key.encode(), [])
            if item is not None:
                named.append(item)
        self.lengths = []
        for n, items in sorted(by_length.items()):
            keys = list(items)
            w = Words(pa.array([k.decode() for k in keys], pa.large_string()))
            hashes, _ = w.windows(w.hashes(), n)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.lengths.append((n, items, seen, np.sort(hashes)))

    def find(self, w: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: the ranges of words that occurrences cover, and the items they belong to."""
        found: dict[int, tuple[list, set]] = {}
        hashes = w.hashes()
        for n, items, seen, known in self.lengths:
            of, at = w.windows(hashes, n)
            maybe = np.flatnonzero(seen[of & np.uint64((1 << _FILTER_BITS) - 1)])
            maybe = maybe[known[np.minimum(np.searchsorted(known, of[maybe]), len(known) - 1)] == of[maybe]]
            for k in at[maybe].tolist():
                named = items.get(w.joined(k, n))
                if named is not None:
                    i = int(w.text[k])
                    ranges, names = found.setdefault(i, ([], set()))
                    start = k - int(w.first[i])
                    if ranges and ranges[-1][0] <= start <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + n))
                    else:
                        ranges.append((start, start + n))
                    names.update(named)
        return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_sets: dict[str, WindowSet] = {}


def _set_of(block) -> WindowSet:
    """The set of a broadcast block, built once in each worker process."""
    key = block.value[0]
    if key not in _sets:
        _sets.clear()
        _sets[key] = WindowSet(block.value[1])
    return _sets[key]


def flag_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: tuple[int, int] = SHARE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items``, ``hits`` and ``contaminated``.

    A word of a document is hit if it lies inside any occurrence of a benchmark window. ``items`` has the
    names of the items with occurring windows, sorted as text; ``hits`` has the merged ranges of hit words.
    ``contaminated``: some word is hit, and at least ``share`` of all words. A null or empty text has no words;
    an empty benchmark hits nothing; repeated documents and items count each by itself. An input column with
    the name of a new one gives way to it.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, item_text, window)
    size = F.length("key") * 4 + F.coalesce(F.length("item"), F.lit(0)) * 4 + 64
    windows = cut(windows.withColumn("size", size.cast("long")))
    total = windows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    of_block = F.pmod(F.xxhash64("key", "item"), F.lit(blocks))

    out = docs
    for k in range(blocks):
        rows = [tuple(r) for r in windows.where(of_block == k).select("n", "key", "item").collect()]
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        first, last = k == 0, k == blocks - 1

        def scan(texts: pa.Array, hits: pa.Array | None = None, items: pa.Array | None = None, block=block, first=first, last=last) -> list[pa.Array]:
            w = Words(texts)
            found = _set_of(block).find(w)
            ranges = [[] for _ in range(w.n_texts)] if first else [[(h["start"], h["end"]) for h in row] for row in hits.to_pylist()]
            names = [[] for _ in range(w.n_texts)] if first else items.to_pylist()
            for i, (more, named) in found.items():
                ranges[i] = merged(ranges[i] + more)
                names[i] = sorted({*names[i], *named})
            covered = [sum(b - a for a, b in r) for r in ranges]
            return [
                pa.array(w.counts.astype(np.int64)),
                pa.array(covered, pa.int64()),
                pa.array(names, pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([c > 0 and share[1] * c >= share[0] * n for c, n in zip(covered, w.counts.tolist(), strict=True)], pa.bool_()),
            ]

        if first:
            out = append_columns(out, [text], f"n_words long, n_hit long, items array<string>, hits {_HITS}, contaminated boolean", scan)
        else:
            out = _again(out, text, scan)
    return out


def _again(flagged: DataFrame, text: str, scan) -> DataFrame:
    """One more block for documents that earlier blocks have flagged."""
    made = ["n_words", "n_hit", "items", "hits", "contaminated"]
    own = [c for c in flagged.columns if c not in made]
    held = flagged.select(*[column(c) for c in own], F.col("hits").alias("_hits_before"), F.col("items").alias("_items_before"))
    out = append_columns(held, [text, "_hits_before", "_items_before"], f"n_words long, n_hit long, items array<string>, hits {_HITS}, contaminated boolean", scan)
    return out.drop("_hits_before", "_items_before")


def remove_contamination(flagged: DataFrame, by: str = "documents", text: str = "text") -> DataFrame:
    """Flagged documents without what is contaminated.

    ``by="documents"`` drops contaminated documents; ``by="spans"`` keeps every document and cuts each hit range, from
    its first to its last word, out of the texts of contaminated ones (a null text stays null).
    """
    if by == "documents":
        return flagged.where(~F.col("contaminated"))
    if by != "spans":
        raise ValueError(f"by must be documents or spans, not {by!r}")

    def strip(texts: pa.Array, hits: pa.Array, contaminated: pa.Array) -> list[pa.Array]:
        w = Words(texts)
        out = texts.to_pylist()
        for i, (ranges, bad) in enumerate(zip(hits.to_pylist(), contaminated.to_pylist(), strict=True)):
            if bad and out[i] is not None:
                raw, base, first = out[i].encode(), int(w.bounds[i]), int(w.first[i])
                for h in reversed(ranges):
                    raw = raw[: w.starts[first + h["start"]] - base] + raw[w.ends[first + h["end"] - 1] - base :]
                out[i] = raw.decode()
        return [pa.array(out, pa.string())]

    columns = flagged.columns
    return append_columns(flagged, [text, "hits", "contaminated"], f"{text} string", strip).select(*[column(c) for c in columns])
