"""Repeated lines by two Bloom filters and an exact confirmation of what they suspect (operator 12).

Each task keeps two bit arrays over the hashes of its lines: met once, and met twice or more. Arrays of tasks are
merged by bits: what two of them have met once has been met twice. So every line of two documents is in the merged
second array; of the others few are. Only suspected lines are counted by their digests in a shuffle. Documents are read
again with what has been confirmed and are not shuffled, unless that is too much to broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns, map_arrow
from tablewright.llm.words import LOWER, mix, range_hashes, slices, text_bytes
from tablewright.session import stored

LEAST_DOCS = 10
LEAST_CHARS = 1
#: Bits of a filter for each line, and bounds of its size: 8 MB at most. With more lines than that is
#: made for, more lines are suspected and counted; what is confirmed stays the same.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 8, 16, 26
PROBES = 3
#: Confirmed digests beyond so many are joined to the suspected lines instead of broadcast: 16 bytes and an id each.
BROADCAST_LINES = 1_000_000

_CHUNK = 1 << 16  # bytes of a filter that travel in one row
_SALTS = 8
_HELD = 50_000  # keys that a task counts before it hands them on

#: Bytes that are stripped at both ends of a line: blank and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[0x20] = BLANK[0x09:0x0E] = True


class Lines:
    """Lines of the texts of one slice: byte ranges of whole lines and of their keys, and hashes of the keys."""

    def __init__(self, texts: pa.Array, least_chars: int = LEAST_CHARS) -> None:
        self.raw, self.bounds = text_bytes(texts)
        self.data = LOWER[self.raw]
        breaks = np.flatnonzero(self.raw == 0x0A)
        first = np.searchsorted(breaks, self.bounds)
        #: Lines of each text; an empty text has one.
        self.counts = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([breaks, self.bounds[1:]]), kind="stable")
        ink = np.flatnonzero(~BLANK[self.raw])
        a, b = np.searchsorted(ink, self.starts), np.searchsorted(ink, self.ends)
        kept = b > a
        self.key_starts, self.key_ends = self.starts.copy(), self.starts.copy()
        self.key_starts[kept], self.key_ends[kept] = ink[a[kept]], ink[b[kept] - 1] + 1
        chars = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        #: Lines whose key is long enough to count.
        self.keyed = np.flatnonzero(chars[self.key_ends] - chars[self.key_starts] >= max(1, least_chars))
        self.hashes = range_hashes(self.data, self.key_starts[self.keyed], self.key_ends[self.keyed])

    def key(self, line: int) -> bytes:
        return self.data[self.key_starts[line] : self.key_ends[line]].tobytes()

    def suspected(self, twice: np.ndarray) -> np.ndarray:
        """Keyed lines whose hash is in the filter, in order."""
        at = places(self.hashes, len(twice) * 8)
        return self.keyed[((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)]


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter of ``bits`` bits, a power of two; a row for each probe."""
    step = mix(hashes + np.uint64(bits)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)])


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def twice_seen(docs: DataFrame, bits: int, text: str = "text", least_chars: int = LEAST_CHARS) -> np.ndarray:
    """The filter of ``bits`` bits, packed, that holds every key met in two documents or more."""

    def emit(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, at in enumerate(range(0, len(once), _CHUNK)):
            a, b = once[at : at + _CHUNK], twice[at : at + _CHUNK]
            if a.any():
                packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *packed], ["chunk", "once", "twice"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                lines = Lines(batch.column(0).slice(a, b - a), least_chars)
                of_doc = np.stack([lines.text[lines.keyed].astype(np.uint64), lines.hashes])
                order = np.lexsort(of_doc)
                of_doc = of_doc[:, order]
                new = np.ones(of_doc.shape[1], bool)
                new[1:] = (of_doc[:, 1:] != of_doc[:, :-1]).any(0)
                met = of_doc[1, new]  # a key once for each document, equal keys side by side
                again = met[1:][met[1:] == met[:-1]]
                at = places(met, bits).ravel()
                twice[at[once[at]]] = True
                twice[places(again, bits).ravel()] = True
                once[at] = True
        yield from emit(np.packbits(once, bitorder="little"), np.packbits(twice, bitorder="little"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                once, twice = [np.frombuffer(zlib.decompress(x), np.uint8) for x in packed]
                if k in held:
                    before, both = held[k]
                    once, twice = before | once, both | twice | (before & once)
                held[k] = (once, twice)
        for k, (once, twice) in held.items():
            packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *packed], ["chunk", "once", "twice"])

    schema = "chunk int, once binary, twice binary"
    parts = map_arrow(docs.select(column(text).cast("string").alias("text")), sketch, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    some = map_arrow(parts.repartition("chunk", "salt").select("chunk", "once", "twice"), merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(some.repartition("chunk"), merge, schema).select("chunk", "twice").collect():  # bits / 8 / _CHUNK rows
        part = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out[row["chunk"] * _CHUNK : row["chunk"] * _CHUNK + len(part)] = part
    return out


def repeated_lines(docs: DataFrame, twice, doc_id: str, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(digest, n_docs, first_id)`` of the keys found in ``least_docs`` documents or more.

    Suspected keys are counted in each task, once for a document, and their counts are summed by digest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flushed() -> pa.RecordBatch:
            found = [pa.array([digest(k) for k in held], pa.binary()), *[pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1)]]
            held.clear()
            return pa.RecordBatch.from_arrays(found, ["digest", "n", "first_id"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                lines = Lines(batch.column(0).slice(a, b - a), least_chars)
                ids = batch.column(1).slice(a, b - a).to_pylist()
                last, seen = -1, set()
                for line in lines.suspected(twice.value).tolist():
                    doc, key = int(lines.text[line]), lines.key(line)
                    if doc != last:
                        last, seen = doc, set()
                    if key in seen:
                        continue
                    seen.add(key)
                    known = held.get(key)
                    if known is None:
                        held[key] = [1, ids[doc]]
                    else:
                        known[0] += 1
                        if ids[doc] is not None and (known[1] is None or ids[doc] < known[1]):
                            known[1] = ids[doc]
                if len(held) > _HELD:
                    yield flushed()
        yield flushed()

    source = docs.select(column(text).cast("string").alias("text"), column(doc_id).cast("long").alias("id"))
    counted = map_arrow(source, count, "digest binary, n long, first_id long")
    return counted.groupBy("digest").agg(F.sum("n").alias("n_docs"), F.min("first_id").alias("first_id")).where(F.col("n_docs") >= least_docs)


_sets: dict[str, dict[bytes, int | None]] = {}


def _set_of(shared) -> dict[bytes, int | None]:
    """The confirmed digests of a broadcast, built once in each worker process."""
    name, digests, ids = shared.value
    if name not in _sets:
        _sets.clear()
        _sets[name] = dict(zip([digests[i : i + 16] for i in range(0, len(digests), 16)], ids, strict=True))
    return _sets[name]


def _kept(lines: Lines, texts: pa.Array, dropped: list[list[int]]) -> list[pa.Array]:
    """``n_lines``, ``n_dropped`` and ``kept_text`` of each text without its lines ``dropped`` (places within the text)."""
    whole, out = None, []
    for i, places_ in enumerate(dropped):
        if not places_:
            out.append(texts[i].as_py() or "")
            continue
        whole = lines.raw.tobytes() if whole is None else whole
        gone = set(places_)
        a, b = int(lines.first[i]), int(lines.first[i + 1])
        out.append(b"\n".join(whole[lines.starts[k] : lines.ends[k]] for k in range(a, b) if k - a not in gone).decode())
    return [pa.array(lines.counts, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()), pa.array(out, pa.large_string()).cast(pa.string())]


_MADE = "n_lines long, n_dropped long, kept_text string"


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    least_chars: int = LEAST_CHARS,
    keep: str = "none",
    broadcast_lines: int = BROADCAST_LINES,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, the text without lines found in many documents.

    A line's key is the line without blanks and 0x09-0x0D at its ends and with A-Z lower-cased. A key of at least
    ``least_chars`` characters (one or more: blank lines always stay) that ``least_docs`` documents (rows) hold loses all its lines;
    with ``keep="first"`` the document of the smallest ``doc_id``, an integer (null last), keeps its first one. A null or empty text has one empty line and
    an empty kept text. Repeated rows are documents of their own; of several rows with the smallest id each keeps its
    first line. An input column with the name of a new one gives way to it. An empty table gives no rows.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    spark = docs.sparkSession
    lines = docs.select(column(text).cast("string").alias("t")).agg(F.sum(F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1)).first()[0] or 1
    bits = min(max(LEAST_BITS, (BITS_A_LINE * lines - 1).bit_length()), most_bits)
    twice = spark.sparkContext.broadcast(twice_seen(docs, 1 << bits, text, least_chars))
    found = stored(repeated_lines(docs, twice, doc_id, text, least_docs, least_chars))
    plain = docs.select(*[column(c).cast("string").alias(c) if c == text else column(c) for c in docs.columns])
    if found.count() > broadcast_lines:
        return _dropped_by_join(plain, found, twice, doc_id, text, least_chars, keep)

    rows = found.select("digest", "first_id").collect()  # at most broadcast_lines
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, b"".join(r["digest"] for r in rows), [r["first_id"] for r in rows]))

    def drop(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
        known, lines, names = _set_of(shared), Lines(texts, least_chars), ids.to_pylist()
        dropped: list[list[int]] = [[] for _ in names]
        spared: set[tuple[int, bytes]] = set()
        for line in lines.suspected(twice.value).tolist():
            doc, key = int(lines.text[line]), digest(lines.key(line))
            if key in known:
                if keep == "first" and known[key] == names[doc] and (doc, key) not in spared:
                    spared.add((doc, key))
                else:
                    dropped[doc].append(line - int(lines.first[doc]))
        return _kept(lines, texts, dropped)

    return append_columns(plain, [text, doc_id], _MADE, drop)


def _dropped_by_join(docs: DataFrame, found: DataFrame, twice, doc_id: str, text: str, least_chars: int, keep: str) -> DataFrame:
    """The same where there are too many confirmed keys to broadcast: suspected lines meet them in a join by digest."""
    held = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("held"), column(text).alias("text"), column(doc_id).cast("long").alias("id"))
    numbered = stored(held.withColumn("row", F.monotonically_increasing_id()))

    def suspects(texts: pa.Array) -> list[pa.Array]:
        lines = Lines(texts, least_chars)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for line in lines.suspected(twice.value).tolist():
            doc = int(lines.text[line])
            found[doc].append({"place": line - int(lines.first[doc]), "digest": digest(lines.key(line))})
        return [pa.array(found, pa.list_(pa.struct([("place", pa.int64()), ("digest", pa.binary())])))]

    asked = append_columns(numbered.select("text", "row", "id"), ["text"], "suspects array<struct<place:bigint,digest:binary>>", suspects)
    asked = asked.select("row", "id", F.explode("suspects").alias("s")).select("row", "id", "s.place", "s.digest")
    bad = asked.join(found.select("digest", "first_id"), "digest")
    if keep == "first":
        firsts = bad.where(F.col("id").eqNullSafe(F.col("first_id"))).groupBy("row", "digest").agg(F.min("place").alias("place"))
        bad = bad.join(firsts, ["row", "digest", "place"], "left_anti")
    dropped = bad.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("dropped"))  # lines of one document
    joined = numbered.join(dropped, "row", "left").select("text", F.coalesce("dropped", F.array().cast("array<long>")).alias("dropped"), "held")

    def drop(texts: pa.Array, dropped: pa.Array) -> list[pa.Array]:
        return _kept(Lines(texts, least_chars), texts, dropped.to_pylist())

    out = append_columns(joined, ["text", "dropped"], _MADE, drop)
    made = ["n_lines", "n_dropped", "kept_text"]
    return out.select(*[F.col("held").getField(c).alias(c) for c in docs.columns if c.lower() not in made], *made)
