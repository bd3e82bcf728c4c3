"""Packing along a space-filling curve (operator 8).

Each document is tokenised once; its hashed word vector is projected to a few dimensions and the place of
that point on a Hilbert curve is its key. Documents are range-sorted by key (with a unique number behind it, so equal
documents spread over partitions), and the token stream along the curve is cut every ``LENGTH`` tokens.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns, map_arrow
from tablewright.llm.words import Words
from tablewright.session import stored

LENGTH = 2048
DIMS = 4
BITS = 12
END_ID = 1
#: Chunks of each of the two generations that a worker remembers, about 120 bytes each; the slice that is being read adds its own.
CACHE_CHUNKS = 150_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension.

    Skilling's transform (2004): undo the rotations from the highest bit down, then Gray-encode and
    interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(w: Words, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each text: the mean of its words' hashed vectors, on a grid.

    A word's coordinates are bytes of its hash. Their mean over n words has a spread of 1 / sqrt(n); it is scaled
    by the fourth root of n, so that short texts don't fill the edges and long ones don't meet in the middle.
    A text without words has the middle of the grid.
    """
    hashes = w.hashes()
    n = np.maximum(w.counts, 1)
    points = np.empty((w.n_texts, dims))
    for d in range(dims):
        value = ((hashes >> np.uint64(8 * d)) & np.uint64(255)).astype(np.float64) / 255 - 0.5
        sums = np.zeros(len(value) + 1)
        np.cumsum(value, out=sums[1:])
        points[:, d] = (sums[w.first[1:]] - sums[w.first[:-1]]) / n * np.sqrt(np.sqrt(n))
    grid = np.clip((points + 0.5) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_key(grid.astype(np.int64), bits)


# The normaliser and the pre-tokenizer of the kind of tokenizer whose texts can be taken apart, as its file states them.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# Latin letters, of which all Unicode versions say the same. The capital I with a dot (U+0130) is left out: in lower
# case it is a letter and a mark, which is no letter.
_LATIN = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_WORD = re.compile(f"[{_LATIN}]+")
_LETTERS = "".join(_WORD.findall("".join(map(chr, range(0x250)))))
_SIGNS = ".,;:!?%&*#$"

#: The characters that a byte-level model has for the bytes: printable ones stand for themselves, others follow from 256 on. The blank
#: stays, between words that are told apart by it.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_BYTE_CHARACTERS = "".join(chr(_OTHER_BYTES.get(b, b)) if b != 0x20 else " " for b in range(256))


class ChunkTokenizer:
    """Ids of whole texts by a lower-casing byte-level tokenizer that parts at white space, and letters from signs.

    The rules that its file states say whether it is of that kind. Then a text has the ids of its chunks between blanks and line ends, one
    after the other, and a word of Latin letters is one piece to the model, which is asked for it directly. Chunks are
    remembered; the memory is bounded and only saves time: once it is full it becomes the older generation, which
    hands on the chunks that are met again, so frequent ones stay and rare ones go. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        self.parts = (
            (rules["normalizer"] or {}).get("normalizers") == _NORMALISERS
            and (rules["pre_tokenizer"] or {}).get("pretokenizers") == [_SPLIT, _BYTE_LEVEL]
            and rules["truncation"] is None
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["content"].isalpha() for t in rules["added_tokens"])
        )

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Remembers the ids of chunks: words in lower case are pieces to the model, other chunks stay whole."""
        known, tokenize, kind = self.known, self.tokenizer.model.tokenize, array("H" if self.dtype == "<u2" else "I")
        words, other = [], []
        for chunk in chunks:
            (words if _WORD.fullmatch(chunk) else other).append(chunk)
        letters = " ".join(words).encode().decode("latin-1").translate(_BYTE_CHARACTERS).split(" ") if words else []
        for word, piece in zip(words, letters, strict=True):
            known[word] = _packed(kind, [t.id for t in tokenize(piece)])
        for chunk, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[chunk] = _packed(kind, e.ids)

    def _remembered(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk, equal ones looked up once; those of the older generation come into the present one."""
        places = pc.dictionary_encode(chunks)
        different = places.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes several times as long
        found = list(map(self.known.get, different))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in missing:
            ids = self.older.get(different[i])
            if ids is None:
                unknown.append(different[i])
            else:
                self.known[different[i]] = ids
        self._learn(unknown)
        for i in missing:
            found[i] = self.known[different[i]]
        return pa.array(found, pa.large_binary()).take(places.indices)

    def _ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk. Words of Latin letters are remembered in lower case and without the signs behind them."""
        words, signs = pc.ascii_rtrim(chunks, _SIGNS), pc.utf8_ltrim(chunks, _LETTERS)
        apart = pc.equal(pc.add(pc.binary_length(words), pc.binary_length(signs)), pc.binary_length(chunks))
        words, signs = pc.if_else(apart, pc.utf8_lower(words), chunks), pc.if_else(apart, signs, "")
        return pc.binary_join_element_wise(self._remembered(words), self._remembered(signs), pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (a null text has none) as little-endian numbers of ``dtype``.

        Each different chunk is looked up once in a call, and its ids are then taken to all its places.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.parts:
            return pa.array([self._whole(t) for t in texts.to_pylist()], pa.large_binary())
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {}
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        places = pc.dictionary_encode(rows.flatten())
        taken = self._ids(places.dictionary).take(places.indices)
        # The bytes now stand in the order of the texts: only the bounds between texts are wanted, not those between chunks.
        per_row = np.append(0, np.cumsum(pc.list_value_length(rows).to_numpy()))
        bounds = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][per_row] if len(taken) else np.zeros(len(texts) + 1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), taken.buffers()[2]])


def _packed(kind: array, ids: list[int]) -> bytes:
    """Numbers as the little-endian bytes of an array of that kind."""
    made = array(kind.typecode, ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str) -> ChunkTokenizer:
    """The tokenizer of a file, loaded once in each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents, packed into sequences of ``length`` tokens: one row per piece.

    ``doc_id``; ``start``: ids of the document before the piece; ``length``; ``ids``: the piece as little-endian
    unsigned 32-bit numbers; ``ids_crc32``; ``doc_tokens``: ids of the document, its end id included; ``sequence_id``
    and ``offset`` in it, gapless from 0. Sequences follow the curve, and only the last one may be short; it is the
    only one that needs padding. A null text counts as empty and has the end id alone. Rows with one doc_id are documents of
    their own; a null doc_id stays null. An empty table has no pieces. ``vocabulary`` is a ``tokenizers`` file that every executor can read.
    """

    def encode(texts: pa.Array) -> list[pa.Array]:
        keys = curve_keys(Words(texts))
        tokenizer = tokenizer_of(vocabulary)
        ids, width = tokenizer(texts), np.dtype(tokenizer.dtype).itemsize
        tokens = pc.binary_length(ids).to_numpy() // width + 1
        return [pa.array(keys), pa.array(tokens, pa.int64()), ids.cast(pa.binary()), pa.array(np.full(len(ids), width, np.int32))]

    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    coded = append_columns(source, ["text"], "key long, doc_tokens long, ids binary, width int", encode).drop("text")
    coded = stored(coded.withColumn("number", F.monotonically_increasing_id()))

    # Sorted once by (key, number), which is unique; each task counts the tokens before each of its documents. Only numbers are sorted: the
    # ids stay where they are written, and go to their places in the stream in one shuffle.
    ordered = coded.select("key", "number", "doc_tokens").repartitionByRange("key", "number").sortWithinPartitions("key", "number").withColumn("part", F.spark_partition_id())
    placed = stored(_running(ordered))
    sizes = placed.groupBy("part").agg(F.sum("doc_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    places = placed.join(F.broadcast(offsets), "part").select("number", (F.col("before") + F.col("earlier")).alias("stream"))
    streams = coded.select("number", "doc_id", "doc_tokens", "ids", "width").join(places, "number")
    return _cut(streams, length, end_id)


def _running(ordered: DataFrame) -> DataFrame:
    """Adds ``earlier``: the tokens of the documents before this one in its partition."""
    at = ordered.columns.index("doc_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(at).to_numpy()
            earlier = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(earlier)], [*batch.schema.names, "earlier"])

    return map_arrow(ordered, run, StructType([*ordered.schema.fields, StructField("earlier", LongType())]))


def _cut(placed: DataFrame, length: int, end_id: int) -> DataFrame:
    """Pieces of documents whose place in the stream is known."""

    def cut(ids: pa.Array, widths: pa.Array, streams: pa.Array) -> list[pa.Array]:
        rows = []
        for raw, width, stream in zip(ids.to_pylist(), widths.to_pylist(), streams.to_pylist(), strict=True):
            whole = np.append(np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4"), np.uint32(end_id)).astype("<u4")
            pieces, start = [], 0
            while start < len(whole):
                offset = (stream + start) % length
                piece = whole[start : start + length - offset]
                data = piece.tobytes()
                pieces.append({"start": start, "length": len(piece), "ids": data, "ids_crc32": zlib.crc32(data), "sequence_id": (stream + start) // length, "offset": offset})
                start += len(piece)
            rows.append(pieces)
        fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        return [pa.array(rows, pa.list_(pa.struct(fields)))]

    schema = "pieces array<struct<start:long,length:long,ids:binary,ids_crc32:long,sequence_id:long,offset:long>>"
    made = append_columns(placed.select("doc_id", "doc_tokens", "ids", "width", "stream"), ["ids", "width", "stream"], schema, cut)
    return made.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "p.start", "p.length", "p.ids", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")
