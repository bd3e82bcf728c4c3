import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing
from tablewright.llm.packing import ChunkTokenizer, hilbert_key, pack_documents
from tablewright.llm.queries import PACKING_VOCABULARY, QUERIES
from tests.conftest import SF_DIR

TOKENIZER = Tokenizer.from_file(PACKING_VOCABULARY)


def expected(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, length):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, row in by_sequence.items():
        at = 0
        for p in sorted(row, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or k == len(by_sequence) - 1
    wanted = defaultdict(list)
    for doc_id, text in docs:
        wanted[doc_id].append(expected(text))
    assert set(by_doc) == set(wanted)
    for doc_id, own in by_doc.items():
        if len(wanted[doc_id]) == 1:
            ids, at = wanted[doc_id][0], 0
            for p in sorted(own, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in own) == sum(map(len, wanted[doc_id]))


@pytest.mark.parametrize("length", [64, 2048])
def test_odd_rows(odd_docs, length):
    check(pack_documents(odd_docs, PACKING_VOCABULARY, length=length).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], length)


def test_query_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op8_curve_packing"](spark, SF_DIR).collect(), docs, 2048)


def test_empty_table(no_docs):
    assert pack_documents(no_docs, PACKING_VOCABULARY).count() == 0


def test_curve_visits_each_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_share_words(spark):
    texts = [("red green blue " if i % 2 else "north south west ") * 40 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [r.doc_id % 2 for r in pack_documents(docs, PACKING_VOCABULARY).orderBy("sequence_id", "offset").collect() if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_chunks_have_the_ids_of_whole_texts():
    """Every Latin letter alone, in words and beside signs, marks, digits and white space of all kinds."""
    letters = [chr(i) for i in range(0x250)]
    pool = [*letters, *"abcABC İıſßŁ.,;!?%'s 't\n\t<|>", "́", "中", "ﬁ", "Ⅷ", "٣"]
    draw = random.Random(8)
    texts = ["".join(draw.choices(pool, k=draw.randint(0, 30))) for _ in range(3000)] + [f"a{x}b" for x in letters]
    texts += ["<|endoftext|> x<|startoftext|>y", "it's. He'll", "", " \n ", "aI" * 5000]
    tokenizer = ChunkTokenizer(PACKING_VOCABULARY)
    assert tokenizer.parts
    for _ in range(2):  # the second time from memory
        got = tokenizer(pa.array([*texts, None])).to_pylist()
        assert got == [tokenizer._whole(t) for t in texts] + [b""]
    assert tokenizer(pa.array([], pa.string())).to_pylist() == []
    assert tokenizer(pa.array([None], pa.string())).to_pylist() == [b""]


def test_ids_are_written_once(spark, monkeypatch):
    """Only the keys and sizes of documents are sorted; their ids are written once and take their places from there."""
    written = []

    def kept(df):
        written.append(df.columns)
        return keep(df)

    keep = packing.stored
    monkeypatch.setattr(packing, "stored", kept)
    docs = [(i % 50, f"word{i} " * (i % 70)) for i in range(300)]
    pieces = pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), PACKING_VOCABULARY, length=64).collect()
    check(pieces, docs, 64)
    assert len(written) == 2 and sum("ids" in columns for columns in written) == 1


def test_memory_of_chunks_is_bounded(monkeypatch):
    """Over many more chunks than it may remember, a tokenizer keeps frequent ones, and each word once however it is written."""
    words = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstvwxyz"]
    one = ChunkTokenizer(PACKING_VOCABULARY)
    for text in (" ".join(words), " ".join(f"{w.capitalize()}," for w in words), " ".join(f"{w.upper()}." for w in words)):
        assert one(pa.array([text])).to_pylist() == [one._whole(text)]
    assert len(one.known) < len(words) + 10
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 100)
    two = ChunkTokenizer(PACKING_VOCABULARY)
    for k in range(0, len(words), 20):
        text = " ".join(["frequent", *words[k : k + 20]])
        assert two(pa.array([text])).to_pylist() == [two._whole(text)]
        assert "frequent" in two.known or "frequent" in two.older
        assert len(two.known) + len(two.older) <= 2 * (100 + 30)


def test_accented_words_are_remembered_once():
    """However a word with accents is written and whatever signs follow it, a tokenizer asks the model for it once."""
    words = [f"{a}{b}{c}" for a in "àçéñöšž" for b in ("", "r", "ß", "øt") for c in ("e", "ié", "ůl", "aŵ")]
    one = ChunkTokenizer(PACKING_VOCABULARY)
    for text in (" ".join(words), " ".join(f"{w[0].upper()}{w[1:]}," for w in words), " ".join(f"{w[:-1]}{w[-1].upper()}.!" for w in words)):
        assert one(pa.array([text])).to_pylist() == [one._whole(text)]
    assert len(one.known) < len(words) + 10
    mixed = ["Éa1é", "é-É,", "Ⱥb.", "ⱥb", "İe,", "éÉ", "ÉÉ'ÉÉ!", "É.É.", ".É", "中É,"]
    assert one(pa.array(mixed)).to_pylist() == [one._whole(t) for t in mixed]
