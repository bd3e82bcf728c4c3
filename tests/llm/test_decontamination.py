import re

import pytest

from tablewright.llm.decontamination import flag_contamination, merged, remove_contamination
from tablewright.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        w, hit, named = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found is not None:
                    hit |= set(range(i, i + size))
                    named |= {str(x) for x in found if x is not None}
        out.append((len(w), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 3000])
def test_flags_match_brute_force(spark, odd_docs, block_bytes):
    docs = odd_docs.collect()
    items = [(1, docs[8].text[:200]), (2, "One"), (10, "three four"), (3, None), (4, "?!"), (None, docs[9].text[30:300]), (1, docs[8].text[:200]), (5, docs[8].text[:200]), (6, "x" * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = flag_contamination(odd_docs, bench, block_bytes=block_bytes).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == brute([r.text for r in docs], items)
    assert [(r.doc_id, r["hits.x"], r["row"]) for r in got] == [(r.doc_id, r["hits.x"], r["row"]) for r in docs]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op10_decontamination"](spark, SF_DIR).collect()}
    assert any(r.contaminated for r in got.values())
    for doc, (n, hit, named, bad) in zip(docs, brute([d.text for d in docs], items), strict=True):
        r = got[doc.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(named), bad)


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert flag_contamination(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in flag_contamination(odd_docs, bench.where("false")).collect())


def test_removal(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Före, {item}! after é"), (2, "clean"), (3, None), (4, "x " * 1000 + item)], "doc_id long, text string")
    flagged = flag_contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [r.doc_id for r in remove_contamination(flagged).orderBy("doc_id").collect()] == [2, 3, 4]
    spans = {r.doc_id: r.text for r in remove_contamination(flagged, "spans").collect()}
    assert spans == {1: "Före, ! after é", 2: "clean", 3: None, 4: "x " * 1000 + item}
    with pytest.raises(ValueError):
        remove_contamination(flagged, "words")


def test_merged_ranges():
    assert merged([(5, 9), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 9)]
