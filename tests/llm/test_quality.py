import re
from collections import Counter

import numpy as np

from tablewright.llm import quality
from tablewright.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def measures(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_rule_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op6_divergence_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(docs) and any(r.n_repeat_words for r in rows)
    assert all(measures(r) == base(docs[r.doc_id]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(50, "a b c d e f g h " * 9, "x", 1, "k", True), (51, "l1\nl1\n \n\nl1 x\n" * 3, "x", 1, "k", True)], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    measured = quality.measure(docs)
    assert [measures(r) for r in measured.collect()] == [base(r.text) for r in docs.collect()]
    judged = quality.judge(measured, []).collect()
    assert all(r.kept == (not r.base_failed) for r in judged)
    assert quality.judge(quality.measure(no_docs), []).count() == 0


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], (0.1, 0.2, 0.7)
    df = spark.createDataFrame([(p,)], "p array<double>").select(quality.js_distance(quality.column("p"), q).alias("d"), quality.js_distance(quality.column("p"), tuple(p)).alias("zero"))
    got = df.first()
    m = (np.array(p) + q) / 2
    entropy = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
    assert abs(got.d - np.sqrt(entropy(m) - (entropy(p) + entropy(q)) / 2)) < 1e-12 and got.zero < 1e-7


def test_clean_stays_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_divergence_rules"](spark, sf).collect() if r.doc_id in good and not r.base_failed]
    clean = [r.kept for r in rows if good[r.doc_id] == 1]
    junk = [r.kept for r in rows if good[r.doc_id] == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.4
