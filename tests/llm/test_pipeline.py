import random

import numpy as np

import corpus_pipeline
from tablewright.llm import neardup, queries
from tablewright.llm.decontamination import flag_contamination
from tests.conftest import SF_DIR
from tests.llm.test_neardup import brute, partition


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert names == ["toxicity", "quality rules", "MinHash near-dedup", "benchmark decontamination", "packing"]

    toxic = {r.doc_id for r in queries.op1_toxicity(spark, SF_DIR).where("predicted = 1").collect()}
    one = stages[names[0]](spark, docs, SF_DIR)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - toxic

    two = stages[names[1]](spark, docs, SF_DIR)
    kept = {r.doc_id for r in queries.op6_divergence_rules(spark, SF_DIR).where("kept").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept

    three = stages[names[2]](spark, docs, SF_DIR)
    kept = {r.doc_id for r in queries.op3_near_duplicates(spark, SF_DIR).where("kept").collect()}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept

    four = stages[names[3]](spark, docs, SF_DIR)
    clean = flag_contamination(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).where("not contaminated")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in clean.collect()}


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert pieces and {r.doc_id for r in pieces} < {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_one_of_each_class_stays_where_leaders_miss_links(spark, monkeypatch):
    """Pairs of copies in one bucket with many others: every pair is found, though only a few have a leader in it."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]

    def changed(text, places):
        copy = list(text)
        for k in rng.sample(range(len(copy) // 10), places):
            copy[10 * k + rng.randrange(5)] = rng.choice(words)
        return copy

    base = [rng.choice(words) for _ in range(150)]
    firsts = [changed(base, 5) for _ in range(60)]
    texts = [" ".join(t) for first in firsts for t in (first, changed(first, 1))]
    labels, close = brute(texts)
    assert not close
    bands = neardup.BANDS
    monkeypatch.setattr(neardup, "band_hashes", lambda sample: np.ones((len(sample), bands), np.int64))  # all in one bucket
    monkeypatch.setattr(neardup, "BLOCK", 60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()]
    assert sorted(kept) == sorted(min(group) for group in partition(labels))
