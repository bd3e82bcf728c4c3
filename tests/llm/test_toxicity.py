import numpy as np

from tablewright.llm import deobfuscation, toxicity
from tablewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p for p, y in held if y == 0) <= 1


def test_disguised_words_are_restored_and_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out(5, 0))
    restore = deobfuscation.Restorer(model.costs)
    assert restore("i.d.i.o.t") == "idiot"
    assert "trash" in deobfuscation.restored_words("tr@sh!!", restore)
    assert "idiot" in deobfuscation.spaced_words("the i d i o t is", restore)
    # a token may stand for several words: none of them is lost in the restored text
    several = deobfuscation.Restorer(model.costs)
    several.known = {"idi0t,f00l": "idiot fool", "m0ron/1diot": "moron idiot"}
    assert deobfuscation.restore_text("An  idi0t,f00l, m0ron/1diot.", several) == "An  idiot fool moron idiot"
    assert deobfuscation.restored_words("plain", restore) == ["plain"]
    assert deobfuscation.restored_words("12345", restore) == []
    base = "the and of to in that is for it with " * 6
    odd = spark.createDataFrame([(1, base), (2, base + "tr@sh p.a.t.h.e.t.i.c st*upid m o r o n " * 2)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, model, restored=True).collect()}
    assert scores[1] < 0.5 < scores[2]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    always = toxicity.held_out(5, 0) | ~toxicity.held_out(5, 0)
    model = toxicity.fit_toxicity(odd_docs, labels, always)
    scored = toxicity.score_toxicity(odd_docs, model, restored=True)
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert scored.columns == [*odd_docs.columns, "score", "predicted", "restored_text"]
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    none = toxicity.fit_toxicity(no_docs, labels.where("false"), always)
    assert {r.predicted for r in toxicity.score_toxicity(odd_docs, none).collect()} == {0}


def test_logistic_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    mean, scale, w = toxicity.fit_logistic(x, (x[:, 0] > 0).astype(float))
    assert w[0] > 2 and abs(w[1]) < 1
