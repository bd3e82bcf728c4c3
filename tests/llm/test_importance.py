import hashlib
import math
import re
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.importance import bucket_counts, bucket_gains, features, importance_weights, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), w + [" ".join(p) for p in zip(w, w[1:])]


def brute(docs, target, buckets=10_000):
    """(id, n_features, weight, score, rank) of each (id, text), by joined strings and plain sums."""

    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t)[1]:
                out[crc32(f.encode()) % buckets] += 1
        return out

    s, t = counted([x for _, x in docs]), counted(target)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = runs(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k, row in enumerate(able[: 25 * len(able) // 100]):
        row[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def plain(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_features_are_hashes_of_joined_words(text):
    n, found = features(text.encode("utf-8", "ignore"))
    words, joined = runs(text.encode("utf-8", "ignore").decode())
    assert n == words and sorted(found) == sorted(crc32(f.encode()) for f in joined)


def test_longer_runs():
    assert features(b"A b, c", 3)[1] == [crc32(x) for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]


def test_odd_rows_match_brute_force(spark, odd_docs):
    target = spark.createDataFrame([("alpha beta gamma delta",), (None,), ("",)], "text string")
    docs = odd_docs.withColumnRenamed("source", "weight").withColumnRenamed("row", "rank")
    weighted = importance_weights(docs, bucket_gains(bucket_counts(docs), bucket_counts(target)))
    got = resample(weighted)
    assert got.columns == ["doc_id", "text", "hits.x", "n_words", "n_features", "weight", "score", "rank"]
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], ["alpha beta gamma delta", None, ""])
    assert plain((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain(want)


def test_empty_tables(spark, odd_docs, no_docs):
    nothing = bucket_counts(no_docs)
    assert not nothing.any()
    gains = bucket_gains(nothing, nothing)
    assert not gains.any()
    assert resample(importance_weights(no_docs, gains)).count() == 0
    against = importance_weights(odd_docs, bucket_gains(bucket_counts(odd_docs), nothing))
    assert resample(against).count() == odd_docs.count()
    short = resample(against.where("n_words < 20"))
    assert short.where("rank is not null").count() == 0


def test_share_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i // 2, text) for i in range(40)], "doc_id long, text string")
    weighted = importance_weights(docs, bucket_gains(bucket_counts(docs), bucket_counts(docs)))
    drawn = resample(weighted, percent=10).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in drawn] == [1, 2, 3, 4]
    assert drawn[0].doc_id == drawn[1].doc_id and drawn[2].doc_id == drawn[3].doc_id
