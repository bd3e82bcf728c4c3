import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import neardup
from tablewright.llm.components import components
from tablewright.llm.queries import QUERIES
from tablewright.llm.words import Words
from tests.conftest import SF_DIR

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(texts, similarity=0.8):
    """Class of each text by comparing all pairs, with exact document frequencies."""
    sets = [shingles(t) for t in texts]
    df = Counter(s for row in sets for s in row)
    n = len(texts)
    weight = [{s: c * (1 + neardup.IDF_SHARE * np.log(n / df[s]) / np.log(max(n, 2))) for s, c in row.items()} for row in sets]
    owner = list(range(n))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    close = set()
    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            a, b = weight[i], weight[j]
            shared = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            whole = sum(a.values()) + sum(b.values()) - shared
            same = texts[i] == texts[j]
            if whole and abs(shared / whole - similarity) < 0.01 and not same:
                close.add((j, i))
            if same or whole and shared / whole >= similarity:
                owner[find(i)] = find(j)
    return [find(i) for i in range(n)], close


def partition(labels):
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for size in (1, 1, 2, 3, 5, 40):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    shared = " ".join(rng.choice(words) for _ in range(120))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    return texts


def test_classes_match_brute_force(spark):
    texts = [*corpus(), "one", "one", "One!", "one two", "", "", None, None, "?", "!"]
    got = neardup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels, close = brute(texts)
    assert not close
    assert partition([r.class_id for r in sorted(got, key=lambda r: r.doc_id)]) == partition(labels)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def families():
    """Texts made from one, none alike to it, each with copies of its own, so that one bucket holds many classes."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]

    def changed(text, places):
        copy = list(text)
        for k in rng.sample(range(len(copy) // 10), places):
            copy[10 * k + rng.randrange(5)] = rng.choice(words)
        return copy

    base = [rng.choice(words) for _ in range(150)]
    texts = [base]
    for k in range(40):
        texts.append(changed(base, 6))
        for _ in range(k % 3):
            texts.append(changed(texts[-1], 1))
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("small, divisions, block", [(32, 2, 1024), (1, 2, 1024), (1, 50, 1024), (1, 0, 8), (1, 1, 8)])
def test_classes_within_one_bucket_match_brute_force(spark, monkeypatch, small, divisions, block):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "DIVISIONS", divisions)
    texts = families()
    got = neardup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels, close = brute(texts)
    assert not close
    assert len(set(labels)) > 30
    assert partition([r.class_id for r in sorted(got, key=lambda r: r.doc_id)]) == partition(labels)


def test_alike_texts_share_a_difference_from_any_leader():
    rng = random.Random(8)
    idf = np.linspace(1, 1.25, 1 << 10, dtype=np.float32)
    base = rng.choices("abcdefgh", k=120)
    texts = []
    for _ in range(60):
        copy = list(rng.choice([base, *texts[-5:]]))
        for _ in range(rng.choice((0, 1, 2, 4))):
            copy[rng.randrange(len(copy))] = rng.choice("abcdefghxyz")
        texts.append(copy[: rng.choice((90, 118, 120))])
    w = Words(pa.array([" ".join(t) for t in texts]))
    text, of, weight = neardup.weighted(w, idf)
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = [(of[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    alike = [[neardup.weighted_jaccard(x, y) >= 0.8 for y in sets] for x in sets]
    checked = 0
    for k, lead in enumerate(sets):
        found = [neardup._difference_keys(x, lead, idf, 0.8) for x in sets]
        keys = [set(f.tolist()) for f, _ in found]
        short = [set(f[:n].tolist()) for f, n in found]
        assert not keys[k]
        for i in range(len(sets)):
            for j in range(i):
                if alike[i][j] and not (alike[i][k] and alike[j][k]):
                    checked += 1
                    assert short[i] & keys[j] or keys[i] & short[j]
    assert checked > 500


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in QUERIES["op3_near_duplicates"](spark, SF_DIR).collect()}
    labels, close = brute([d.text for d in docs])
    ours, theirs = partition([got[d.doc_id] for d in docs]), partition(labels)
    unsure = {i for pair in close for i in pair}
    assert all(g & unsure for g in ours ^ theirs)
    assert any(len(g) > 1 for g in ours)


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = neardup.near_duplicate_classes(odd_docs).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == round(sum(1 / r.class_size for r in got))
    left = neardup.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    kept = left.collect()
    assert len(kept) == sum(r.kept for r in got)
    assert sum(r.text is None for r in kept) == 2 and sum(r.text == "" for r in kept) == 1
    assert neardup.near_duplicate_classes(no_docs).count() == 0
    assert neardup.drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("changed", [0, 3, 20])
def test_samples_agree_as_often_as_texts_are_alike(changed):
    rng = random.Random(changed)
    agree, alike = [], []
    idf = np.linspace(1, 1.25, 1 << 10, dtype=np.float32)
    for _ in range(40):
        a = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(300)]
        b = list(a)
        for _ in range(changed):
            b[rng.randrange(300)] = "changed"
        w = Words(pa.array([" ".join(a), " ".join(b)]))
        text, of, weight = neardup.weighted(w, idf)
        s = neardup.samples(text, of, weight, 2)
        agree.append((s[0] == s[1]).mean())
        cut = np.searchsorted(text, 1)
        alike.append(neardup.weighted_jaccard((of[:cut], weight[:cut]), (of[cut:], weight[cut:])))
    assert abs(np.mean(agree) - np.mean(alike)) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    owner = {}

    def find(x):
        while owner.setdefault(x, x) != x:
            x = owner[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            owner[b] = a
    assert got == {x: find(x) for x in owner}


def test_recall_of_leaders_on_a_hot_group(spark):
    """Links between classes that leaders find in a group whose members are near the threshold, against all pairs."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6])):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    labels, _ = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(neardup.near_duplicate_classes(docs, rounds=neardup.LEADER_ROUNDS).collect(), key=lambda r: r.doc_id)
    found = partition([r.class_id for r in got])
    want = partition(labels)
    merged = len(texts) - len(want)
    assert merged > 100
    assert len(texts) - len(found) >= 0.97 * merged
    assert all(any(ours <= theirs for theirs in want) for ours in found)  # no link of its own


def test_links_that_leaders_miss_are_found(spark, monkeypatch):
    """Many families in one bucket, none alike to its leader or to the picks of a round: the rest is compared in full, in cells of any size."""
    texts = families() + families()[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels, close = brute(texts)
    assert not close
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    for block, n_bytes, rounds in ((8, 8 << 20, 1), (20, 3000, 0)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", n_bytes, raising=False)
        got = neardup.near_duplicate_classes(docs, rounds=rounds).collect()
        assert partition([r.class_id for r in sorted(got, key=lambda r: r.doc_id)]) == partition(labels)


def test_pairs_of_cells_are_those_of_their_rows():
    """A pair counts in the first band that its texts share; a strange host leaves it to the greater probe."""
    idf = np.ones(4, np.float32)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(["less", *words])]

    def links(cell, strange, band, host, probe):
        rows = {
            "cell": pa.array(cell), "node": pa.array([1, 2, 3]), "component": pa.array([1, 2, 3]), "strange": pa.array(strange),
            "host": pa.array(host), "probe": pa.array(probe), "band": pa.array([band] * 3), "bands": pa.array([[7, 7]] * 3),
            "sketch": pa.array([bytes(56)] * 3), "text": pa.array(texts),
        }
        return list(zip(*neardup._links_of_cells(pa.table(rows), idf, 0.8), strict=True))

    yes = [True] * 3
    assert links([1, 1, 1], [False, True, True], 0, yes, [False, True, True]) in ([(2, 1), (3, 1)], [(2, 1), (3, 2)])
    assert links([1, 1, 1], [False, True, True], 1, yes, [False, True, True]) == []  # they shared the band before
    assert links([1, 1, 2], [False, True, True], 0, yes, [False, True, True]) == [(2, 1)]
    assert links([1, 1, 1], yes, 0, [False, False, True], [True, True, False]) == []


@pytest.mark.parametrize("size", [12, 150, 3000])
def test_pairs_of_cells_are_verified_whatever_their_samples_say(size):
    """Pairs of one bucket whose samples agree nowhere: the similarity of their shingles alone decides."""
    rng = random.Random(size)
    words = [f"w{i}" for i in range(900)]
    idf = np.random.default_rng(size).uniform(1, 1.25, 1 << 10).astype(np.float32)
    base = [rng.choice(words) for _ in range(size)]
    texts = [" ".join(base)]
    for share in np.linspace(0.001, 0.06, 24):
        copy = [rng.choice(words) if rng.random() < share else w for w in base]
        texts.append(" ".join([*copy, *["more"] * rng.randrange(1 + size // 10)]))
    sets = []
    for t in texts:
        _, of, weight = neardup.weighted(neardup.Words(pa.array([t], pa.large_string())), idf)
        sets.append((of, weight))
    found = 0
    for i in range(1, len(texts)):
        rows = {
            "cell": pa.array([5, 5]), "node": pa.array([0, i]), "component": pa.array([0, i]), "strange": pa.array([False, True]),
            "host": pa.array([True, True]), "probe": pa.array([False, True]), "band": pa.array([0, 0]), "bands": pa.array([[7, 7]] * 2),
            "sketch": pa.array([bytes(56), bytes([255]) * 56]), "text": pa.array([texts[0], texts[i]]),
        }
        got = list(zip(*neardup._links_of_cells(pa.table(rows), idf, 0.8), strict=True))
        alike = neardup.weighted_jaccard(sets[0], sets[i])
        if abs(alike - 0.8) > 1e-6:
            assert got == ([(i, 0)] if alike >= 0.8 else [])
            found += len(got)
    assert found > 0
