import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.linededup import Lines, drop_repeated_lines, places, twice_seen

ENDS = re.compile("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$")


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in ENDS.sub("", line))


def brute(docs, least_docs, least_chars=1, keep="none"):
    """(n_lines, n_dropped, kept text) of each (id, text)."""
    found = {}
    for i, (_, text) in enumerate(docs):
        for k in {key(line) for line in (text or "").split("\n")}:
            found.setdefault(k, set()).add(i)
    gone = {k: v for k, v in found.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for doc_id, text in docs:
        lines, kept, spared = (text or "").split("\n"), [], set()
        for line in lines:
            k = key(line)
            named = [docs[j][0] for j in gone.get(k, ()) if docs[j][0] is not None]
            first = keep == "first" and k in gone and doc_id == (min(named) if named else None) and k not in spared
            if first:
                spared.add(k)
            if k not in gone or first:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def line_docs(spark):
    rng = random.Random(11)
    common = ["Accept all cookies", " \taccept ALL cookies\x0b", "é Ü", "", "  ", "\x1f", "x", " ", "License: free", "A" * 3000]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) for _ in range(rng.randrange(6))] + [f"line {rng.randrange(60)}" for _ in range(4)] + [f"own {i} {k}" for k in range(3)]
        rng.shuffle(lines)
        rows.append((i if i % 17 else None, "\n".join(lines), i, "kept"))
    rows += [(500, None, 1, "kept"), (501, "", 2, "kept"), (502, "\n\n", 3, "kept"), rows[5], rows[5], (503, "\n".join(f"l{k % 50} z" for k in range(20_000)), 4, "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines int, `held.x` string").repartition(7)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1fAbé  ", max_size=12), max_size=6))
def test_lines_of_a_slice(texts):
    lines = Lines(pa.array(texts, pa.string()))
    want = [(i, line) for i, t in enumerate(texts) for line in t.split("\n")]
    got = [(int(t), lines.raw[a:b].tobytes().decode()) for t, a, b in zip(lines.text, lines.starts, lines.ends, strict=True)]
    assert got == want
    assert [lines.key(k).decode() for k in range(len(want))] == [key(line) for _, line in want]
    assert [int(k) for k in lines.keyed] == [k for k, (_, line) in enumerate(want) if key(line)]
    by_key = {}
    for k, h in zip(lines.keyed, lines.hashes, strict=True):
        assert by_key.setdefault(lines.key(k), h) == h


@pytest.mark.parametrize("least_docs", [2, 10])
@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("how", [{}, {"broadcast_lines": 0}, {"most_bits": 16, "least_chars": 3}])
def test_matches_brute_force(line_docs, least_docs, keep, how):
    rows = line_docs.collect()
    got = drop_repeated_lines(line_docs, least_docs=least_docs, keep=keep, **how)
    assert sorted(got.columns) == ["doc_id", "held.x", "kept_text", "n_dropped", "n_lines", "text"]
    want = brute([(r.doc_id, r.text) for r in rows], least_docs, how.get("least_chars", 1), keep)
    order = lambda x: tuple(str(y) for y in x)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=order) == sorted(((r.doc_id, r.text, *w) for r, w in zip(rows, want, strict=True)), key=order)


def test_filter_holds_every_repeat_and_little_else(spark, line_docs):
    rows = line_docs.collect()
    twice = twice_seen(line_docs, 1 << 16)
    found = {}
    for i, r in enumerate(rows):
        for k in {key(line) for line in (r.text or "").split("\n")} - {""}:
            found.setdefault(k, set()).add(i)
    lines = Lines(pa.array(list(found), pa.string()))
    assert (lines.counts == 1).all()
    held = set(lines.suspected(twice).tolist())
    repeated = {i for i, v in enumerate(found.values()) if len(v) > 1}
    assert repeated <= held
    assert len(held - repeated) <= 0.02 * len(found)


def test_probes_are_bits_of_the_filter():
    at = places(np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1 << 16)
    assert at.min() >= 0 and at.max() < 1 << 16


def test_odd_tables(odd_docs, no_docs):
    assert drop_repeated_lines(no_docs).count() == 0
    rows = odd_docs.collect()
    got = drop_repeated_lines(odd_docs, least_docs=2).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == brute([(r.doc_id, r.text) for r in rows], 2)
    with pytest.raises(ValueError):
        drop_repeated_lines(odd_docs, keep="last")
    with pytest.raises(ValueError):
        drop_repeated_lines(odd_docs, least_docs=1)
