import hashlib
from itertools import groupby
from zlib import crc32

import pytest

from tablewright.llm.merkle import merkle_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, `leaf.row` string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def built(hashes, width):
    """The root of hashes, and for each the (left, right) siblings of every step up to it."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // width * width :][:width]
            paths[k].append((run[: place % width], run[place % width + 1 :]))
        at = [place // width for place in at]
        level = [digest(*level[i : i + width]) for i in range(0, len(level), width)]
    return level[0], paths


def brute(rows, width=8):
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    ordered = sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [list(g) for _, g in groupby(ordered, key)]
    inner = [built([leaf_of(r) for r in t], width) for t in trees]
    root, upper = built([x[0] for x in inner], width)
    out = []
    for tree, (subroot, paths), over in zip(trees, inner, upper, strict=True):
        for row, path in zip(tree, paths, strict=True):
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*row[:4], text))
            for left, right in path + over:
                folded = digest(*left, folded, *right)
            proof = digest(*[h for left, right in path + over for h in left + right])
            out.append((row[0], leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("langs", [["en"], ["en", "de", None, "", "é", "zh", "a", "b", "c", "d"]])
@pytest.mark.parametrize("n", [2, 9, 75])
def test_matches_brute_force(spark, langs, n):
    rows = [(i * 7 % n, f"s{i % 3}", langs[i * i % len(langs)], i, f"Text {i} É \U0001f600") for i in range(n)]
    assert shown(merkle_manifest(table_of(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", 0, ""), (1, "", "en", 0, ""), (1, "s", "en", 5, "Other"), (None, "s", "en", 1, "UPPER"), (3, "s", "en", 1, "A" * 300_000), (-4, "a:1", None, -7, "1:a")]
    assert shown(merkle_manifest(table_of(spark, rows))) == brute(rows)


@pytest.mark.parametrize("text", ["Lone", None])
def test_one_row(spark, text):
    rows = [(12, "s", "en", 4, text)]
    got = merkle_manifest(table_of(spark, rows)).collect()
    assert shown(merkle_manifest(table_of(spark, rows))) == brute(rows)
    assert got[0].leaf == got[0].subroot == got[0].root


def test_other_widths(spark):
    rows = [(i, "s", "en" if i % 5 else "de", i, f"T{i}") for i in range(40)]
    assert shown(merkle_manifest(table_of(spark, rows), width=2)) == brute(rows, 2)


def test_empty_table_and_settings(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle_manifest(table_of(spark, [(1, "s", "en", 1, "t")]).where("false")).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
