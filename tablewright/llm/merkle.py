"""Merkle manifest of a table, proven leaf by leaf with a recursive query (operator 13).

Rows are leaves, ordered within their language; runs of eight nodes have a parent, up to one root over the subroots of
the languages. Each built level is stored as rows linked to their parents. A recursive query then takes every leaf up these
links: a step takes the node's siblings and folds them with the hash carried so far, so a row of the climb is of
one size however high the tree is. Everything is done by DataFrame and SQL expressions.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.operators.rowindex import dense_index
from tablewright.session import broadcast_if_small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 8
#: A node is found by its tree (a number for each language, TOP for that of the subroots) and its spot, the level above this bit and its place below.
LEVEL_BIT = 48
TOP = -1

#: Folds are hashes of the hex text of a run of nodes. Parent rows know their own parent and their place in it.
_CLIMB = """
WITH RECURSIVE climb(leaf_row, step, tree, spot, place, folded, siblings) AS (
  SELECT leaf_row, 0, tree, spot, place, start, X'' FROM {leaves}
  UNION ALL
  SELECT c.leaf_row, c.step + 1, n.up_tree, n.up_spot, n.up_place,
    unhex(sha2(lower(hex(concat(substr(n.children, 1, 32 * c.place), c.folded, substr(n.children, 32 * c.place + 33)))), 256)),
    concat(substr(n.children, 1, 32 * c.place), substr(n.children, 32 * c.place + 33))
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.spot = c.spot
)
SELECT leaf_row, step, folded, siblings FROM climb WHERE step > 0
"""


def row_hash(fields: list[Column]) -> Column:
    """The hash of fields: each ``-`` if null, else its bytes in UTF-8 counted, a colon, and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tampered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, share: int = 3) -> DataFrame:
    """``(doc_id, lang, leaf, start)``: the hash of each row, and that of the row as it is after tampering.

    Rows whose crc32 of the decimal doc_id is a multiple of ``share`` are tampered with: their text is in lower case. A null
    doc_id is never tampered with.
    """
    doc_id, source, lang, n_chars, text = [column(c) for c in fields]
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % share == 0, F.lit(False))
    leaf = row_hash([doc_id, source, lang, n_chars, text])
    forged = row_hash([doc_id, source, lang, n_chars, tampered(text)])
    return docs.select(doc_id.alias("doc_id"), lang.cast("string").alias("lang"), F.unhex(leaf).alias("leaf"), F.when(hit, F.unhex(forged)).alias("forged")).select(
        "doc_id", "lang", "leaf", F.coalesce("forged", "leaf").alias("start")
    )


def _levels(nodes: DataFrame, width: int) -> tuple[list[DataFrame], DataFrame]:
    """Parent rows of ``nodes(tree, idx, last, hash)``, level by level, and ``(tree, hash)`` of the tops.

    ``idx`` is the place of a node in its tree, ``last`` the greatest one. A parent row is ``(tree, level, idx, last, children)`` with the
    hashes of its run of nodes one after the other. A tree ends where one node is left; a lone node is its own top.
    """
    parents: list[DataFrame] = []
    now, tops = nodes, nodes.where("last = 0").select("tree", "hash")
    while True:
        runs = now.where("last > 0").groupBy("tree", F.floor(F.col("idx") / width).cast("long").alias("up"))
        run = runs.agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run"))  # at most width nodes
        children = F.unhex(F.array_join(F.transform("run", lambda x: F.hex(x["hash"])), ""))
        rows = stored(
            run.select("tree", F.lit(len(parents) + 1).alias("level"), F.col("up").alias("idx"), F.floor(F.col("last") / width).cast("long").alias("last"), children.alias("children"))
        )
        if rows.isEmpty():
            return parents, tops
        parents.append(rows)
        now = rows.select("tree", "idx", "last", F.unhex(F.sha2(F.lower(F.hex("children")), 256)).alias("hash"))
        tops = tops.unionByName(now.where("last = 0").select("tree", "hash"))


def _up(level: Column, width: int, n_trees: int) -> list[Column]:
    """Tree and spot of the parent of a node, and its place there; a top's parent is in the tree of subroots, the root has none."""
    inside, below = F.col("last") > 0, (F.col("tree") != TOP) & F.lit(n_trees > 1)
    tree = F.when(inside, F.col("tree")).when(below, F.lit(TOP).cast("long"))
    at = F.when(inside, F.col("idx")).when(below, F.col("tree"))
    above = F.when(inside, level + 1).when(below, F.lit(1)).cast("long")
    return [
        tree.alias("up_tree"),
        (F.shiftleft(above, LEVEL_BIT) + F.floor(at / width).cast("long")).alias("up_spot"),
        (at % width).cast("int").alias("up_place"),
    ]


@contextmanager
def _unbounded_recursion(spark: SparkSession):
    """Recursive queries without Spark's bound on their rows; their depth is that of the tree."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, -1)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(leaf_row, folded, siblings)`` of each leaf that has a parent: its siblings up to the root, and what they fold to.

    ``leaves(leaf_row, tree, spot, place, start)`` point to their parents, ``nodes(tree, spot, children, up_tree, up_spot, up_place)`` to
    theirs. Computed once, since the bound on rows is lifted only while it runs.
    """
    spark = leaves.sparkSession
    with _unbounded_recursion(spark):
        steps = spark.sql(_CLIMB, leaves=leaves, nodes=nodes)
        path = F.array_sort(F.collect_list(F.struct("step", "siblings")))  # one entry for each level
        found = steps.groupBy("leaf_row").agg(F.max_by("folded", "step").alias("folded"), path.alias("path"))
        return stored(found.select("leaf_row", "folded", F.array_join(F.transform("path", lambda s: F.lower(F.hex(s["siblings"]))), "").alias("siblings")).withColumn("siblings", F.sha2("siblings", 256)))


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, width: int = WIDTH, share: int = 3) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a language ascend by doc_id (null first; rows of one id by their hash, and equal rows as they fall, which
    changes no hash). Runs of ``width`` nodes become one, the last run as it is, until one is left: the subroot; a lone leaf is its own. Subroots,
    ordered by language (null first, by bytes), become the root in the same way. ``proof_sha256`` is the hash of all siblings from
    the leaf up, left to right; a lone leaf of a lone language has none. ``folded_root`` is what the siblings give with the leaf of
    the row as tampered with. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    ordered = dense_index(manifest_leaves(docs, fields, share), [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf")], "leaf_row")
    counted = ordered.groupBy("lang").agg(F.min("leaf_row").alias("begin"), (F.count("*") - 1).alias("last"))
    langs = stored(dense_index(counted, [F.asc_nulls_first("lang")], "tree").withColumnRenamed("lang", "of_lang"))
    n_trees = langs.count()
    placed = ordered.join(broadcast_if_small(langs), F.col("lang").eqNullSafe(F.col("of_lang")))
    leaves = stored(placed.select("leaf_row", "tree", (F.col("leaf_row") - F.col("begin")).alias("idx"), "last", "doc_id", "leaf", "start"))

    parents, tops = _levels(leaves.select("tree", "idx", "last", F.col("leaf").alias("hash")), width)
    tops = stored(tops.withColumnRenamed("hash", "subroot"))
    above = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees - 1).cast("long").alias("last"), F.col("subroot").alias("hash"))
    top_parents, root = _levels(above, width)

    linked = [
        p.select("tree", (F.shiftleft(F.col("level").cast("long"), LEVEL_BIT) + F.col("idx")).alias("spot"), "children", *_up(F.col("level"), width, n_trees))
        for p in [*parents, *top_parents]
    ]
    start = leaves.select("leaf_row", *_up(F.lit(0), width, n_trees), "start").toDF("leaf_row", "tree", "spot", "place", "start")
    if not linked:  # a table of one row, or of none
        proven = start.select("leaf_row", F.col("start").alias("folded"), F.sha2(F.lit(""), 256).alias("proof_sha256")).where("false")
    else:
        proven = climb(start, stored(reduce(DataFrame.unionByName, linked))).withColumnRenamed("siblings", "proof_sha256")

    top = root.first()
    root_hash = F.lit(top["hash"] if top else None).cast("binary")
    folded = F.coalesce("folded", "start")
    out = leaves.join(proven, "leaf_row", "left").join(broadcast_if_small(tops), "tree")
    return out.select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex(root_hash)).alias("root"),
        F.coalesce("proof_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("proof_sha256"),
        F.lower(F.hex(folded)).alias("folded_root"),
        (folded == root_hash).alias("verified"),
    )
