"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs`` and the rows that stay; the
last returns the packed pieces. Documents with a null text have no words: the quality rules refuse them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table
from tablewright.llm.decontamination import flag_contamination, remove_contamination
from tablewright.llm.neardup import LEADER_ROUNDS, drop_near_duplicates
from tablewright.llm.packing import pack_documents
from tablewright.llm.quality import judge, language_references, measure
from tablewright.llm.queries import PACKING_VOCABULARY
from tablewright.llm.toxicity import fit_toxicity, held_out, score_toxicity
from tablewright.session import scratch_path, stored


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under neutral column names, which no operator's own columns clash with, and those names."""
    names = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def again(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The documents' columns under their own names."""
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents predicted to be toxic go."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    own, names = plain(docs)
    return again(score_toxicity(own, model, text=names["text"]).where("predicted = 0"), names)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules refuse go."""
    own, names = plain(docs)
    measured = stored(measure(own, text=names["text"]))
    return again(judge(measured, language_references(measured, lang=names["lang"])).where("kept"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near-duplicates stays."""
    return drop_near_duplicates(docs, rounds=LEADER_ROUNDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold too much of the benchmark go."""
    own, names = plain(docs)
    return again(remove_contamination(flag_contamination(own, table(spark, sf_dir, "benchmark"), text=names["text"])), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of the documents in their sequences."""
    return pack_documents(docs, PACKING_VOCABULARY).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the model of the first stage; tests hold each stage against a plainer version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
