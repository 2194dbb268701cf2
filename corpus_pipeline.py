"""From raw documents to a training mixture: five stages, each written and read again before the next.

quality rules -> language ID -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixflow.llm.common import materialise, table
from helixflow.llm.decontaminate import drop_leaks
from helixflow.llm.jaccard_join import JoinOptions, document_classes
from helixflow.llm.language_id import identify, train_language
from helixflow.llm.mixing import PRODUCTION, mix_sources
from helixflow.llm.quality import quality_rules, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees' verdict. A null or empty text has no words and goes; repeated rows, and
    rows without doc_id, are each judged by their own text; an empty table, and other columns than COLUMNS, give none."""
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, trees).where("kept").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; a text without letters, or between two codewords, goes."""
    found = identify(docs.select(COLUMNS), train_language(docs))
    return found.where("lang_pred <> 'und' and not ambiguous").select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (five-word shingles, similarity 0.8): the one of least doc_id. Of rows that repeat
    both doc_id and text one stays; rows without doc_id, which can't be linked, stay as well, and so do other texts of an id
    that repeats."""
    found = materialise(document_classes(docs, JoinOptions(words=5, percent=80)).select("doc_id", "text_id", "first"))
    key = ["doc_id", "text_id"]
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_id"))
    kept = named.join(found.where("not first").select(*key).distinct(), key, "left_anti")
    again = materialise(found.where("first").groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key))
    if not again.isEmpty():
        twice = lambda how: kept.join(again, [kept[k].eqNullSafe(again[k]) for k in key], how)
        kept = twice("left_anti").unionByName(twice("left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none and stays; rows of one doc_id are one document, so one
    leak takes them all, and rows without doc_id are one document as well; an empty table gives an empty one."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each epoch that the mixing plan takes. Null lang or source is a name of its own; texts without words are
    taken at no cost; rows of one doc_id are all in a prefix or all out; an empty table gives an empty one."""
    return mix_sources(docs.select(COLUMNS), PRODUCTION)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicate), ("decontaminate", decontaminate), ("mix", mix)]

#: Trees, codewords and components have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", F.col("text"))
