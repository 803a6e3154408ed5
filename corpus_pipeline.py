"""A corpus pipeline of five operators: language ID, line dedup, SimHash near-dedup, benchmark decontamination, source mixing.

Each stage works on all that the one before kept. Stages return the columns of documents, the last one adds the mix.
Defined results: every stage keeps what its operator's docstring defines for nulls, empty texts and repeated rows; documents without a letter go in
the first stage, documents without a line left in the second. Columns of documents beyond doc_id, text, lang and source pass
through; result columns of the last stage replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import fair_mix, kernel, line_dedup, mixture_langid, positional_index, simhash_similar
from palimpsest.runtime import read_table, remove, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least half in one learnt language."""
    return mixture_langid.accepted(docs, mixture_langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; documents whose lines all go are copies and go with them. n_chars follows the text."""
    n, n_gone, words_gone = kernel.fresh(docs.columns, "__n", "__n_gone", "__words_gone")
    rows = line_dedup.dedup_lines(docs, into=(n, n_gone, words_gone))
    rows = rows.where((F.col(n_gone) == 0) | (F.length("text") > 0))
    n_chars = F.when(F.col(n_gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return rows.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity 0.8 or more over five-word shingles, links taken together.

    Line dedup has taken from a near copy what it shares with its original. So documents whose texts it changed are also compared as they came."""
    return simhash_similar.survivors(docs, also=read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in."""
    return positional_index.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words that the mix takes of each."""
    return fair_mix.mix(docs).orderBy("virtual_finish", "source", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

#: Mixture inference and SimHash components have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage was read from goes when its own rows are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
