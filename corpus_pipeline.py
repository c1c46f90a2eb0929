"""A corpus from raw documents to training sequences: five stages, each on what the one before kept.

Rows are documents by their doc_id. A null doc_id can't be told from another, so such rows are judged by their text where a stage
looks at texts alone (language ID, packing) and pass the stages that compare documents (line dedup, near duplicates,
decontamination) as they are. Rows that repeat a doc_id with one text are one document in several copies: they are kept or dropped
together. Rows that repeat a doc_id with different texts are compared as documents of their own, but dropped together where one of
them is a near copy of another document or holds a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, jaccard, langid, linededup, packing
from corpusgraph.llm.common import stored, table

#: The columns that all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages go: rejected ones, and those without letters."""
    docs = docs.select(*COLUMNS)
    who = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs, who).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that equal an earlier line, and longer ones that are one word away from one, go; so do documents
    that have no other lines."""
    docs = docs.select(*COLUMNS)
    return linededup.without_lines(docs, linededup.dropped_lines(docs.select("doc_id", "text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a close paraphrase of one, go."""
    docs = docs.select(*COLUMNS)
    found = stored(decontam.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.packed_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the language models nor the latent search; the stages are tested one by one.
ORACLE_SQL = None
