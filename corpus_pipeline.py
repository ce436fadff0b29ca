"""The corpus pipeline: from raw documents to token ids.

Each stage is ``f(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. ``n_chars`` follows the
text where a stage changes it. Line dedup and near dedup both leave what repeats with the largest id, so that a line which
left one near copy is not lost with another. A null id is smaller than every other: such a row loses the lines that
other documents keep, and takes no part in near dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, written
from plumbline.llm.decontamination import find_items
from plumbline.llm.lines import drop_repeated_lines
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.sentencepieces import encode_documents
from plumbline.llm.toxicity import fit, score_toxicity
from plumbline.registry import query

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), keep=("lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep."""
    kept = drop_repeated_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the largest id."""
    others = near_duplicates(docs).where("NOT kept").select("component_id", "doc_id")
    groups = others.groupBy("component_id").agg(F.max("doc_id").alias("last"))
    members = others.select("doc_id").union(groups.select("component_id")).distinct()
    gone = members.join(groups.select(F.col("last").alias("doc_id")), "doc_id", "left_anti")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_items(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source", "n_chars"))
    return found.where(F.size("found") == 0).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its source, token ids, their number, and the text decoded from them."""
    out = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: No SQL states the classifier, the approximate search for items or the encoding; tests hold every stage against a plain version, row by row.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
