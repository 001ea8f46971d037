"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Nulls, empty tables and repeated rows are as the operators of
sparlink.llm define them; of the rows of one near-duplicate group one stays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparlink.llm.common import tokenizer_path, written
from sparlink.llm.importance import importance_resample
from sparlink.llm.line_dedup import drop_repeated_lines
from sparlink.llm.packing import pack
from sparlink.llm.quality_rules import quality_rules
from sparlink.llm.queries import quality_targets
from sparlink.llm.shingle_links import without_copies


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; what isn't drawn goes."""
    targets = quality_targets(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return importance_resample(docs, targets).where("kept").select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts; rejected documents go."""
    return quality_rules(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line of ten and more documents the first occurrence stays; n_chars follows the text."""
    out = drop_repeated_lines(docs, "text", min_docs=10, least=1, keep="first", id_col="doc_id")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 and more) one row stays.

    Pairs of SimHash fingerprints are compared within cells, what is near by its shingle sets. The row that stays is that
    with the smallest doc_id, one without doc_id only if no row of the group has one; rows that have no copy stay, whatever
    other rows have their doc_id or none.
    """
    return without_copies(docs, size=5, least=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids, a row for each piece of a document."""
    return pack(docs, path=tokenizer_path(), end_id=2, size=4096).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("packing", packing)]

#: SQL can't express hashed models, fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
