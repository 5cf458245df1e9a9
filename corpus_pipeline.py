"""A training-corpus pipeline of operators of basketry.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes to the shared scratch folder as Parquet and reads again as the next
stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import crc_of_id, table, written
from basketry.llm.decontamination import contaminated
from basketry.llm.near_copies import near_copies
from basketry.llm.packing import pack_documents
from basketry.llm.pii import replace_pii, session_key
from basketry.llm.quality_classifier import classify

#: SQL has no means to express the classifier; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a document with several rows goes if any is rejected.

    The rows with a null doc_id count as one document. Null and empty texts have a score like any other. Other columns stay, whatever their names. An empty table gives no rows.
    """
    scored = classify(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_rejected"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays; of its rows, if it has several, all.

    Texts are linked as in op6, by SimHash fingerprints within two bits, and, as copies with a few edits are mostly further apart than that, by a similarity of 0.8 or more of their five-word shingles.

    Null, empty and wordless texts are copies of each other. Rows with a null doc_id stay, all of them, if one of them is in a group without any other doc_id, else none does. Long texts are compared whole. Other columns stay, whatever their names. An empty table gives no rows.
    """
    groups = near_copies(docs, simhash=True)
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; a document with several rows, and the rows with a null doc_id as one document, go if any has one.

    Null and empty texts have no passage and long ones are searched whole. Other columns stay, whatever their names. Without documents there are no rows, without a benchmark all stay.
    """
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for what is personal in them; n_chars follows the new text.

    Every row stays, also with a null or repeated doc_id. A null text stays null, and so does its n_chars. Long texts are read whole. Other columns stay, n_entities too. An empty table gives no rows.
    """
    replaced = replace_pii(docs.withColumnRenamed("n_entities", "_given_entities"), session_key(spark)).drop("n_entities").withColumnRenamed("_given_entities", "n_entities")
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences.

    A null or empty text is a piece of the end id alone; rows with a null or repeated doc_id are packed each; longer texts than a sequence are cut. Other columns are left out. An empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pii), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
