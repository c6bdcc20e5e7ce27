"""The corpus pipeline: five operators, one after another, over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and reads it again as the next stage's docs.  All stages
but the last return the columns of documents.

1. quality rules: documents that a rule rejects go.
2. line dedup: lines of recurring templates go, and n_chars follows the text; so do
   documents of which all words went that way.
3. n-gram Jaccard join: of each group of linked documents (five words, 0.8) one row
   of least id stays, also if ids repeat; one without an id only if none has one.  Documents that link with nothing stay, without text too.
4. benchmark decontamination: documents that leak a benchmark item go.
5. packing: what is left, as pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import decontam, jaccard, linedup, packing, quality
from terraloom.llm.shared import let_go, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linedup.drop_lines(docs, drop_emptied=True)
    n_chars = F.when(F.col("n_dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids may repeat or be null, so rows have keys of their own, written once as they aren't stable
    keyed = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "row_keys")
    groups = jaccard.join(keyed, id_col="row_key", size=5, percent=80).select(F.col("doc_id").alias("row_key"), "component_id")
    rows = keyed.select("row_key", "doc_id").join(groups, "row_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    return keyed.join(first.select(F.col("first.row_key").alias("row_key")), "row_key", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", curve_packing),
]

#: SQL has no byte-pair encoding and no trained n-gram model: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        let_go(spark)
    return docs
