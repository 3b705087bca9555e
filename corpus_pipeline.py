"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and its result is written and read by the next.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> personal data -> pieces. The first four
return the columns of documents: rejected documents go, of each group of near copies the row with the
smallest doc_id (then row key) stays, documents with a benchmark passage go, personal data are masked.
The last returns the pieces of what is left.

Null and empty texts fail the first stage's limits; in the others they have no words and stay as they are. An empty
table gives an empty one. Any further columns, whatever their names, come through unchanged.

Rows without a doc_id are never merged with others. Repeated rows are near copies of each other; unlike texts
under one doc_id are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaxframe.llm import decontaminate, outliers, personal_data, pieces, shingle_join
from vaxframe.llm.keys import keyed_rows, maybe_in, without
from vaxframe.sources.scratch import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the outlier estimate keep."""
    verdicts = outliers.judge(docs.select("doc_id", "text", "lang", "source")).groupBy("key").agg(F.bool_or("kept").alias("kept"))
    gone = stage(verdicts.where("not kept").select("key"), "rejected")
    return without(keyed_rows(docs), "key", gone).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, then row key; of rows alike in both, one."""
    rows = shingle_join.rooted_rows(docs.select("doc_id", "text")).where("doc_id is not null")
    rows = stage(rows.groupBy("doc_id", "row", "root").agg(F.count("*").alias("n")), "rows")
    grouped = rows.where("root is not null")
    first = stage(grouped.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row"), "first")
    gone = stage(grouped.join(first, "row", "left_anti").selectExpr("row as key"), "copies")
    twice = rows.where("n > 1")
    repeated = stage(twice.where("root is null").unionByName(twice.join(first, "row", "left_semi")).selectExpr("row as key").distinct(), "repeated")
    kept = without(keyed_rows(docs), "key", gone)
    if repeated.isEmpty():
        return kept.select("row.*")
    alike = maybe_in(kept, "key", repeated).join(repeated, "key", "left_semi")
    one = alike.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row", "key")
    return without(kept, "key", repeated).unionByName(one).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = keyed_rows(docs)
    found = decontaminate.contamination(keyed.select(F.col("key").alias("doc_id"), F.col("row")["text"].alias("text")), benchmark)
    gone = stage(found.where("size(hits) > 0").selectExpr("doc_id as key").distinct(), "contaminated")
    return without(keyed, "key", gone).select("row.*")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return personal_data.mask(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, decoded again as a check."""
    return pieces.encode_documents(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: The outlier estimates and the pieces have no SQL form; tests hold the run against step-by-step versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
