"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before
kept, and returns the columns of ``documents``; the last returns packed pieces.
``run`` writes each stage's result as Parquet to the shared folder and rereads it.

Rows are documents, whatever their ids: a doc_id may be null or occur more than once,
and every other column may be null. Null and empty texts, texts of any length,
empty tables and further columns of any name are taken by every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, line_dedup, ngram_jaccard, packing, toxicity
from strandloom.llm.common import Work, free_name, sweep, work_folders
from strandloom.llm.queries import tokenizer_path


def _apart(docs: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id, text and a struct of the other columns, so that no name clashes with an operator's; and the columns of ``docs`` again."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    return rows, [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{rest.index(c)}").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the classifier learns from all labelled rows of ``docs``.

    A null or empty text scores as a text without n-grams; rows are scored each. If a
    label has no example at all, the other one decides: without toxic examples all stay.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, columns = _apart(docs)
    return toxicity.score_toxicity(rows, model).filter("score < 0.5").select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts, and documents of which nothing is left; n_chars is brought up to date.

    Null and empty texts stay as they are. Rows equal in doc_id and text are one
    document to this stage and get the same text.
    """
    rows, columns = _apart(docs)
    out = line_dedup.line_dedup(rows).filter("lines_removed = 0 or text <> ''").select(*columns, F.col("lines_removed").alias(free_name(docs, "lines_removed")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id (null comes first), then of the smallest text hash, then the first in the table.

    Rows have numbers of their own, so texts that share a doc_id are documents of their
    own, and rows that repeat a document are a group. Texts without words link with nothing and all stay.
    """
    work = Work(spark, "near-duplicates")
    row = free_name(docs, "row_no")
    rows = work.cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct("doc_id", F.xxhash64("text").alias("tkey"), F.col(row).alias("row"))
    groups = ngram_jaccard.ngram_jaccard_components(rows.select(key.alias("doc_id"), "text"))
    extra = groups.filter("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row))
    return rows.join(extra.hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows are judged by their text alone."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their places in sequences; a null or empty text is its end id alone, and each row is packed."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: the trained classifier, tiling, tokenizer and packing are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents``."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = work_folders()
        docs, read = work.cut(stage(spark, docs, sf_dir), name), docs
        # what the stage and the one before it wrote is not read again
        sweep(spark, before)
        work.drop(read)
    return docs
