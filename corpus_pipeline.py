"""From raw documents to piece ids: language, repeated lines, near copies, benchmark passages, segmentation.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; what it returns is stored as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import langid
from attestry.llm.common import read_table, stored
from attestry.llm.decontaminate import decontaminate
from attestry.llm.line_dedup import line_dedup
from attestry.llm.ngram_join import ngram_join
from attestry.llm.pieces import sample_pieces

#: Rows of a batch that a Python worker and its JVM hold at once; texts are long, and stages share their executors' memory.
BATCH_ROWS = 1000
#: Stages take five-word shingles at a similarity of 0.8 unless a contract says otherwise.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_ROWS rows at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; a missing ``lang`` is filled with the prediction."""
    small_batches(spark)
    model = langid.train(docs.where(~langid.is_held_out()))
    known = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    row = [F.col(f"row.`{c}`").alias(c) if c != "lang" else F.coalesce("row.lang", "lang_pred").alias(c) for c in docs.columns]
    return known.where(F.col("lang_pred") != langid.UNKNOWN).select(*row)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents that keep no word go with them."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    kept = line_dedup(packed).where(F.col("text").rlike(r"\S"))
    row = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return kept.select(*[row[c].alias(c) if c in row else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id stays; a document without an id stays."""
    small_batches(spark)
    found = ngram_join(docs.select("doc_id", "text"), n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    small_batches(spark)
    marked = decontaminate(packed, read_table(spark, sf_dir, "benchmark"))
    return marked.where("n_hit = 0").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def segment_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the ids of one sampled segmentation, and the scores of all that were drawn."""
    small_batches(spark)
    drawn = sample_pieces(docs.select("doc_id", "text"), ids_of=1)
    first = F.get("segmentations", F.lit(0))
    return drawn.select(
        "doc_id", first["ids"].alias("piece_ids"), first["n_pieces"].alias("n_pieces"), first["decodes"].alias("decodes"),
        *[F.col(f"segmentations.{f}").alias(f) for f in ("log_prob", "log_inclusion", "ids_sha256")])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("pieces", segment_pieces),
]

#: The language model, the join's components and the sampler are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is stored before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
