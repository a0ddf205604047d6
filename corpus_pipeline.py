"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's input.  All but the last return the columns of ``docs``.

Each stage lowers the session's Arrow batch size (``small_batches``), and a task of it has one
Python worker at a time: workers that a task chains stay beside the next stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import decontam, jaccard, langid, quality, viterbi
from flowsentry.llm.common import Workspace, arrow_rows, fresh_name, held_out
from flowsentry.llm.queries import QUALITY_THRESHOLD, quality_model, table, vocabulary


def small_batches(spark: SparkSession) -> None:
    """Python tasks of this session get ``BATCH_ROWS`` rows at most from here on (fewer, if set so).

    This stays after a stage has returned, as its tasks run when the caller writes the result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name))
    spark.conf.set(name, str(min(BATCH_ROWS, usual) if usual > 0 else BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that read like one of the learned languages.

    Rejected: texts without a letter (and null texts), texts less likely under their language
    than under a uniform choice of n-grams, and texts whose language is below one half.
    """
    small_batches(spark)
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")), "text", "lang")
    lang, score, fits = (fresh_name(docs, n) for n in ("lang_pred", "lang_score", "lang_fits"))
    judged = langid.predict(spark, docs, "text", model, lang_out=lang, score_out=score, fits_out=fits)
    return judged.filter(F.col(fits) & (F.col(score) >= 0.5)).drop(lang, score, fits)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the threshold."""
    small_batches(spark)
    ws = Workspace(spark, "pipeline-quality")
    measured = ws.save(quality.with_statistics(docs.select("doc_id", "text"), "text", "x").select("doc_id", "x"), "statistics")
    model = quality_model(measured, table(spark, sf_dir, "labels"), "x")
    score = fresh_name(docs, "quality_score")
    scored = quality.with_scores(spark, docs, None, score, model, text_col="text")
    return scored.filter(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group (five-word shingles, 0.8).

    Rows that repeat an id and its text are one document; rows without an id are all kept.
    """
    small_batches(spark)
    found = jaccard.groups(spark, docs, "doc_id", "text", n=5, percent=80)
    first = found.filter("id is not null and id = component").groupBy("id").agg(F.count("*").alias("rows"))
    again, key = fresh_name(docs, "rows"), fresh_name(docs, "kept_id")
    kept = docs.join(first.select(F.col("id").alias(key), F.col("rows").alias(again)), F.col("doc_id") == F.col(key))
    once = kept.filter(F.col(again) == 1)
    more = kept.filter(F.col(again) > 1).dropDuplicates(["doc_id", "text"])
    lone = docs.filter(F.col("doc_id").isNull())
    return once.drop(key, again).unionByName(more.drop(key, again)).unionByName(lone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a 10-word window of a benchmark item.

    Rows are matched by a digest of id and text, so null and repeated ids are judged by row.
    """
    small_batches(spark)
    ws = Workspace(spark, "pipeline-decontamination")
    key, bad = fresh_name(docs, "row_digest"), fresh_name(docs, "bad_digest")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit(""))))
    found = decontam.contamination(spark, docs.select(digest.alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key",
                                   text_col="text", item_id="item_id", item_text="text", window=10, unnamed=True)
    with arrow_rows(spark, 1):  # a row of the index is a block of texts
        hit = ws.save(found.filter(F.size("items") > 0).select(F.col("id").alias(bad)).distinct(), "hit")
    return docs.withColumn(key, digest).join(hit, F.col(key) == F.col(bad), "left_anti").drop(key)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each kept document: doc_id, n_tokens, ids."""
    small_batches(spark)
    coded = viterbi.with_ids(docs, "text", vocabulary("piece_bpe_32k.model"), only=("doc_id",), limit=200_000, keep_memo=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("quality_classifier", quality_filter), ("ngram_jaccard", near_duplicates),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Rows of a batch that a task's Python worker gets at once (all stages hand over whole texts).
BATCH_ROWS = 1000

#: Two stages are trained models; SQL cannot state them (see tests/llm/test_texts.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    with arrow_rows(spark, BATCH_ROWS):
        for k, (name, stage) in enumerate(STAGES):
            docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
