"""A corpus pipeline of five stages over `documents`.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; a stage's rows are written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents; text and n_chars follow what a stage took out.  A document whose lines or bytes
all recur stays as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import line_dedup, ngram_join, packing, quality, substrings
from panelforge.llm.common import durable
from panelforge.llm.queries import held_out, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def unique_ids(docs: DataFrame) -> DataFrame:
    """docs with `row`, an order-preserving number: doc_id itself where ids are unique and not null."""
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if not odd:
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    sorted_ = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return durable(sorted_.withColumn("row", F.monotonically_increasing_id()))


def numbered(docs: DataFrame) -> DataFrame:
    """docs under their row numbers, the own id kept as `own`; other columns are put aside."""
    docs = unique_ids(docs.select(*COLUMNS))
    return docs.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("own"), "lang", "source")


def restored(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with a new text."""
    return docs.withColumn("text", text).select(F.col("own").alias("doc_id"), "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labels' training fold, does not reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.fit(docs, labels)).where("score >= 0.3").drop("score")


def line_edit_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand, equal or nearly so, earlier in the corpus."""
    out = line_dedup.dedup_lines(numbered(docs), carry=("own", "lang", "source"), min_copy=1)
    return restored(out, F.col("text"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies."""
    docs = unique_ids(docs.select(*COLUMNS))
    found = ngram_join.ngram_components(docs.select(F.col("row").alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("row"))
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out bytes under 200-byte strings that recur; a character cut in two goes whole."""
    out = substrings.remove_substrings(numbered(docs), carry=("own", "lang", "source"))
    return restored(out, whole_characters(F.col("kept")))


def whole_characters(kept):
    """The bytes as text: what is no UTF-8 becomes U+FFFD, which is then taken out."""
    return F.when(F.is_valid_utf8(kept.cast("string")), kept.cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "�", ""))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_edit_join),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
