"""The training-data pipeline: each stage works on all that the one before kept.

Stages: quality classifier, language identification, n-gram Jaccard join, benchmark
decontamination, packing. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, jaccard, langid, packing, quality_fm, tokens

#: Word shingles of the near-duplicate stage and the similarity, in percent, from which documents link.
SHINGLE, SIMILAR = 5, 80
#: Documents whose quality score is below are rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the labelled ones, does not reject.

    Cases: a null or empty text is scored like any other, by its structure; rows that share an id
    are scored each by its own text; repeated rows stay or go together; a score of exactly
    LEAST_QUALITY stays; no labels or no documents reject nothing; all columns, whatever their names, stay.
    """
    model = quality_fm.train(docs, common.table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).where(F.col("quality_score") >= LEAST_QUALITY).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the confidence that calibration asks for.

    Cases: a text that is null, empty or without a letter has no language and is rejected; rows with
    a null lang are judged but teach nothing; repeated rows stay or go together; a confidence of
    exactly the one asked for stays; without any labelled row every text is rejected; all columns stay.
    """
    return langid.predict(docs, langid.train(docs)).where(~F.col("lang_rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id, a missing one last.

    Cases: each row is judged by its own text, so rows that share an id but not a text are different
    documents; of rows that share both one stays; texts without words are linked with nothing; an
    empty table stays empty; all columns stay.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("__key"), docs["doc_id"].alias("__id"), docs["text"].alias("__text"))
    links = common.written(jaccard.jaccard_links(keyed.drop("__id"), width=SHINGLE, percent=SIMILAR, id_column="__key", text_column="__text"), "links")
    told = links.select(F.col("doc_id").alias("__key"), "component_id").distinct()
    groups = common.written(told.groupBy("component_id").count().where("count > 1").select("component_id"), "groups")
    named = keyed.select("__key", "__id").distinct()
    grouped = common.written(told.join(groups, "component_id", "left_semi").join(named, "__key"), "grouped")
    heads = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key"))).alias("head"))
    copies = common.written(grouped.join(heads, "component_id").where("__key <> head.__key").select(F.col("__key").alias("__copy")).distinct(), "copies")
    copies = common.bounded_broadcast(copies, copies.count())
    kept = docs.join(copies, key == copies["__copy"], "left_anti")
    if links.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Cases: null and empty texts hold nothing and stay; rows that share an id, or have none, are judged
    each by its own text; repeated rows stay or go together; without items or documents nothing
    goes; items of a few words are not looked for (see the operator); all columns stay.
    """
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens.

    Cases: a null or empty text is its end token; longer documents are cut, repeated rows are packed
    each; a missing id is carried; an empty table gives no pieces; other columns are not read.
    """
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained models have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
