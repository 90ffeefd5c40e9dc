"""A training corpus from raw documents: quality, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import language_id, ngram_jaccard, packing, quality_classifier, substring_dedup
from granary.llm.common import read, settle

#: Languages that the network is this unsure of are no language that it learnt.
LEAST_LANGUAGE_SCORE = 0.35


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name of an operator's meets a user's."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("own")).alias("others"))


def together(found: DataFrame, columns: list[str], **made: Column) -> list[Column]:
    """The columns of documents as they were, or as made."""
    own = lambda c: found[c] if c in ("doc_id", "text") else F.col("others").getField("own").getField(c)
    return [made.get(c, own(c)).alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any text; repeated rows each stay or go alike; an empty table, or one without a
    label, keeps what the calibration without examples keeps. Columns stay as they are, whatever their names.
    """
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    found = quality_classifier.score(apart(docs), model).where("predicted = 1")
    return found.select(together(found, docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that was learnt, go.

    Null texts have no letter; repeated rows go alike; where nothing could be learnt, no document stays. Columns stay as
    they are, whatever their names.
    """
    model = language_id.fit(docs)
    found = language_id.predict(apart(docs), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(together(found, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near copies (five-word shingles, similarity 0.8 or more), the smallest doc_id stays.

    Rows with one doc_id are one document: if it stays, each of its texts stays, once. Texts without words link with
    nothing; rows with a null doc_id stay. Columns stay as they are, whatever their names.
    """
    found = ngram_jaccard.join(docs, ngram_jaccard.JaccardParams(words=5, percent=80))
    stay = found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("doc_id = least").select(F.col("doc_id").alias("stays"))
    rows = apart(docs)
    kept = rows.join(stay, F.col("doc_id") == F.col("stays"), "left_semi").dropDuplicates(["doc_id", "text"])
    kept = kept.union(rows.where("doc_id is null"))
    return kept.select(together(kept, docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has as well are cut out.

    Null and empty texts stay as they are, as do rows with a null doc_id; rows with one doc_id keep what only they share.
    n_chars, where there is such a column, follows the text; all others stay as they are.
    """
    cut = substring_dedup.dedup(apart(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col("others").getField("own").getField("n_chars"))
    return cut.select(together(cut, docs.columns, **made))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of pieces of like length; rows without words are a piece of no tokens, repeated rows one each."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("packing", packed)]

#: The classifiers are trained models, which SQL does not express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}")
    return docs
