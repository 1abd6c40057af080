"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences.  Between stages the rows are
written as Parquet to the cluster's shared folder and read again, so a lost
executor costs tasks of one stage.

Defined results in all stages: a null text counts as empty; rows are told
apart by id and text, so a row with a null doc_id (larger than all others) and
an id with several texts are judged like any other; rows that repeat both stay
once; further columns are passed through; an empty table stays empty.  No stage
shuffles the texts of rows that it neither drops nor changes, but for a few
that share a bit of a bitmap with such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expcurve.llm import packing, simhash, suffixes, tiling, toxicity
from expcurve.llm.common import fresh, row_key, split_by_keys, stored, table, text_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold (operator 8)."""
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    score = fresh(docs, "_toxicity")
    scored, cuts = toxicity.scored_and_cut(docs, labels, score_col=score)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return toxicity.with_threshold(scored, cuts, score + "_cut").where(F.col(score) < F.col(score + "_cut")).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every SimHash group (operator 1); rows that repeat it stay once."""
    texts = stored(simhash.group_choice(docs, shingle=3, max_distance=3), "texts")
    moved = texts.where("not chosen or n > 1").select(F.xxhash64("id", "text_key").alias("key"))
    clear, touched = split_by_keys(docs, row_key(), moved)
    own_id, own_key = fresh(docs, "_id"), fresh(docs, "_key")
    once = (touched.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, text_key())
            .dropDuplicates([own_id, own_key]))
    chosen = texts.where("chosen").select(F.struct("id", "text_key").alias(fresh(once, "_chosen")))
    named = F.col(chosen.columns[0])
    same = F.col(own_id).eqNullSafe(named["id"]) & (F.col(own_key) == named["text_key"])
    return clear.unionByName(once.join(chosen, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller document has (operator 6).

    A document of which nothing is left goes; n_chars follows the text.
    """
    spans = suffixes.repeated_spans(docs)
    length = "n_chars" if "n_chars" in docs.columns else None
    return suffixes.without_spans(docs, spans, length_col=length, drop_emptied=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is found in (operator 3)."""
    leaks = stored(tiling.tiled_documents(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "doc_key").distinct(),
                   "leaks")
    clear, touched = split_by_keys(docs, row_key(), leaks.select(F.xxhash64("doc_id", "doc_key").alias("key")))
    found = leaks.select(F.struct("doc_id", "doc_key").alias(fresh(docs, "_leak")))
    named = F.col(found.columns[0])
    same = F.col("doc_id").cast("long").eqNullSafe(named["doc_id"]) & (text_key() == named["doc_key"])
    return clear.unionByName(touched.join(found, same, "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids (operator 2)."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffixes", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage but the last could be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
