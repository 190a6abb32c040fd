"""A training corpus from raw documents, stage by stage.

Every stage is one operator of zonewatch.llm, works on all that the stage before kept, and is
written as Parquet and read again before the next. Each takes (spark, docs, sf_dir); all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.llm import langid, linedup, lshforest, packing, toxicity
from zonewatch.llm.common import fresh, prepare, save, table, text_crc


def _whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): operators hand the whole row on as their id, so no column of it can clash with theirs."""
    return docs.select(F.struct("*").alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely toxic than not go. Null and empty texts have no toxic feature and stay;
    rows that repeat are judged alike; without labels of both kinds all are judged by the share of toxic ones."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 4 != 2)
    return toxicity.score(_whole_rows(docs), model, "row", threshold=0.5).where("predicted = 0").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too) go, and those that no learned language fits
    much better than the others. Rows that repeat are judged alike; with no language to learn all go."""
    prepare(spark)
    model = langid.fit(docs, text_crc(F.col("doc_id")) % 3 != 1)
    return langid.predict(_whole_rows(docs), model, "row").where("lang_pred <> 'und' AND score >= 0.4").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; all documents stay. A null text becomes empty; rows of
    one doc_id are one document; one without a doc_id keeps its lines. n_chars, where there is one,
    is counted anew."""
    kept = linedup.drop_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays: the smallest doc_id's, of several such rows one,
    one without a doc_id only where no row has one. Texts without a word, null or empty, all stay."""
    prepare(spark)
    number = fresh(docs, "row_number")
    rows = save(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(number).alias("number"))
    kept = lshforest.near_duplicates(rows.select(key.alias("key"), "text"), "key").where("kept").select(F.col("id.number").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens. A null or empty text is
    its closing id alone; rows that repeat are packed each by itself. No documents give no rows."""
    import public_tokenizers as P

    prepare(spark)
    pieces = packing.pieces(docs, P.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, "doc_id", "piece").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: Models and near-duplicate components aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
