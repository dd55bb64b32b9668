"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, as
Parquet read again.  All but the last return the columns of ``documents``.  An empty
table gives an empty table; null texts, ids and sources are as each stage says.  Rows
are passed on as one struct, so no column can clash with an operator's.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, ngram_join, packing, quality
from lodestone.llm.common import documents, labels, materialised


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It is learned from the labelled ones among ``docs``.  Null and empty texts are scored
    as such; repeated rows share their fate; without labels of both classes all stay.
    """
    model = quality.fit(docs, labels(spark, sf_dir), F.lit(True))
    rows = quality.score(docs.withColumn("row", F.struct(*docs.columns)), model, keep=["row"])
    return rows.filter("predicted = 1").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and misfits go.

    Models come from all rows with a language, and have all of their grams.  Repeated rows share their fate; without
    any language known, none stays.
    """
    model = langid.fit(docs, F.lit(True), whole=True)
    rows = langid.predict(docs.withColumn("row", F.struct(*docs.columns)), model, keep=["row"])
    langid.drop_tables(model)
    return rows.filter(~F.col("rejected")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id (of a repeated id, the smallest text hash).

    Rows without words are in no group and stay.  Rows that repeat both id and text
    are one document, which stays once; rows that share only an id are told apart.
    """
    groups = ngram_join.grouped(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash"))
    first = groups.filter("component is not null").groupBy("component").agg(F.min(row).alias("r")).select("r.*")
    first = first.unionByName(groups.filter("component is null").select(row.alias("r")).select("r.*").distinct())
    key = ["no_id", "id", "text_hash"]
    marked = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"))
    # the join deals rows by the key already, so dropping repeats moves no text again
    kept = marked.join(first.hint("merge"), key, "left_semi").dropDuplicates(key)
    return kept.select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: whole epochs, then a part; the last one cut.

    Null sources are one source; texts without a word are not taken; repeated rows count each.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near duplicates", one_of_each_group), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialised(docs)
    return docs
