"""The given tables, and how they stand for the structure tables.

points: embeddings, the first three components as coordinates; ensembles: lineitem,
a part as contact, the line number as replicate (1 the native); sequences: events.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q: dict = {}
SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL if there is one."""

    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("structure_id"), F.col("vec_id").alias("resi"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


#: The same as a common table expression.
P_SQL = "p AS (SELECT label AS structure_id, vec_id AS resi, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def ensemble(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("resi"), F.col("l_linenumber").alias("replicate")).agg(F.avg("l_extendedprice").alias("energy"))


E_SQL = "e AS (SELECT l_partkey AS resi, l_linenumber AS replicate, avg(l_extendedprice) AS energy FROM lineitem GROUP BY ALL)"
Z_SQL = (
    E_SQL
    + """,
m AS (SELECT resi, max(CASE WHEN replicate = 1 THEN energy END) AS E_native, avg(CASE WHEN replicate <> 1 THEN energy END) AS decoy_mean,
        stddev_samp(CASE WHEN replicate <> 1 THEN energy END) AS decoy_std, count(CASE WHEN replicate <> 1 THEN energy END) AS n_decoys FROM e GROUP BY resi),
f AS (SELECT *, CASE WHEN decoy_std < 1e-9 THEN 0.0 ELSE (decoy_mean - E_native) / decoy_std END AS F_index FROM m WHERE n_decoys >= 2 AND E_native IS NOT NULL),
z AS (SELECT *, CASE WHEN F_index > 0.78 THEN 'minimally_frustrated' WHEN F_index < -1.0 THEN 'highly_frustrated' ELSE 'neutral' END AS frustration_class FROM f)"""
)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
