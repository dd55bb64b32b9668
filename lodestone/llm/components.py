"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, tidy


FEW_EDGES = 100_000  # of which the labels may be broadcast
TASK_EDGES = 1 << 13  # of few edges those that a task takes


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); the component is its smallest node.

    Each round every node hands its smallest neighbour to its larger neighbours,
    then to its smaller ones, by aggregates and joins on the node, until edges
    stay the same: a number of rounds that grows with the logarithm of the
    longest path.  Rounds are written to the shared folder.  No edges: no rows.
    Labels of few edges are broadcast, and few tasks take them, however many
    partitions a shuffle has.
    """
    e = materialised(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())

    def state(df):
        with tidy(df.sparkSession):
            return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()

    last = state(e)
    for _ in range(most_rounds):
        few = last["n"] <= FEW_EDGES
        fit = (lambda df: df.coalesce(1 + last["n"] // TASK_EDGES)) if few else (lambda df: df)  # noqa: B023
        side = (lambda df: F.broadcast(fit(df))) if few else (lambda df: df)  # noqa: B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(side(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = materialised(fit(large)) if few else large
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(side(low), "a")
        small = small.select("a", "m").unionByName(small.select(F.col("b").alias("a"), "m")).select("a", F.col("m").alias("b"))
        new = materialised(fit(small.filter("a > b").distinct()))
        now = state(new)
        drop_written(e, *([large] if few else []))
        e = new
        if now == last:
            roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            return fit(roots).unionByName(fit(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
        last = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
