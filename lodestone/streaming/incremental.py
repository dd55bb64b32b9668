"""Work that goes on where it stopped: work lists, running moments, skipped files."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import three_way, z_score


def work_list(wanted: DataFrame, present: DataFrame, keys) -> DataFrame:
    """Requested (structure, replicate) keys that no result has yet."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct().hint("merge"), list(keys), "left_anti")


def moments(values: DataFrame, keys, value: str = "energy") -> DataFrame:
    """(n, mean, m2): states of parts that merge to the state of the whole; m2 is the sum of squared distances from the mean.

    Squares of the values themselves are never summed, so large values of small spread
    keep their digits.
    """
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_moments(parts: DataFrame, keys) -> DataFrame:
    """Means are merged as distances from the key's smallest, and each part's own distance from the merged mean is added."""
    w = Window.partitionBy(*keys)
    p = parts.filter("n > 0").withColumn("_low", F.min("mean").over(w))
    p = p.withColumn("_mean", F.col("_low") + F.sum(F.col("n") * (F.col("mean") - F.col("_low"))).over(w) / F.sum("n").over(w))
    far = F.col("mean") - F.col("_mean")
    return p.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * far * far).alias("m2"))


def from_moments(state: DataFrame) -> DataFrame:
    """Mean and sample deviation; NULL deviation below two values."""
    return state.withColumn("sd", F.when(F.col("n") >= 2, F.sqrt(F.try_divide("m2", F.col("n") - 1))))


# ---- states saved as deltas: a folder a batch, which counts once it is whole ----


def _folders(spark: SparkSession, sink: str, kind: str) -> list[int]:
    """Numbers of the whole folders of a kind: those that a writer has marked as done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def save(state: DataFrame, sink: str, number: int, kind: str = "batch", replicates: Sequence[int] = ()) -> None:
    """One delta, with the replicates it holds.  A run that was killed while it wrote leaves a folder without a mark, which the next replaces."""
    rows = state.withColumn("replicates", F.array(*map(F.lit, replicates)).cast("array<int>"))
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{sink}/{kind}={number:012d}")


def _saved(spark: SparkSession, sink: str) -> DataFrame | None:
    """Rows of the last snapshot and of the batches after it."""
    base, batches = _folders(spark, sink, "base")[-1:], _folders(spark, sink, "batch")
    parts = [f"{sink}/base={n:012d}" for n in base] + [f"{sink}/batch={n:012d}" for n in batches if not base or n > base[0]]
    return spark.read.parquet(*parts) if parts else None


def saved_replicates(spark: SparkSession, sink: str) -> set[int]:
    """Replicates that are saved whole; the driver gets a row a batch since the last snapshot."""
    rows = _saved(spark, sink)
    return {k for r in rows.select("replicates").distinct().collect() for k in r[0]} if rows is not None else set()


def saved_state(spark: SparkSession, sink: str, keys) -> DataFrame:
    """The merged state of all that is saved."""
    rows = _saved(spark, sink)
    if rows is None:
        raise ValueError(f"nothing is saved in {sink}")
    return merge_moments(rows, keys)


def snapshot(spark: SparkSession, sink: str, keys) -> None:
    """Merges all batches up to the last into one table; the batches stay, and are not read once it is whole."""
    batches = _folders(spark, sink, "batch")
    if batches and batches[-1:] != _folders(spark, sink, "base")[-1:]:
        save(saved_state(spark, sink, keys), sink, batches[-1], "base", sorted(saved_replicates(spark, sink)))


def run_saved(spark: SparkSession, replicates: Sequence[int], score: Callable[[Sequence[int]], DataFrame], sink: str, keys, value: str = "energy", every: int = 10) -> DataFrame:
    """Scores the replicates that are not saved yet, saves after every ``every`` of them, and returns the state of all.

    A run that was stopped repeats at most the batch that it was in; more replicates,
    of any number, can follow later.
    """
    done = saved_replicates(spark, sink)
    missing = [r for r in sorted(set(replicates)) if r not in done]
    number = max(_folders(spark, sink, "batch"), default=0)
    for at in range(0, len(missing), every):
        number += 1
        some = missing[at : at + every]
        save(moments(score(some), keys, value), sink, number, replicates=some)
    return saved_state(spark, sink, keys)


def stream_saved(stream: DataFrame, sink: str, checkpoint: str, keys, value: str = "energy") -> None:
    """Takes all files that are there, a delta a batch; a batch that is run again replaces its own delta."""

    def put(batch: DataFrame, number: int) -> None:
        save(moments(batch, keys, value), sink, number)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def stream_moments(spark: SparkSession, path: str, schema, keys, value: str, max_files: int = 1, glob: str = "*.parquet") -> DataFrame:
    """Running mean and deviation as replicate files arrive: state is one row a key.

    There is no event time, so no watermark: the state is bounded by the keys.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(path)
    return s.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Takes all files that are there and replaces the result table with each batch."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def score_from_state(native: DataFrame, state: DataFrame, keys, value: str = "energy") -> DataFrame:
    """F index and class of natives against the moments so far."""
    j = native.join(state.filter("n >= 2").hint("merge"), list(keys))
    j = j.withColumn("F_index", z_score(F.col("mean"), F.col(value), F.col("sd")))
    return j.withColumn("frustration_class", three_way(F.col("F_index")))


def skip_present(manifest: DataFrame, landed: DataFrame, key: str = "structure_id") -> DataFrame:
    """Files whose checksum is known keep their verification and are marked as skipped; failed ones are not."""
    j = landed.join(manifest.select(key, F.col("sha256").alias("known"), F.col("status").alias("known_status")), key, "left")
    same = (F.col("known") == F.col("sha256")) & (F.col("known_status").isin("OK", "SKIPPED_ALREADY_PRESENT"))
    return j.withColumn("status", F.when(same, "SKIPPED_ALREADY_PRESENT").otherwise(F.col("status"))).drop("known", "known_status")
