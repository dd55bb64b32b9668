"""Sharding by extendible hashing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, refuse_clash

#: Bits by which the directory grows in one pass over what is still too large.
STEP = 12
MAX_BITS = 48


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, max_bytes: int, seed: str = "shard", keep=()) -> DataFrame:
    """Assigns each document to the bucket of its hash prefix; buckets over ``max_bytes`` split on one more bit.

    A directory entry is the shortest prefix whose documents fit.  Each pass sums
    bytes for prefixes of 12 more bits, only for what is still too large, and
    rolls the sums up to find where each prefix first fits; sums are pre-aggregated,
    and passes end when all fit.  Documents and directory meet by a join on the
    prefix.  A document larger than the limit ends alone in an oversized shard;
    rows that no bit tells apart (equal ids and texts) and that exceed the limit
    together go to numbered overflow pages, a fixed number to a page.

    Texts are hashed once, into a written table of short rows, which later passes read;
    ``keep`` meets the result by the hash, in one shuffle.

    Null and empty texts have 0 bytes.  An empty table gives no rows.  Rows that repeat
    count each; the result has a row for each row.
    Returns doc_id, doc_bytes, prefix (bits as text), depth, page, shard_bytes (of the
    page) and ``keep``, whose columns must not have one of these names or ``bits``.
    """
    spark = docs.sparkSession
    refuse_clash(list(keep), "doc_id", "doc_bytes", "prefix", "depth", "page", "shard_bytes", "bits")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), body).cast("binary"))
    bits = F.lpad(F.conv(F.substring(digest, 1, MAX_BITS // 4), 16, 2), MAX_BITS, "0")
    short = [F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("doc_bytes"), bits.alias("bits")]
    d = materialised(docs.select(*short))
    total = d.agg(F.coalesce(F.sum("doc_bytes"), F.lit(0)).alias("n")).first()["n"]
    entries, rest, depth = None, d, 0
    if total <= max_bytes:
        entries = spark.createDataFrame([("", 0, total)], "prefix string, depth int, shard_bytes long")
    while entries is None or rest is not None:
        cells = rest.groupBy(F.substring("bits", 1, depth + STEP).alias("cell")).agg(F.sum("doc_bytes").alias("n"))
        # each cell at each of the next depths; the sums of a prefix are over its cells
        up = cells.select("cell", "n", F.explode(F.sequence(F.lit(depth), F.lit(depth + STEP))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        sums = up.groupBy("prefix", "depth").agg(F.sum("n").alias("shard_bytes"))
        fits = sums.filter((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == MAX_BITS))
        # the shortest prefix that fits: its parent does not
        parent = sums.select(F.col("prefix").alias("up"), F.col("shard_bytes").alias("up_bytes"))
        found = fits.withColumn("up", F.expr("substring(prefix, 1, depth - 1)")).join(parent.hint("shuffle_hash"), "up").filter((F.col("up_bytes") > max_bytes) & (F.col("depth") > depth))
        found = found.select("prefix", F.col("depth").cast("int").alias("depth"), "shard_bytes")
        entries = found if entries is None else entries.unionByName(found)
        depth += STEP
        large = sums.filter((F.col("depth") == depth) & (F.col("shard_bytes") > max_bytes)).select(F.col("prefix").alias("cell"))
        if depth >= MAX_BITS or large.isEmpty():
            rest = None
        else:
            rest = rest.withColumn("cell", F.substring("bits", 1, depth)).join(large.hint("shuffle_hash"), "cell", "left_semi").drop("cell")
    # a document looks its entry up at the depths that the directory has
    depths = [r["depth"] for r in entries.select("depth").distinct().collect()]
    entries = materialised(entries)
    probes = F.transform(F.array(*[F.lit(x) for x in sorted(depths)]), lambda k: F.substring(F.col("bits"), F.lit(1), k))
    if depths:
        located = d.withColumn("prefix", F.explode(probes)).join(entries.hint("shuffle_hash"), "prefix")
    else:
        located = d.withColumns({"prefix": F.lit(""), "depth": F.lit(0), "shard_bytes": F.lit(0).cast("long")})
    if keep:
        of = located.groupBy("bits").agg(*[F.first(c).alias(c) for c in ("prefix", "depth", "shard_bytes")])
        located = docs.select(*short, *keep).join(of.hint("merge"), "bits")
    full = F.col("depth") == MAX_BITS
    # rows that no bit tells apart are equal, so a page has a fixed number of them
    w = Window.partitionBy("prefix")
    most = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.max("doc_bytes").over(w), F.lit(1))))
    page = F.floor((F.row_number().over(w.orderBy("doc_id")) - 1) / most).cast("int")
    paged = located.filter(full).withColumn("page", page).withColumn("shard_bytes", F.sum("doc_bytes").over(Window.partitionBy("prefix", "page")))
    cols = ["doc_id", "doc_bytes", "prefix", "depth", "shard_bytes", *keep, "page"]
    return located.filter(~full).withColumn("page", F.lit(0)).select(*cols).unionByName(paged.select(*cols))


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards as Parquet, one folder a shard; hot shards stay one folder of several files."""
    rows = shard(docs, keep=[c for c in docs.columns if c != options.get("doc_id", "doc_id")], **options)
    rows.repartition("prefix", "page").write.partitionBy("prefix", "page").parquet(path)
