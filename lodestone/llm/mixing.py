"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialised, refuse_clash
from lodestone.operators.stats import rank

#: Key buckets for each step of e in the key.
BUCKETS = 200


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """Share of word-like characters, 0.05 to 1: symbols pull a document's weight down."""
    marks = F.coalesce(F.regexp_count(F.col(text), F.lit("[#*$%&|<>!]")), F.lit(0))
    chars = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 4 * marks.cast("double") / chars)


def uniform(seed: str, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only, so reruns agree."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, max_epochs: float, most_rounds: int = 100) -> DataFrame:
    """Targets of sources (source, source_size): the whole size shared by weight 1, 2, 3, repeating.

    A target stops at ``max_epochs`` times its source's size; the excess goes to the
    others by weight.  Each round sums what is capped at the present water level and
    finds the next level, which only rises, until the same sources are capped.  Ranks
    and sums are distributed, so there may be as many sources as there are hosts.
    """
    # code points in UTF-8 order; null sources are behind all others
    order = F.when(F.col("source").isNotNull(), F.lit("0")).otherwise(F.lit("1"))
    w = rank(sizes.withColumn("_order", F.concat(order, F.coalesce("source", F.lit("")))), "_order", ties="min", out="_rank").drop("_order")
    w = w.withColumn("weight", ((F.col("_rank") - 1) % 3 + 1).cast("double")).drop("_rank")
    w = materialised(w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    total = w.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, before = 0.0, None
    for _ in range(most_rounds):
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        now = w.agg(F.count_if(capped).alias("n"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if before is not None and now["n"] == before or not now["weight"]:
            break
        level, before = (total - now["cap"]) / now["weight"], now["n"]
    else:
        raise RuntimeError(f"targets did not settle in {most_rounds} rounds")
    return w.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, seed: str = "mix", max_epochs: float = 3.0, keep=(), most_broadcast: int = 200_000) -> DataFrame:
    """Rows of ``docs`` with how many of their words a mixture takes.

    Each source's target buys ``floor(target / size)`` complete epochs; the rest
    goes to its documents in order of exponential keys ``-ln(u) / weight``, whole
    until the budget ends within one document, of which the remaining words are
    taken.  So a source's taken words are its target, rounded down.

    The order within a source is a running sum over key buckets first, then one
    within the bucket in which the budget ends.  Buckets are steps of the key's
    logarithm, whose spread is the same for all weights: none has over about 0.2 % of
    the documents of one weight, so no task gets a whole source.

    Null texts have size 0 and take 0; null sources are one source, the last;
    rows with equal ids share a key and count each; an empty table gives none.
    Returns doc_id, source, size, weight, source_size, target, epochs, part, taken and
    ``keep``; columns of ``keep`` must not have one of these names or ``key``, ``bucket``,
    ``before_bucket``, ``bucket_size``, ``budget``, ``before`` (an error).
    """
    refuse_clash([c if isinstance(c, str) else "" for c in keep], "doc_id", "source", "size", "weight", "source_size", "target", "epochs", "part", "taken", "key", "bucket", "before_bucket", "bucket_size", "budget", "before")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), quality_weight(text).alias("weight"), *keep)
    d = d.withColumn("key", -F.ln(uniform(seed, "doc_id")) / F.col("weight"))
    d = d.withColumn("bucket", F.floor(F.ln("key") * BUCKETS).cast("int"))
    sums = materialised(d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = sums.alias("s").join(goal.alias("g"), same("s", "g")).select("s.*", "source_size", "target", "epochs", "budget")
    plan = materialised(plan)
    # a row for each source and bucket: broadcast only if they are few, else merged
    plan = F.broadcast(plan) if plan.count() <= most_broadcast else plan.hint("merge")
    out = d.alias("d").join(plan.alias("p"), same("d", "p") & (F.col("d.bucket") == F.col("p.bucket")))
    out = out.select("d.*", *[f"p.{c}" for c in ("before_bucket", "bucket_size", "source_size", "target", "epochs", "budget")])
    ends_here = (F.col("before_bucket") < F.col("budget")) & (F.col("before_bucket") + F.col("bucket_size") > F.col("budget"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = out.filter(ends_here).withColumn("before", F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    whole = F.when(F.col("before_bucket") < F.col("budget"), F.col("size")).otherwise(0)
    cols = ["doc_id", "source", "size", "weight", "source_size", "target", "epochs", *keep]
    out = out.filter(~ends_here).select(*cols, whole.cast("long").alias("part")).unionByName(split.select(*cols, part.cast("long").alias("part")))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each epoch that takes a document.

    A document in which a source's budget ends is cut after the words that are taken.
    """
    row = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    m = mix(row, **options, keep=["row"])
    words = F.filter(F.split(F.col("row")[text], "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("part") == F.col("size"), F.col("row")[text]).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " "))
    copies = F.concat(F.array_repeat(F.col("row")[text], F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = m.select("row", F.explode(copies).alias("copy"))
    return out.select(*[F.col("copy").alias(c) if c == text else F.length("copy").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
