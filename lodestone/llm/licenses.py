"""License scans by diagonal voting over rolling word k-grams."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, materialised

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices that may be altered in places, and their labels.
NOTICES = [
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license version", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released into the public domain", "public-domain"),
]
#: What separates words, after lower-casing.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K = 3
MOST_POSITIONS = 100_000  # of templates, that are broadcast


def template_positions(spark: SparkSession, phrases, notices) -> DataFrame:
    """One row for each k-gram of each template: of a size fixed by the arguments, which is checked."""
    rows = []
    for exact, group in ((True, phrases), (False, notices)):
        for text, label in group:
            words = text.split()
            n = len(words) - K + 1
            if n < 1:
                raise ValueError(f"a template needs {K} words at least: {text!r}")
            rows += [(len(rows), label, exact, i, n, text, " ".join(words[i : i + K])) for i in range(n)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"templates have {len(rows)} positions; {MOST_POSITIONS} at most")
    out = spark.createDataFrame(rows, "row int, label string, exact boolean, t_pos int, n_grams int, template string, gram string")
    return out.drop("row").withColumn("gram_hash", F.xxhash64(F.split("gram", " ")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, phrases=None, notices=None, coverage: float = 0.6, drift: int = 3) -> DataFrame:
    """License labels and places for each document.

    Every rolling k-gram of every whole text is hashed where it stands, and those with
    a hash of a template's are joined by hash, and compared as text, to the positions
    of the templates.  Hits of a document and template vote for their diagonal (word
    position minus template position).  A phrase stands where one diagonal has all its
    k-grams.  For a notice, diagonals at most ``drift`` apart are one span, and a span
    is verified if it holds ``coverage`` of the template's k-grams and is not much
    longer than the template.

    The templates are arguments of a bounded size, so they are broadcast; texts are
    read once and never move: one short row a document, with its hits, is written.

    Null and empty texts have no words and no label.  Rows that repeat an id and
    text get equal results; rows that share an id only are scanned on their own.
    """
    spark = docs.sparkSession
    t = template_positions(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    # The Kelvin sign is the one character that lower() would turn into an ASCII letter.
    raw = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("å")))
    words = F.filter(F.split(raw, SEPARATOR), lambda w: w != "")
    known = [r["gram_hash"] for r in t.select("gram_hash").distinct().collect()]

    def places_of(w):
        at = F.when(F.size(w) < K, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(w) - K + 1))
        hit = F.filter(at, lambda i: F.xxhash64(F.slice(w, i, K)).isin(known))
        return F.struct(F.size(w).alias("n_words"), F.transform(hit, lambda i: F.struct((i - 1).alias("pos"), F.slice(w, i, K).alias("gram"))).alias("hits"))

    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), let(words, places_of).alias("w"))
    base = materialised(base.select("doc_id", "text_hash", F.col("w.n_words").cast("long").alias("n_words"), "w.hits"))
    rolled = base.select("doc_id", "text_hash", F.inline("hits")).withColumn("gram_hash", F.xxhash64("gram")).withColumn("gram", F.array_join("gram", " "))
    hits = rolled.join(F.broadcast(t), ["gram_hash", "gram"])
    # repeated rows vote for the same template positions, which are counted once
    key = ["doc_id", "text_hash", "template", "label", "exact", "n_grams"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    places = votes.filter(F.col("exact") & (F.size("seen") == F.col("n_grams")))
    places = places.select("doc_id", "text_hash", "label", F.lit(True).alias("exact"), F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + K - 1).alias("stop"), F.lit(1.0).alias("score"))
    w = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    spans = votes.filter(~F.col("exact")).withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > drift).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(w))
    spans = spans.groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"), F.min("first").alias("start"), (F.max("last") + K).alias("stop"))
    spans = spans.withColumn("score", F.col("seen") / F.col("n_grams"))
    spans = spans.filter((F.col("score") >= coverage) & (F.col("stop") - F.col("start") <= F.col("n_grams") + K - 1 + 2 * drift))
    found = places.unionByName(spans.select("doc_id", "text_hash", "label", "exact", "start", "stop", "score"))
    start = F.when(F.col("exact"), F.col("start"))
    per = found.groupBy("doc_id", "text_hash").agg(
        F.count_if("exact").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_set(F.struct("start", "stop", "label"))).alias("spans"),
    )
    rows = base.select("doc_id", "text_hash", "n_words").alias("d")
    out = rows.join(per.hint("merge").alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select("d.doc_id", "n_words", none("n_base", 0), F.col("first_word").cast("long"), F.col("last_word").cast("long"), none("base_labels", ""), none("labels", ""), none("score", 0.0), "spans")
