"""Queries on pages, documents and events' properties."""

from pyspark.sql import functions as F

from lodestone.functions.scalar import has_token, slice_text
from lodestone.operators.relational import value_counts
from lodestone.plans.tables import query, table
from lodestone.sources.text import lines_of

MANIFEST_SQL = """
WITH d AS (SELECT page_id, html, string_split(html, chr(10)) AS ls FROM pages)
SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS bytes, len(ls)::BIGINT AS n_lines, contains(upper(html), '<TITLE>') AS has_title,
  CASE WHEN html = '' THEN 'EMPTY_FILE' WHEN NOT contains(upper(html), '<TITLE>') THEN 'TITLE_MISSING' ELSE 'OK' END AS status FROM d
"""


@query("manifest", MANIFEST_SQL)
def manifest(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.upper("html").contains("<TITLE>")
    status = F.when(F.col("html") == "", "EMPTY_FILE").when(~title, "TITLE_MISSING").otherwise("OK")
    return p.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"), F.size(F.split("html", "\n")).cast("long").alias("n_lines"), title.alias("has_title"), status.alias("status"))


@query("text_slices", "SELECT doc_id, trim(substr(text, 1, 6)) AS record, trim(substr(text, 13, 4)) AS name, lpad(lang, 3, ' ') || substr(text, 21, 5) AS renamed, starts_with(text, 'The') AS is_the FROM documents")
def text_slices(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", slice_text(t, 1, 6).alias("record"), slice_text(t, 13, 4).alias("name"), F.concat(F.lpad("lang", 3, " "), F.substring(t, 21, 5)).alias("renamed"), t.startswith("The").alias("is_the"))


@query("line_table", "SELECT source, count(*) AS n_lines, sum(length(l))::BIGINT AS n_chars FROM (SELECT source, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS l FROM documents) GROUP BY ALL")
def line_table(spark, sf_dir):
    x = lines_of(table(spark, sf_dir, "documents"), "text", ["source"])
    return x.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("token_search", "SELECT doc_id FROM documents WHERE regexp_matches(upper(text), '(^|[^\\p{L}\\p{N}_])LICENSE($|[^\\p{L}\\p{N}_])')")
def token_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(has_token(F.col("text"), "license")).select("doc_id")


@query("json_fields", "SELECT event_type, count(*) AS n, sum(coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), -1))::BIGINT AS total, count(*) FILTER (WHERE coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), -1) >= 50) AS high FROM events GROUP BY ALL")
def json_fields(spark, sf_dir):
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k >= 50).alias("high"))


@query("turn_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY ALL")
def turn_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "conversations"), "role")
