"""The registered queries of this package, with DuckDB SQL where it can express them."""

from pyspark.sql import functions as F

from lodestone.llm import bottom_k, crosstok, fingerprint, hard_negatives, langid, licenses, mixing, ngram_join, packing, quality, rules, sharding, toxicity
from lodestone.llm.common import documents, fold, labels


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir))


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir), fold("_id", 5) != 0)
    return toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", fold("doc_id", 5) == 0)


#: Limit of a shard in op9.
SHARD_BYTES = 4 << 20


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold("doc_id", 5) != 0, whole=True)
    rows = langid.predict(docs, model, keep=["doc_id"]).withColumn("held_out", fold("doc_id", 5) == 0)
    langid.drop_tables(model)
    return rows


def op6_document_fingerprints(spark, sf_dir):
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op9_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir), max_bytes=SHARD_BYTES)


def op5_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op8_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, labels(spark, sf_dir), fold("_id", 3) != 1)
    return quality.score(docs, model, keep=["doc_id"]).withColumn("held_out", fold("doc_id", 3) == 1)


def op3_quality_rules(spark, sf_dir):
    rows = rules.apply_policy(rules.ledger(documents(spark, sf_dir)), "v1")
    base = F.col("failed").bitwiseAND(F.lit(rules.POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def rule_ablations(spark, sf_dir):
    return rules.ablations(rules.ledger(documents(spark, sf_dir)), "v1")


def op7_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op11_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, label=label)


def op12_minhash_near_dedup(spark, sf_dir):
    return bottom_k.groups(documents(spark, sf_dir))


def op13_cross_tokenizer(spark, sf_dir):
    return crosstok.align(documents(spark, sf_dir))


def _op10_sql() -> str:
    rows = [(text, label, exact) for exact, group in (("true", licenses.PHRASES), ("false", licenses.NOTICES)) for text, label in group]
    values = ", ".join(f"('{t}', '{label}', {exact})" for t, label, exact in rows)
    return rf"""
WITH tpl(template, label, exact) AS (VALUES {values}),
tg AS (SELECT template, label, exact, len(string_split(template, ' ')) - 2 AS n_grams, i - 1 AS t_pos,
         array_to_string(string_split(template, ' ')[i:i+2], ' ') AS gram
       FROM tpl, LATERAL (SELECT unnest(range(1, len(string_split(template, ' ')) - 1)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i+2], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
v AS (SELECT doc_id, template, label, exact, n_grams, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS seen, min(pos) AS f, max(pos) AS l
      FROM dg JOIN tg USING (gram) GROUP BY ALL),
pl AS (SELECT doc_id, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS score FROM v WHERE exact AND len(seen) = n_grams),
g AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM v WHERE NOT exact WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM g),
a AS (SELECT doc_id, template, label, n_grams, span, len(list_distinct(flatten(list(seen)))) AS seen, min(f) AS start, max(l) + 3 AS stop FROM s GROUP BY ALL),
sp AS (SELECT doc_id, label, false AS exact, start, seen::DOUBLE / n_grams AS score FROM a WHERE seen::DOUBLE / n_grams >= 0.6 AND stop - start <= n_grams + 2 + 6),
p AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word, max(start) FILTER (WHERE exact) AS last_word,
        coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ','), '') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
      FROM (SELECT * FROM pl UNION ALL SELECT * FROM sp) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(CASE WHEN p IS NULL OR i - p >= 8 THEN 8 ELSE i - p END) AS n
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 15) = 0 AS kept, failed FROM f
"""

#: Every rule of the policy beside the ledger's rows.
ABLATION_SQL = "SELECT rule, count(*) FILTER (failed & bit <> 0) AS rejected, count(*) FILTER (failed & {mask} = bit) AS rejected_alone, count(*) AS documents FROM ({ledger}) x, (VALUES {used}) r(rule, bit) GROUP BY rule".format(
    mask=rules.POLICIES["v1"], ledger=OP3_SQL, used=", ".join(f"('{n}', {b}::BIGINT)" for n, b in rules.BIT.items() if b & rules.POLICIES["v1"])
)

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / greatest(0.05, 1 - (4 * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (SELECT d.*, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM r
"""

OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT doc_id, doc_id FROM documents),
r AS (SELECT x AS node, y AS far FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.far)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(far) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

OP11_SQL = """
WITH e AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


#: The same links on sets of two words.
OP12_SQL = OP1_SQL.replace("w[i:i+4]", "w[i:i+1]").replace("len(w) - 3, 2", "len(w), 2").replace("c.component_id\nFROM", "c.component_id, d.doc_id = c.component_id AS kept\nFROM")


def op9_sql(max_bytes: int) -> str:
    return rf"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS doc_bytes, lpad(bin(('0x' || substr(md5('shard|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT), {sharding.MAX_BITS}, '0') AS bits FROM documents),
s AS (SELECT k, substr(bits, 1, k) AS prefix, sum(doc_bytes)::BIGINT AS n FROM d, (SELECT unnest(range(0, {sharding.MAX_BITS + 1})) AS k) GROUP BY ALL),
f AS (SELECT doc_id, doc_bytes, bits, min(k) AS depth FROM d JOIN s ON s.prefix = substr(bits, 1, k) WHERE n <= {max_bytes} OR k = {sharding.MAX_BITS} GROUP BY ALL)
SELECT doc_id, doc_bytes, prefix, depth::INT AS depth, n AS shard_bytes, 0 AS page FROM f JOIN s ON s.k = depth AND s.prefix = substr(bits, 1, depth)
"""


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_quality_rules, op4_language_id, op5_packing, op6_document_fingerprints, op7_mixing, op8_quality_classifier, op9_sharding, op10_license_scan, op11_hard_negatives, op12_minhash_near_dedup, op13_cross_tokenizer, rule_ablations)}
ORACLE = {"op1_ngram_jaccard_join": OP1_SQL, "op9_sharding": op9_sql(SHARD_BYTES), "op3_quality_rules": OP3_SQL, "op7_mixing": OP7_SQL, "op10_license_scan": _op10_sql(), "op11_hard_negatives": OP11_SQL, "op12_minhash_near_dedup": OP12_SQL, "rule_ablations": ABLATION_SQL}
