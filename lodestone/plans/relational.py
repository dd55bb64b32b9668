"""Queries on orders, parts, lines and events: selection, joins, sets, checks."""

from pyspark.sql import functions as F

from lodestone.functions.scalar import inequality, log10_floor, to_picomolar
from lodestone.operators import relational as R
from lodestone.operators import selection, stats
from lodestone.plans.tables import query, rounded, table
from lodestone.streaming import incremental

#: A total order of line items, whose keys repeat.
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("altloc_best", "WITH r AS (SELECT l_orderkey, l_returnflag, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_discount DESC, l_partkey * 1000000 + l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) - 1 AS n_dropped FROM lineitem) SELECT l_orderkey, l_returnflag, l_discount, n_dropped FROM r WHERE rn = 1")
def altloc_best(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("altloc"), F.col("l_discount").alias("occupancy"), (F.col("l_partkey") * 1000000 + F.col("l_extendedprice")).alias("line_no"))
    best = selection.best_alternative(li, ("l_orderkey",))
    return best.select("l_orderkey", F.col("altloc").alias("l_returnflag"), F.col("occupancy").alias("l_discount"), "n_dropped")


BAND_SQL = """
WITH d AS (SELECT l_orderkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice, min(l_quantity) OVER (PARTITION BY l_orderkey) AS lo FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem)),
n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n_equal, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax, l_discount DESC, l_quantity, l_suppkey, l_extendedprice) AS rn FROM d WHERE l_quantity <= lo + 1.0)
SELECT l_orderkey, l_suppkey, l_quantity, n_equal FROM n WHERE rn = 1
"""


@query("tie_band_best", BAND_SQL)
def tie_band_best(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").distinct()
    best = selection.in_band(li, ["l_orderkey"], "l_quantity", 1.0, [F.col("l_tax"), F.col("l_discount").desc(), F.col("l_quantity"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return best.select("l_orderkey", "l_suppkey", "l_quantity", "n_equal")


@query("dedupe_priority", "WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority NULLS LAST, o_totalprice NULLS LAST, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM r WHERE rn = 1")
def dedupe_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority", "o_totalprice")
    return selection.keep_first(o, [F.col("o_orderpriority").asc_nulls_last(), F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")], ["o_custkey", "o_orderstatus"]).drop("o_totalprice")


@query("arg_extremes", "SELECT l_partkey, arg_min(l_suppkey, l_extendedprice * 1000 + l_suppkey) AS low_supp, arg_max(l_suppkey, l_extendedprice * 1000 + l_suppkey) AS high_supp FROM lineitem GROUP BY ALL")
def arg_extremes(spark, sf_dir):
    v = F.col("l_extendedprice") * 1000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", v).alias("low_supp"), F.max_by("l_suppkey", v).alias("high_supp"))


@query("candidates", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) / 6 FROM customer))")
def candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    inventory = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    prepared = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, "OK").otherwise("FAILED").alias("status"))
    total = c.agg(F.count("*").alias("t"))
    validated = c.groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("c_mktsegment", F.when(F.col("n") > F.col("t") / 6, "OK").otherwise("FEW").alias("status"))
    return R.candidates(inventory, prepared, validated, "o_custkey", "c_mktsegment").select("o_orderkey", "o_custkey", "c_mktsegment")


READY_SQL = """
SELECT p_partkey, CASE WHEN p_size > 10 THEN 'OK' ELSE 'SMALL' END AS size_status, s.status AS sold_status, coalesce(p_size > 10 AND s.status = 'OK', false) AS ready
FROM part LEFT JOIN (SELECT l_partkey, CASE WHEN count(*) >= 25 THEN 'OK' ELSE 'FEW' END AS status FROM lineitem WHERE l_returnflag = 'R' OR l_tax > 0.02 GROUP BY 1) s ON l_partkey = p_partkey
"""


@query("readiness", READY_SQL)
def readiness(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = p.select("p_partkey", F.when(F.col("p_size") > 10, "OK").otherwise("SMALL").alias("status"))
    sold = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' OR l_tax > 0.02").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.when(F.count("*") >= 25, "OK").otherwise("FEW").alias("status"))
    return R.readiness(p.select("p_partkey"), {"size": size, "sold": sold}, "p_partkey")


@query("missing_ids", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_ids(spark, sf_dir):
    present = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_keys(table(spark, sf_dir, "customer"), present, ["c_custkey"])


INTERVAL_SQL = """
WITH r AS (SELECT l_suppkey AS k, l_linenumber AS o, min(l_partkey)::BIGINT AS beg, (count(*) * 2)::BIGINT AS length, (l_linenumber * 10000)::BIGINT AS ref_beg FROM lineitem GROUP BY 1, 2),
p AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS pos FROM lineitem),
j AS (SELECT p.k, p.pos, ref_beg + pos - beg AS mapped, row_number() OVER (PARTITION BY p.k, p.pos ORDER BY o) AS rn FROM p JOIN r ON p.k = r.k AND pos BETWEEN beg AND beg + length - 1)
SELECT p.k, p.pos, mapped FROM p LEFT JOIN j ON j.k = p.k AND j.pos = p.pos AND rn = 1
"""


@query("interval_map", INTERVAL_SQL)
def interval_map(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = li.groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("o")).agg(F.min("l_partkey").alias("beg"), (F.count("*") * 2).alias("length")).withColumn("ref_beg", (F.col("o") * 10000).cast("long"))
    p = li.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("pos")).distinct()
    return R.interval_map(p, r, ["k"], "pos", ["o"])


FALLBACK_SQL = """
WITH a AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS x, o_totalprice AS v FROM orders),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'F' END AS x FROM customer),
m AS (SELECT b.k, b.x, v FROM b JOIN a ON a.k = b.k AND a.x = b.x)
SELECT k, x, v FROM m UNION ALL SELECT b.k, b.x, a.v FROM b LEFT JOIN a ON a.k = b.k AND a.x = '' WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = b.k)
  AND (a.v IS NOT NULL OR NOT EXISTS (SELECT 1 FROM a a2 WHERE a2.k = b.k))
"""


@query("fallback_match", FALLBACK_SQL)
def fallback_match(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("x"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "P").otherwise("F").alias("x"))
    return R.match_or_blank(b, a, ["k"], "x", "v")


@query("union_absent", "SELECT o_custkey AS k, 'order' AS origin FROM orders UNION ALL SELECT c_custkey, 'known' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def union_absent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin"))
    return R.append_absent(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("known").alias("origin")), ["k"])


NAMES_SQL = """
WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 40 AS name FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 40 AS name FROM lineitem WHERE l_linenumber >= 6),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, b.k IS NULL AS oa, a.k IS NULL AND coalesce(a.name, b.name) % 10 <> 0 AS ob FROM a FULL JOIN b ON a.k = b.k AND a.name = b.name)
SELECT k, count(*) FILTER (WHERE oa) AS n_only_a, count(*) FILTER (WHERE ob) AS n_only_b, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE oa), '') AS only_a, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE ob), '') AS only_b, bool_and(NOT oa AND NOT ob) AS all_match FROM j GROUP BY k
"""


@query("name_reconcile", NAMES_SQL)
def name_reconcile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 40).alias("name"), "l_linenumber")
    return R.name_reconciliation(li.filter("l_linenumber <= 2"), li.filter("l_linenumber >= 6"), ["k"], "name", ignore_extra=F.col("name") % 10 == 0)


CHECKS = {"qc_open": "o_orderstatus = 'P'", "qc_urgent": "o_orderpriority LIKE '1%'", "qc_large": "o_totalprice > 400000", "qc_early": "o_orderdate < TIMESTAMP '1993-01-01'", "qc_small": "o_totalprice < 5000", "qc_low": "o_orderpriority LIKE '5%' AND o_orderstatus = 'F'", "qc_none": "o_orderkey < 0"}


@query("qc_split", " UNION ALL ".join(f"SELECT '{n}' AS qc_name, o_orderkey FROM orders WHERE {t}" for n, t in CHECKS.items()))
def qc_split(spark, sf_dir):
    return R.qc_split(table(spark, sf_dir, "orders"), {n: F.expr(t) for n, t in CHECKS.items()}, ["o_orderkey"])


@query("review_flags", "SELECT o_orderkey, o_totalprice > 300000 OR o_orderstatus = 'P' OR o_orderpriority LIKE '1%' AS manual_review_required, concat_ws(' | ', CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END) AS notes FROM orders")
def review_flags(spark, sf_dir):
    o = R.review(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 300000, "large"), (F.col("o_orderstatus") == "P", "open"), (F.col("o_orderpriority").startswith("1"), "urgent"))
    return o.select("o_orderkey", "manual_review_required", "notes")


@query("status_counts", "SELECT CASE WHEN o_totalprice > 300000 THEN 'LARGE' WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'OTHER' END AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    s = F.when(F.col("o_totalprice") > 300000, "LARGE").when(F.col("o_orderstatus") == "F", "DONE").otherwise("OTHER")
    return R.value_counts(table(spark, sf_dir, "orders").withColumn("status", s), "status")


@query("ligand_groups", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, bool_or(l_tax > 0.07) AS any_high, arg_min(l_returnflag, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS first_flag, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY ALL")
def ligand_groups(spark, sf_dir):
    order = F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high"), F.min_by("l_returnflag", order).alias("first_flag"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


UNITS_SQL = """
WITH e AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN 'nM' WHEN 1 THEN 'pM' WHEN 2 THEN 'uM' WHEN 3 THEN 'µM' WHEN 4 THEN 'mM' ELSE '%' END AS unit, CASE event_id % 3 WHEN 0 THEN '>' WHEN 1 THEN '<' ELSE '' END AS rel FROM events),
f AS (SELECT *, CASE unit WHEN 'nM' THEN 1e3 WHEN 'pM' THEN 1 WHEN 'uM' THEN 1e6 WHEN 'µM' THEN 1e6 WHEN 'mM' THEN 1e9 END AS factor FROM e)
SELECT event_id, CASE rel WHEN '>' THEN '>=' WHEN '<' THEN '<=' ELSE '=' END AS relation, round(round(value, 3) * factor, 6) AS strict_pm, round(round(value, 3) * coalesce(factor, 1), 6) AS kept_pm, round(log10(greatest(round(value, 3) * coalesce(factor, 1), 1e-3)), 6) AS log_pm FROM f
"""


@query("unit_normalise", UNITS_SQL)
def unit_normalise(spark, sf_dir):
    k = F.col("event_id") % 6
    unit = F.when(k == 0, "nM").when(k == 1, "pM").when(k == 2, "uM").when(k == 3, "µM").when(k == 4, "mM").otherwise("%")
    text = F.concat(F.when(F.col("event_id") % 3 == 0, ">").when(F.col("event_id") % 3 == 1, "<").otherwise(""), F.round("value", 3).cast("string"))
    e = table(spark, sf_dir, "events").withColumns({"unit": unit, "text": text})
    relation, value = inequality(F.col("text"))
    kept = to_picomolar(value, F.col("unit"), keep_unknown=True)
    return rounded(e.select("event_id", relation.alias("relation"), to_picomolar(value, F.col("unit")).alias("strict_pm"), kept.alias("kept_pm"), log10_floor(kept).alias("log_pm")), "strict_pm", "kept_pm", "log_pm")


@query("affinity_filters", "SELECT p_partkey, p_type, p_size FROM part WHERE p_size BETWEEN 10 AND 40 AND upper(p_type) IN ('ECONOMY', 'STANDARD') AND p_retailprice <= 1500 AND p_brand NOT IN ('Brand#1', 'Brand#2')")
def affinity_filters(spark, sf_dir):
    p = R.allowed(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#2"], deny=True)
    return p.filter(F.col("p_size").between(10, 40) & F.upper("p_type").isin("ECONOMY", "STANDARD") & (F.col("p_retailprice") <= 1500)).select("p_partkey", "p_type", "p_size")


@query("lookup_first", "WITH s AS (SELECT lower(c_mktsegment) AS k, c_name, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS rn FROM customer) SELECT c_custkey, s.c_name AS first_name FROM customer LEFT JOIN s ON s.k = lower(c_mktsegment) AND rn = 1")
def lookup_first(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t = c.select(F.upper("c_mktsegment").alias("c_mktsegment"), F.col("c_name").alias("first_name"), F.col("c_custkey").alias("_o"))
    return R.lookup_first(c.select("c_custkey", "c_mktsegment"), t, "c_mktsegment", [F.col("_o")]).select("c_custkey", "first_name")


@query("count_reconcile", "SELECT (SELECT count(*) FROM orders) AS n_in, (SELECT count(*) FROM lineitem) AS n_out, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS lost, 0::BIGINT AS new")
def count_reconcile(spark, sf_dir):
    return R.reconcile(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


STAGES_SQL = """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
SELECT count(*) AS n_keys, count(a.k) AS n_known, count(b.k) AS n_done, count(c.k) AS n_large, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND c.k IS NOT NULL) AS n_all FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k)
"""


@query("stage_completeness", STAGES_SQL)
def stage_completeness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return R.stage_completeness({"known": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "done": o.filter("o_orderstatus = 'F'"), "large": o.filter("o_totalprice > 300000")}, "k")


CASCADE_SQL = """
WITH f AS (SELECT o_custkey AS k, o_orderstatus AS s, max(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT c_custkey AS k, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'open' WHEN b.v IS NOT NULL THEN 'done' WHEN c.v IS NOT NULL THEN 'other' END AS method
FROM customer LEFT JOIN f a ON a.k = c_custkey AND a.s = 'P' LEFT JOIN f b ON b.k = c_custkey AND b.s = 'F' LEFT JOIN f c ON c.k = c_custkey AND c.s = 'O'
"""


@query("source_cascade", CASCADE_SQL)
def source_cascade(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.max("o_totalprice").alias("v"))
    return R.source_cascade(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), {n: f.filter(F.col("s") == s) for n, s in (("open", "P"), ("done", "F"), ("other", "O"))}, "k", "v")


@query("resume_worklist", "SELECT DISTINCT p_partkey AS l_partkey, r AS l_linenumber FROM part, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS r) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = r)")
def resume_worklist(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("l_linenumber"))
    return incremental.work_list(wanted, table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"])


MOMENTS_SQL = "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY ALL"


@query("merged_moments", MOMENTS_SQL)
def merged_moments(spark, sf_dir):
    """Moments of each line number first, merged as replicates would be."""
    li = table(spark, sf_dir, "lineitem")
    parts = incremental.moments(li, ["l_partkey", "l_linenumber"], "l_quantity")
    return rounded(incremental.from_moments(incremental.merge_moments(parts, ["l_partkey"])).select("l_partkey", "n", "mean", "sd"), "mean", "sd")


@query("saved_ensemble", MOMENTS_SQL)
def saved_ensemble(spark, sf_dir):
    """Line numbers as replicates, saved after every two; stopped after four, one delta left unfinished, and gone on with."""
    from lodestone.functions.storage import work_dir

    li, sink, keys = table(spark, sf_dir, "lineitem"), work_dir(spark), ["l_partkey"]
    score = lambda r: li.filter(F.col("l_linenumber").isin(*r))
    incremental.run_saved(spark, range(1, 5), score, sink, keys, "l_quantity", every=2)
    incremental.snapshot(spark, sink, keys)
    unfinished = li.limit(10).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    unfinished.parquet(f"{sink}/batch={3:012d}")
    state = incremental.run_saved(spark, range(1, 8), score, sink, keys, "l_quantity", every=2)
    return rounded(incremental.from_moments(state).select("l_partkey", "n", "mean", "sd"), "mean", "sd")


@query("streaming_moments", MOMENTS_SQL)
def streaming_moments(spark, sf_dir):
    """The same through Structured Streaming: a file source, kept state, a replaced result table."""
    from lodestone.functions.storage import work_dir

    li = table(spark, sf_dir, "lineitem")
    # a stream reads a folder: that of the table's files, or of the table that is one file
    folder, _, file = li.inputFiles()[0].rpartition("/")
    glob = file if file == "lineitem.parquet" else "*.parquet"
    s = incremental.stream_moments(spark, folder, li.schema, ["l_partkey"], "l_quantity", glob=glob)
    sink = work_dir(spark)
    incremental.run_available(s, f"{sink}/result", f"{sink}/checkpoint")
    return rounded(spark.read.parquet(f"{sink}/result"), "mean", "sd")


@query("contrast", "SELECT l_quantity < 20 AS is_core, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM lineitem GROUP BY ALL")
def contrast(spark, sf_dir):
    return rounded(stats.contrast(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 20, F.col("l_returnflag") == "R"), "fraction")


CHARGE_SQL = """
WITH t AS (SELECT l_orderkey AS mol_id, l_partkey AS atom_id, l_extendedprice AS x, l_suppkey AS y, l_linenumber AS z, l_returnflag AS atom_type, CASE l_returnflag WHEN 'A' THEN 0.1 WHEN 'N' THEN -0.3 ELSE 0.05 END AS q, CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS net FROM lineitem)
SELECT mol_id, count(*) AS n, round(min(c), 6) AS lo, round(max(c), 6) AS hi, round(sum(c) - any_value(net), 4) + 0.0 AS residual FROM (SELECT *, q + (net - sum(q) OVER (PARTITION BY mol_id)) / count(*) OVER (PARTITION BY mol_id) AS c FROM t) GROUP BY ALL
"""


@query("charges", CHARGE_SQL)
def charges(spark, sf_dir):
    from lodestone.operators import molgraph

    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_partkey").alias("atom_id"), F.col("l_returnflag").alias("atom_type"), F.lit(None).cast("double").alias("partial_charge"))
    net = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mol_id"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.0).alias("net_charge"))
    c = molgraph.charges(a, {"A": 0.1, "N": -0.3, "R": 0.05}, net).join(net, "mol_id")
    return c.groupBy("mol_id").agg(F.count("*").alias("n"), F.round(F.min("charge"), 6).alias("lo"), F.round(F.max("charge"), 6).alias("hi"), (F.round(F.sum("charge") - F.first("net_charge"), 4) + F.lit(0.0)).alias("residual"))


CONFORMER_SQL = "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_sp2, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_sp3, pow(6.0, count(*) FILTER (WHERE l_returnflag = 'R')) * pow(9.0, count(*) FILTER (WHERE l_returnflag <> 'R')) AS conformers, pow(6.0, count(*) FILTER (WHERE l_returnflag = 'R')) * pow(9.0, count(*) FILTER (WHERE l_returnflag <> 'R')) > 5000 AS too_many FROM lineitem WHERE l_quantity > 45 GROUP BY ALL"


@query("conformer_bound", CONFORMER_SQL)
def conformer_bound(spark, sf_dir):
    from lodestone.operators import molgraph

    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity") > 45).alias("can_rotate"))
    return molgraph.conformer_bound(r, F.col("l_returnflag") == "R", keys=["l_orderkey"])
