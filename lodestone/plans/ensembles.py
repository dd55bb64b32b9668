"""Queries on ensembles and sequences."""

from pyspark.sql import functions as F

from lodestone.operators import ensemble as E
from lodestone.operators import selection, stats
from lodestone.plans.tables import Z_SQL, ensemble, query, rounded, table


def scored(spark, sf_dir):
    return E.ensemble_score(ensemble(spark, sf_dir), F.col("replicate") == 1, keys=("resi",))


@query("zscore_class", f"WITH {Z_SQL} SELECT resi, round(E_native, 6) AS E_native, round(decoy_mean, 6) AS decoy_mean, round(decoy_std, 6) AS decoy_std, n_decoys, round(F_index, 6) AS F_index, frustration_class FROM z")
def zscore_class(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "E_native", "decoy_mean", "decoy_std", "F_index")


POCKET_SQL = f"""
WITH {Z_SQL}, q AS (SELECT z.resi, (z.resi * 7 + 3) % 500 AS resj, z.resi % 4 AS structure_id, frustration_class FROM z),
t AS (SELECT * FROM q WHERE resi % 10 = 0 OR resj % 10 = 0)
SELECT structure_id, count(*) AS n_contacts_total, count(*) FILTER (WHERE frustration_class = 'minimally_frustrated') AS n_minimally_frustrated, count(*) FILTER (WHERE frustration_class = 'neutral') AS n_neutral,
  count(*) FILTER (WHERE frustration_class = 'highly_frustrated') AS n_highly_frustrated, round(count(*) FILTER (WHERE frustration_class = 'minimally_frustrated') / count(*), 6) AS frac_minimally,
  round(count(*) FILTER (WHERE frustration_class = 'highly_frustrated') / count(*), 6) AS frac_highly FROM t GROUP BY ALL
"""


@query("pocket_summary", POCKET_SQL)
def pocket_summary(spark, sf_dir):
    s = scored(spark, sf_dir).select("resi", ((F.col("resi") * 7 + 3) % 500).alias("resj"), (F.col("resi") % 4).alias("structure_id"), "frustration_class")
    ends = s.select("structure_id", "resi").unionByName(s.select("structure_id", F.col("resj").alias("resi"))).filter("resi % 10 = 0")
    return rounded(E.region_summary(s, ends), "frac_minimally", "frac_highly")


@query("ensemble_assoc", f"WITH {Z_SQL}, j AS (SELECT F_index AS x, log10(greatest(p_retailprice, 1e-3)) AS y FROM z JOIN part ON p_partkey = resi) SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM j")
def ensemble_assoc(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resi"), "p_retailprice")
    return rounded(E.association(scored(spark, sf_dir), part, "resi", "F_index", "p_retailprice"), "r", "slope", "intercept")


#: Student's t by Simpson's rule over r: p = 1 - 2 c * integral from 0 to |r| of (1 - u^2)^((n - 4) / 2).
P_VALUE_SQL = f"""
WITH {Z_SQL}, j AS (SELECT frustration_class, F_index AS x, p_retailprice AS y FROM z JOIN part ON p_partkey = resi),
c AS (SELECT frustration_class, count(*) AS n, corr(x, y) AS r FROM j GROUP BY ALL),
s AS (SELECT *, list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 - r * r * k * k / 16e6, (n - 4) / 2.0))) * abs(r) / 12000 AS area FROM c)
SELECT frustration_class, n, round(r, 6) AS r, round(1 - 2 * area * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()), 6) AS p FROM s
"""


@query("assoc_p_value", P_VALUE_SQL)
def assoc_p_value(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resi"), "p_retailprice")
    c = stats.correlation(scored(spark, sf_dir).join(part, "resi"), "F_index", "p_retailprice", ["frustration_class"])
    return rounded(c.select("frustration_class", "n", "r", stats.t_test_p("r", "n").alias("p")), "r", "p")


@query("spearman", f"WITH {Z_SQL}, j AS (SELECT round(F_index, 9) AS x, p_size AS y FROM z JOIN part ON p_partkey = resi), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM j) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    """Ranks of indices to 9 places: equal ones are ties, in whichever order their sums were made."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resi"), "p_size")
    return rounded(stats.spearman(rounded(scored(spark, sf_dir), "F_index", places=9).join(part, "resi"), "F_index", "p_size"), "rho")


ADJ_SQL = """
WITH g AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x, l_discount AS z FROM lineitem),
m AS (SELECT l_returnflag, count(*) AS n, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(z, y) AS zy, var_samp(x) AS xx, var_samp(z) AS zz FROM g GROUP BY ALL)
SELECT l_returnflag, n, round((xy*zz - xz*zy) / (xx*zz - xz*xz), 4) AS slope FROM m
"""


@query("adjusted_slope", ADJ_SQL)
def adjusted_slope(spark, sf_dir):
    return rounded(stats.adjusted_slope(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"]), "slope", places=4)


PERM_SQL = """
WITH b AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier),
d AS (SELECT k, id, x, y FROM b, (SELECT unnest(range(1, 101)) AS k)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('0|' || k || '|' || id), id) AS at, row_number() OVER (PARTITION BY k ORDER BY id) AS own FROM d),
n AS (SELECT a.k, corr(a.x, b.y) AS r FROM o a JOIN o b ON a.k = b.k AND a.own = b.at GROUP BY a.k), t AS (SELECT count(*) AS n, corr(x, y) AS r FROM b)
SELECT t.n, round(t.r, 6) AS r, round(avg(CASE WHEN abs(n.r) >= abs(t.r) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM n, t GROUP BY t.n, t.r
"""


@query("permutation_p", PERM_SQL)
def permutation_p(spark, sf_dir):
    return rounded(stats.permutation_p(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey", permutations=100), "r", "p")


def _keyed_sql(seed: int = 5, permutations: int = 60) -> str:
    """The bijection of ``stats.keyed_permutation`` by the same arithmetic."""
    m = (1 << 31) - 1
    h1 = lambda t, r: f"((({t}) * 40503 + k * 65599 + {r * 7919 + seed * 131 + 1}) % {m})"
    h = lambda t, r: f"((({h1(t, r)} * {h1(t, r)} + 12345) % {m}) * 69621 % {m})"
    rounds, a, b = [], "i // c", "i % c"
    for r in (1, 2, 3, 4):
        one = f"(a + {h('b', r)}) % w AS a, b" if r % 2 else f"a, (b + {h('a', r)}) % c AS b"
        rounds.append(one)
    step = lambda source: f"SELECT k, id, i0, n, w, c, a * c + b AS i FROM (SELECT k, id, i0, n, w, c, {rounds[3]} FROM (SELECT k, id, i0, n, w, c, {rounds[2]} FROM (SELECT k, id, i0, n, w, c, {rounds[1]} FROM (SELECT k, id, i0, n, w, c, {rounds[0]} FROM (SELECT *, {a} AS a, {b} AS b FROM {source})))))"
    return f"""
WITH RECURSIVE d AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
g AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS w FROM d), s AS (SELECT k::BIGINT AS k, id, i AS i0, n, w, (n + w - 1) // w AS c, i FROM g, range(1, {permutations + 1}) t(k)),
v AS ({step('s')} UNION ALL {step('(SELECT * FROM v WHERE i >= n)')}),
q AS (SELECT k, corr(a.x, b.y) AS rk FROM v JOIN d a ON a.i = v.i0 JOIN d b ON b.i = v.i WHERE v.i < v.n GROUP BY k), o AS (SELECT count(*) AS n, corr(x, y) AS r FROM d)
SELECT n, round(r, 6) AS r, round(avg(CASE WHEN abs(rk) >= abs(r) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM q, o GROUP BY n, r
"""


@query("permutation_keyed", _keyed_sql())
def permutation_keyed(spark, sf_dir):
    """Balances against nations of customers, partners by a keyed bijection."""
    return rounded(stats.permutation_test(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", "c_custkey", permutations=60, seed=5), "r", "p")


@query("rank_ties", "SELECT o_orderkey, row_number() OVER w2 AS r_first, rank() OVER w AS r_min, rank() OVER w + count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1 AS r_max, rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2.0 AS r_avg FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate), w2 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)")
def rank_ties(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    for ties in ("first", "min", "max"):
        o = stats.rank(o, "o_orderdate", ["o_orderstatus"], ties, out=f"r_{ties}")
    return stats.rank(o, "o_orderdate", ["o_orderstatus"], out="r_avg").drop("o_orderstatus", "o_orderdate")


@query("composition", "SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS freq FROM events GROUP BY user_id, event_type")
def composition(spark, sf_dir):
    return rounded(E.composition(table(spark, sf_dir, "events"), ("user_id",), "event_type"), "freq")


DECOY_SQL = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT user_id, event_type, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(n) OVER (PARTITION BY user_id ORDER BY event_type) AS hi, sum(n) OVER (PARTITION BY user_id) AS total FROM c),
p AS (SELECT user_id, event_id, decoy, ('0x' || substr(md5((decoy + 7) || '|' || user_id || '|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events, (SELECT unnest(range(1, 6)) AS decoy))
SELECT p.user_id, decoy, event_type, count(*) AS n FROM p JOIN w ON w.user_id = p.user_id AND u * total >= lo AND u * total < hi GROUP BY ALL
"""


@query("decoy_draw", DECOY_SQL)
def decoy_draw(spark, sf_dir):
    d = E.decoy_letters(table(spark, sf_dir, "events"), 5, 7, "user_id", "event_id", "event_type")
    return d.groupBy("user_id", "decoy", "event_type").agg(F.count("*").alias("n"))


@query("gaps", "WITH g AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT user_id, string_agg((event_id + 1) || '-' || (nxt - 1), ';' ORDER BY event_id) AS missing_residue_ranges FROM g WHERE nxt - event_id > 1 GROUP BY user_id")
def gaps(spark, sf_dir):
    return selection.gap_text(table(spark, sf_dir, "events"), ("user_id",), "event_id")


@query("renumber", "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL), n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f) AS pose_resnum FROM f) SELECT user_id, event_type, pose_resnum::INT AS pose_resnum FROM n UNION ALL SELECT user_id, 'ligand', (max(pose_resnum) + 1)::INT FROM n GROUP BY user_id")
def renumber(spark, sf_dir):
    n = selection.renumber(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "event_id")
    ligand = n.select("user_id").distinct().withColumn("event_type", F.lit("ligand"))
    return selection.number_with_ligand(n, ligand, ("user_id",))


MOTIF_SQL = """
WITH e AS (SELECT user_id % 3 AS chain, event_id AS pos, substr(event_type, 1, 1) AS aa FROM events)
SELECT chain, count(*) AS n FROM e a WHERE aa = 'v' AND EXISTS (SELECT 1 FROM e b WHERE b.chain = a.chain AND b.pos = a.pos + 1 AND b.aa = 'c') GROUP BY chain
"""


@query("motif_hits", MOTIF_SQL)
def motif_hits(spark, sf_dir):
    s = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("chain"), F.col("event_id").alias("pos"), F.substring("event_type", 1, 1).alias("aa"))
    return selection.motif_hits(s, "vc", ("chain",)).groupBy("chain").agg(F.count("*").alias("n"))


MOTIF_CHECK_SQL = """
WITH s AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, substr(event_type, 1, 1) AS aa FROM events),
x AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS p, unnest(['c', 'v', 'c', 'p', 'e', 'v', 'c', 's']) AS want), c AS (SELECT DISTINCT chain FROM s),
j AS (SELECT c.chain, x.p, want, aa FROM c CROSS JOIN x LEFT JOIN s ON s.chain = c.chain AND s.pos = x.p)
SELECT chain, (count(*) FILTER (WHERE aa IS NOT NULL AND (aa = want OR p IN (3, 7))))::INT AS n_ok, count(aa)::INT AS n_checked, (8 - count(aa))::INT AS n_missing, 'OK' AS calibration_status,
  count(*) FILTER (WHERE aa IS NOT NULL AND (aa = want OR p IN (3, 7))) = count(aa) AND count(aa) >= 6 AS all_ok FROM j GROUP BY chain
"""


@query("motif_check", MOTIF_CHECK_SQL)
def motif_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("chain"), F.row_number().over(selection.Window.partitionBy("user_id").orderBy("event_id")).alias("pos"), F.substring("event_type", 1, 1).alias("aa"))
    offsets = s.select("chain").distinct().withColumn("offset", F.lit(0))
    return selection.motif_check(s, offsets, dict(enumerate("cvcpevcs", 1)), (3, 7), keys=("chain",)).drop("offset")


@query("histogram50", "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n, round(min(lo + least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50)), 4) AS bin_lo FROM lineitem, b GROUP BY 1")
def histogram50(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "bin_lo", places=4)


@query("numeric_profile", "SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL")
def numeric_profile(spark, sf_dir):
    return rounded(stats.profile(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), "mean", "sd", "q25", "q50", "q75", places=4)


@query("class_shares", f"WITH {Z_SQL} SELECT frustration_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM z GROUP BY ALL")
def class_shares(spark, sf_dir):
    return rounded(stats.shares(scored(spark, sf_dir), "frustration_class"), "percent")


DECOY_E_SQL = """
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, substr(event_type, 1, 1) AS aa FROM events),
c AS (SELECT user_id, aa, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT user_id, aa, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY aa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(n) OVER (PARTITION BY user_id ORDER BY aa) AS hi, sum(n) OVER (PARTITION BY user_id) AS total FROM c),
u AS (SELECT user_id, pos, decoy, ('0x' || substr(md5(decoy || '|' || user_id || '|' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, (SELECT unnest(range(1, 4)) AS decoy)),
l AS (SELECT u.user_id, decoy, pos, aa FROM u JOIN w ON w.user_id = u.user_id AND u * total >= lo AND u * total < hi)
SELECT a.user_id AS structure_id, a.decoy, count(*) AS n, round(sum(CASE WHEN a.aa = b.aa THEN -1.0 WHEN a.aa < b.aa THEN 0.5 ELSE 0.0 END), 6) AS e
FROM l a JOIN l b ON a.user_id = b.user_id AND a.decoy = b.decoy AND b.pos = a.pos + 4 GROUP BY ALL
"""


@query("decoy_energy", DECOY_E_SQL)
def decoy_energy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("structure_id"), F.row_number().over(selection.Window.partitionBy("user_id").orderBy("event_id")).alias("pos"), F.substring("event_type", 1, 1).alias("aa"))
    c = s.select("structure_id", F.col("pos").alias("resi"), (F.col("pos") + 4).alias("resj"))
    letters = s.select("aa").distinct()
    pairs = letters.withColumnRenamed("aa", "aa_i").crossJoin(F.broadcast(letters.withColumnRenamed("aa", "aa_j")))  # the alphabet, squared
    potential = pairs.withColumn("e", F.when(F.col("aa_i") == F.col("aa_j"), -1.0).when(F.col("aa_i") < F.col("aa_j"), 0.5).otherwise(0.0))
    out = E.decoy_energy(E.decoy_letters(s, 3), c, potential)
    return rounded(out.groupBy("structure_id", "decoy").agg(F.count("*").alias("n"), F.sum("e").alias("e")), "e")
