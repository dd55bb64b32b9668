"""Queries on nested entries, calibrated motifs, copy selection and scalar functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.scalar import dihedral, element_of, is_hydrogen_name, letter_at, mean_of_present, mutation_label, pad_atom_name
from lodestone.functions.storage import materialised, work_dir
from lodestone.operators import metadata, relational, selection
from lodestone.plans.preparation import SEQ_SQL, sequences
from lodestone.plans.tables import DIST, P_SQL, points, query, rounded, table
from lodestone.sources import tables
from lodestone.sources.text import one_letter

REFERENCE = "ACDEFGHIKLMNPQRSTVWYACDEFG"
SEQUENCE = "MKTAYIAKQRQISFVKSHFSRQ"
#: Fields of an entry, the same in Spark and DuckDB.
ENTRY = {
    "pdb_id": "CAST(o_orderkey AS STRING)",
    "title": "o_orderpriority",
    "resolution": "(o_custkey % 40) / CAST(10 AS DOUBLE)",
    "inter_mol_covalent": "CAST(o_custkey % 2 AS INT)",
    "description": "CASE WHEN o_orderstatus = 'F' THEN 'The TARGET kinase' ELSE 'another' END",
    "accession": "CASE WHEN o_custkey % 3 = 0 THEN 'P1' ELSE 'P2' END",
    "one": "CAST(o_orderkey % 20 + 1 AS INT)",
    "two": "CAST(o_custkey % 24 + 1 AS INT)",
}
LIGAND = {"comp_id": "CASE l_partkey % 5 WHEN 0 THEN 'HOH' WHEN 1 THEN 'GOL' WHEN 2 THEN 'L02' WHEN 3 THEN 'SO4' ELSE 'L04' END", "linked": "l_returnflag = 'R'"}
SORT = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_extendedprice"


def entries(spark, sf_dir):
    """Orders as entries with one polymer, and their line items as ligands; written as text and read by the declared schema."""
    o = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in ENTRY.items()], "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS day")
    # only the sort keys are dealt, which hold all that a ligand is made of
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", f"struct({SORT}) AS key")
    fields = ", ".join(f"{e.replace('l_', 'k.l_')} AS {c}" for c, e in LIGAND.items())
    ligands = li.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    ligands = ligands.selectExpr("o_orderkey", f"transform(transform(keys, k -> struct({fields})), l -> struct(l.comp_id AS comp_id, lower(l.comp_id) AS name, CAST(300 AS DOUBLE) AS weight, array('A') AS chains, l.linked AS linked)) AS ligands")
    region = F.struct(F.lit(5).alias("beg"), F.lit(10).alias("length"), F.lit(15).alias("ref_beg"))
    polymer = F.struct(
        F.lit("1").alias("entity_id"), "description", F.array("accession").alias("uniprot_ids"), F.when(F.col("two") % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"))).alias("chains"), F.lit(SEQUENCE).alias("sequence"),
        F.array(F.struct(F.lit("mutation").alias("type"), F.array("one", "two").alias("positions")), F.struct(F.lit("other").alias("type"), F.array(F.lit(1)).alias("positions"))).alias("features"),
        F.array(F.struct(F.lit("P1").alias("uniprot_id"), F.array(region).alias("regions"))).alias("alignments"),
    )
    whole = o.join(ligands.hint("merge"), "o_orderkey", "left").select("pdb_id", "title", "resolution", F.lit("X-RAY").alias("method"), F.col("day").alias("deposit_date"), F.col("day").alias("release_date"), "inter_mol_covalent", F.array(polymer).alias("polymers"), "ligands")
    path = work_dir(spark)
    whole.write.json(path)
    return tables.json(spark, path, metadata.ENTRY_SCHEMA, lines=True)


def letter_sql(text: str, at: str) -> str:
    return f"CASE WHEN {at} BETWEEN 1 AND {len(text)} THEN substr('{text}', {at}, 1) ELSE '?' END"


INVENTORY_SQL = f"""
WITH o AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ENTRY.items())}, o_orderkey, o_orderdate::DATE AS day FROM orders),
i AS (SELECT l_orderkey AS o_orderkey, {', '.join(f'{e} AS {c}' for c, e in LIGAND.items())}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SORT}) AS k FROM lineitem),
g AS (SELECT o_orderkey, list(comp_id ORDER BY k) AS ids, bool_or(linked) AS linked FROM i WHERE comp_id NOT IN ('HOH', 'GOL', 'SO4') GROUP BY ALL),
t AS (SELECT *, accession = 'P1' OR description LIKE '%TARGET%' AS target FROM o),
s AS (SELECT o_orderkey, p, CASE WHEN p BETWEEN 5 AND 14 THEN p + 10 ELSE p END AS spot FROM t, LATERAL (SELECT unnest([one, two]) AS p) WHERE target),
b AS (SELECT o_orderkey, spot, {letter_sql(REFERENCE, 'spot')} AS w, {letter_sql(SEQUENCE, 'p')} AS v FROM s),
m AS (SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT CASE WHEN w <> '?' AND v <> '?' THEN w || spot || v ELSE 'pos<' || spot || '>' END)), ',') AS mutation_string FROM b GROUP BY ALL),
e AS (SELECT pdb_id, title, CASE WHEN target THEN 'A' END AS egfr_chain, CASE WHEN target THEN CASE WHEN two % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_egfr_chains, mutation_string, ids[1] AS ligand_comp_id, lower(ids[1]) AS ligand_common_name, coalesce(len(ids), 0) AS n_candidate_ligands,
  coalesce(array_to_string(ids, ','), '') AS candidate_ligands, CASE WHEN coalesce(len(ids), 0) = 0 THEN CASE WHEN inter_mol_covalent > 0 THEN 'UNKNOWN_NO_LIGAND' ELSE 'NOT_APPLICABLE_NO_LIGAND' END WHEN linked THEN 'COVALENT_CONFIRMED' WHEN inter_mol_covalent > 0 THEN 'INTERMOL_COVALENT_BUT_NOT_ON_LIGAND' ELSE 'NON_COVALENT' END AS covalent_status,
  resolution AS resolution_A, day FROM t LEFT JOIN g USING (o_orderkey) LEFT JOIN m USING (o_orderkey))
SELECT pdb_id, title, egfr_chain, n_egfr_chains, mutation_string, ligand_comp_id, ligand_common_name, n_candidate_ligands, candidate_ligands, covalent_status, resolution_A, day AS deposit_date,
  CASE WHEN n_candidate_ligands = 0 THEN 'NO_LIGAND_FOUND' WHEN n_candidate_ligands > 1 THEN 'MULTIPLE_LIGAND_CANDIDATES' ELSE 'OK' END AS metadata_status,
  n_egfr_chains <> 1 OR n_candidate_ligands <> 1 OR covalent_status IN ('COVALENT_CONFIRMED', 'INTERMOL_COVALENT_BUT_NOT_ON_LIGAND') OR resolution_A > 3.0 AS manual_review_required FROM e
"""


@query("inventory", INVENTORY_SQL)
def inventory(spark, sf_dir):
    i = metadata.inventory(entries(spark, sf_dir), "P1", "target", F.lit(REFERENCE))
    return i.select("pdb_id", "title", "egfr_chain", "n_egfr_chains", "mutation_string", "ligand_comp_id", "ligand_common_name", "n_candidate_ligands", "candidate_ligands", "covalent_status", "resolution_A", "deposit_date", "metadata_status", "manual_review_required")


QC_SQL = INVENTORY_SQL.replace("SELECT pdb_id, title, egfr_chain", ", v AS (SELECT pdb_id, title, egfr_chain") + """)
SELECT qc_name, pdb_id FROM (SELECT 'qc_no_ligand_found' AS qc_name, pdb_id FROM v WHERE metadata_status = 'NO_LIGAND_FOUND' UNION ALL SELECT 'qc_multiple_ligand_candidates', pdb_id FROM v WHERE metadata_status = 'MULTIPLE_LIGAND_CANDIDATES'
UNION ALL SELECT 'qc_covalent_confirmed', pdb_id FROM v WHERE covalent_status = 'COVALENT_CONFIRMED' UNION ALL SELECT 'qc_multiple_egfr_chains', pdb_id FROM v WHERE n_egfr_chains > 1
UNION ALL SELECT 'qc_low_resolution', pdb_id FROM v WHERE resolution_A > 3.0 UNION ALL SELECT 'qc_manual_review_required', pdb_id FROM v WHERE manual_review_required)
"""


@query("qc_tables", QC_SQL)
def qc_tables(spark, sf_dir):
    """The subsets of the inventory, written one folder each and read again."""
    path = work_dir(spark)
    i = metadata.inventory(entries(spark, sf_dir), "P1", "target", F.lit(REFERENCE))
    relational.write_qc(i, metadata.qc_checks(), ["pdb_id"], path)
    return spark.read.csv(path, header=True, schema="pdb_id string, qc_name string").select("qc_name", "pdb_id")


EXPECTED = {1: "A", 2: "G", 3: "K", 4: "C", 5: "K", 6: "M", 7: "G", 8: "M"}
MOTIFS = {3: "GM", 5: "KA"}
CAL_SQL = f"""
WITH {SEQ_SQL}, s AS (SELECT structure_id, chain, pos, CASE resname WHEN 'ALA' THEN 'A' WHEN 'CYS' THEN 'C' WHEN 'GLY' THEN 'G' WHEN 'LYS' THEN 'K' ELSE 'M' END AS aa FROM sq),
h AS (SELECT a.structure_id, a.chain, a.pos, a.aa || b.aa AS motif FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.chain = b.chain AND b.pos = a.pos + 1 WHERE a.pos BETWEEN 1 AND 9),
c AS (SELECT structure_id, chain, count(*) FILTER (WHERE motif = 'GM') AS n0, min(3 - pos) FILTER (WHERE motif = 'GM') AS o0, count(*) FILTER (WHERE motif = 'KA') AS n1, min(5 - pos) FILTER (WHERE motif = 'KA') AS o1 FROM h GROUP BY ALL),
f AS (SELECT DISTINCT s.structure_id, s.chain, CASE WHEN n0 = 1 AND n1 = 1 AND o0 = o1 THEN o0 WHEN n0 = 1 AND coalesce(n1, 0) = 0 THEN o0 WHEN n1 = 1 AND coalesce(n0, 0) = 0 THEN o1 END::INT AS o FROM s LEFT JOIN c USING (structure_id, chain)),
e(p, want) AS (VALUES {', '.join(f"({p}, '{a}')" for p, a in EXPECTED.items())}),
k AS (SELECT f.structure_id, f.chain, o, count(*) FILTER (WHERE aa = want OR (aa IS NOT NULL AND p IN (2, 7)))::INT AS n_ok, count(aa)::INT AS n_checked FROM f CROSS JOIN e LEFT JOIN s ON s.structure_id = f.structure_id AND s.chain = f.chain AND s.pos = p - o GROUP BY ALL)
SELECT structure_id, chain, o AS "offset", n_ok, n_checked, 8 - n_checked AS n_missing, n_ok = n_checked AND n_checked >= 6 AS all_ok, CASE WHEN o IS NULL THEN 'FAILED_MOTIF_NOT_FOUND' WHEN o = 0 THEN 'OK' ELSE 'OFFSET_DETECTED(' || o || ')' END AS calibration_status FROM k
"""


@query("calibrated_motifs", CAL_SQL)
def calibrated_motifs(spark, sf_dir):
    """Offsets of chains by two motifs near their start, then the expected letters at the calibrated positions."""
    letters = materialised(sequences(spark, sf_dir).withColumn("aa", one_letter(F.col("resname"))))
    hits = {at: selection.motif_hits(letters, motif, low=1, high=9) for at, motif in MOTIFS.items()}
    offsets = materialised(selection.numbering_offset(letters, hits))
    return selection.motif_check(letters, offsets, EXPECTED, tolerated=[2, 7])


REFERENCES = {"a": [3, 4], "b": [11], "c": [20]}
SELECT_SQL = f"""
WITH {P_SQL}, c AS (SELECT * FROM p WHERE resi % 11 = 0), t AS (SELECT *, resi % 3 AS ch, resi % 37 AS resseq FROM p WHERE resi % 11 <> 0),
rf(ref, p) AS (VALUES ('a', 3), ('a', 4), ('b', 11), ('c', 20)), sp AS (SELECT t.*, ref FROM t JOIN rf ON t.resseq = rf.p - t.ch),
d AS (SELECT a.structure_id, a.resi AS copy, b.ch, b.ref, min({DIST}) AS d FROM c a JOIN sp b ON a.structure_id = b.structure_id GROUP BY ALL), m AS (SELECT structure_id, copy, ch, avg(d) AS mean FROM d GROUP BY ALL),
r AS (SELECT structure_id, ch, resseq, bool_or(resi % 5 <> 0) AS ca FROM t GROUP BY ALL), k AS (SELECT structure_id, ch, count(*) AS n, count(*) FILTER (WHERE NOT ca) AS n_missing FROM r GROUP BY ALL),
n AS (SELECT structure_id, copy, arg_min(ch, (mean, ch)) AS ch, min(mean) AS mean FROM m GROUP BY ALL), q AS (SELECT n.*, n_missing, (copy % 7) / 10.0::DOUBLE AS occ, copy % 3 AS alt, min(mean) OVER (PARTITION BY n.structure_id) AS lo, count(*) OVER (PARTITION BY n.structure_id) AS n_pocket FROM n JOIN k USING (structure_id, ch) WHERE mean < 0.25),
b AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n_missing, occ DESC, alt, mean, copy) AS rn FROM q WHERE mean <= lo + 0.05), v AS (SELECT structure_id, count(*) FILTER (WHERE n % 2 = 1) AS valid FROM k GROUP BY ALL)
SELECT v.structure_id, CASE ch WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS selected_chain, copy AS selected_copy, CASE WHEN copy IS NULL THEN 'NO_POCKET_LIGAND_FOUND' WHEN valid >= 1 THEN 'OK' ELSE 'MOTIF_CHECK_FAILED' END AS selection_status,
  coalesce(n_pocket, 0) AS n_pocket_ligand_copies, valid AS n_valid_motif_chains FROM v LEFT JOIN (SELECT * FROM b WHERE rn = 1) USING (structure_id)
"""


@query("copy_selection", SELECT_SQL)
def copy_selection(spark, sf_dir):
    """Ligand copies to the calibrated reference positions of three chains; nearest chain, pocket, band and tie-breaks."""
    p = points(spark, sf_dir)
    letter = lambda k: F.when(k == 0, "A").when(k == 1, "B").otherwise("C")
    copies = p.filter("resi % 11 = 0").withColumnRenamed("resi", "copy")
    residues = p.filter("resi % 11 <> 0").withColumns({"chain": letter(F.col("resi") % 3), "resseq": F.col("resi") % 37, "icode": F.lit(""), "atom_name": F.when(F.col("resi") % 5 != 0, "CA").otherwise("CB")})
    offsets = residues.select("structure_id", "chain").distinct().withColumn("offset", F.ascii("chain") - F.ascii(F.lit("A")))
    distances = selection.pocket_distances(copies, residues, offsets, REFERENCES)
    quality = copies.select("structure_id", "copy", ((F.col("copy") % 7) / 10.0).alias("mean_occupancy"), (F.col("copy") % 3).alias("n_altloc_atoms"))
    complete = selection.completeness(residues)
    checks = complete.select("structure_id", "chain", (F.col("n_modelled") % 2 == 1).alias("all_ok"))
    s = selection.select_copy(distances, quality, complete, checks, pocket=0.25, band=0.05)
    return s.select("structure_id", "selected_chain", "selected_copy", "selection_status", "n_pocket_ligand_copies", "n_valid_motif_chains")


DIHEDRAL_SQL = f"""
WITH {P_SQL}, w AS (SELECT structure_id, resi, {', '.join(f'lead({c}, {k}) OVER o - {"lead(" + c + ", " + str(k - 1) + ") OVER o" if k > 1 else c} AS {v}{c}' for k, v in ((1, 'p'), (2, 'q'), (3, 'r')) for c in 'xyz')} FROM p WINDOW o AS (PARTITION BY structure_id ORDER BY resi)),
n AS (SELECT *, py*qz - pz*qy AS nx, pz*qx - px*qz AS ny, px*qy - py*qx AS nz, qy*rz - qz*ry AS mx, qz*rx - qx*rz AS my, qx*ry - qy*rx AS mz FROM w WHERE rx IS NOT NULL)
SELECT structure_id, resi, round(degrees(atan2(sqrt(qx*qx + qy*qy + qz*qz) * (px*mx + py*my + pz*mz), nx*mx + ny*my + nz*mz)), 4) AS dihedral FROM n
"""


@query("dihedrals", DIHEDRAL_SQL)
def dihedrals(spark, sf_dir):
    p = points(spark, sf_dir)
    w = selection.Window.partitionBy("structure_id").orderBy("resi")
    for k in (1, 2, 3):
        p = p.withColumns({f"{c}{k}": F.lead(c, k).over(w) for c in "xyz"})
    corner = lambda k: [F.col(f"{c}{k}") for c in "xyz"]
    return rounded(p.filter("x3 is not null").select("structure_id", "resi", dihedral(corner(""), corner(1), corner(2), corner(3)).alias("dihedral")), "dihedral", places=4)


PART = {
    "name": "substr(p_type, 1, CAST(p_size % 4 + 1 AS INT))",
    "element": "CASE WHEN p_size % 3 = 0 THEN 'CL' ELSE 'C' END",
    "hname": "CASE p_size % 4 WHEN 0 THEN ' H1' WHEN 1 THEN '2HB' WHEN 2 THEN 'CH3' ELSE '22H' END",
    "sybyl": "CASE p_size % 3 WHEN 0 THEN 'C.3' WHEN 1 THEN 'Cl' ELSE 'N.ar' END",
    "odd": "CASE WHEN p_size % 2 = 1 THEN p_retailprice END",
    "third": "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END",
    "spot": "CAST(p_size - 3 AS INT)",
}
FIELDS_SQL = f"""
WITH x AS (SELECT p_partkey, p_name, {', '.join(f'{e} AS {c}' for c, e in PART.items())} FROM part),
y AS (SELECT *, CASE WHEN spot BETWEEN 1 AND length(p_name) THEN substr(p_name, spot, 1) ELSE '?' END AS wild, CASE WHEN spot BETWEEN 1 AND {len(SEQUENCE)} THEN substr('{SEQUENCE}', spot, 1) ELSE '?' END AS mutant FROM x)
SELECT p_partkey, CASE WHEN length(name) >= 4 OR length(element) > 1 THEN rpad(name, 4, ' ') ELSE rpad(' ' || name, 4, ' ') END AS padded, regexp_matches(trim(hname), '^[0-9]?H') AS hydrogen, upper(regexp_extract(sybyl, '^[^.]+')) AS element,
  CASE WHEN odd IS NULL THEN third WHEN third IS NULL THEN odd ELSE (odd + third) / 2 END AS mean_present, CASE WHEN wild <> '?' AND mutant <> '?' THEN wild || spot || mutant ELSE 'pos<' || spot || '>' END AS label FROM y
"""


@query("scalar_fields", FIELDS_SQL)
def scalar_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", *[f"{e} AS {c}" for c, e in PART.items()])
    at: Column = F.col("spot")
    label = mutation_label(letter_at(F.col("p_name"), at), at, letter_at(F.lit(SEQUENCE), at))
    return p.select("p_partkey", pad_atom_name(F.col("name"), F.col("element")).alias("padded"), is_hydrogen_name(F.col("hname")).alias("hydrogen"), element_of(F.col("sybyl")).alias("element"), mean_of_present(F.col("odd"), F.col("third")).alias("mean_present"), label.alias("label"))


@query("one_entry", "SELECT r_regionkey, r_name FROM region WHERE lower(r_name) = 'asia'")
def one_entry(spark, sf_dir):
    return relational.only(table(spark, sf_dir, "region"), "r_name", "Asia").select("r_regionkey", "r_name")


SAME_SQL = """
WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT c_custkey AS o_custkey, 'F' AS o_orderstatus FROM customer)
SELECT 'itself' AS pair, NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM a) AS same
UNION ALL SELECT 'repeated', NOT EXISTS ((SELECT * FROM a UNION ALL SELECT * FROM a) EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'other', NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
"""


@query("same_rows", SAME_SQL)
def same_rows(spark, sf_dir):
    """Orders against themselves dealt anew, themselves twice, and customers."""
    a = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    pairs = {"itself": a.repartition(5), "repeated": a.unionByName(a), "other": b}
    return spark.createDataFrame([(n, relational.same_rows(a, x)) for n, x in pairs.items()], "pair string, same boolean")


@query("json_documents", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey, c_mktsegment AS segment FROM customer")
def json_documents(spark, sf_dir):
    """Written as JSON and read by a declared schema, in which an id stays text."""
    path = work_dir(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_nationkey", F.array("c_mktsegment", "c_name").alias("words"))
    rows.write.json(path)
    return tables.json(spark, path, "c_custkey string, c_nationkey int, words array<string>", lines=True).select("c_custkey", "c_nationkey", F.col("words")[0].alias("segment"))
