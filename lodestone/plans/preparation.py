"""Queries of the preparation chain, on text that is laid out from the given tables.

Structures: a supplier's line items as atom records of fixed width.  The SQL starts
from the columns themselves, so it also checks that laying out and reading agree.
"""

from pyspark.sql import functions as F

from lodestone.functions.scalar import once
from lodestone.functions.storage import materialised
from lodestone.operators import preparation, selection
from lodestone.plans.tables import query, rounded, table
from lodestone.sources import text

NAMES = ["N", "CA", "CB", "SG", "O"]
RESIDUES = ["ALA", "CYS", "GLY", "LYS", "MSE", "XYZ"]


def case(value: str, results) -> str:
    return f"(CASE {value} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(results)) + " END)"


#: The same in Spark and DuckDB: columns of an atom record.
FIELDS = {
    "structure_id": "concat('S', l_suppkey)",
    "line_no": "CAST(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 64 + l_quantity AS BIGINT)",
    "record": "CASE WHEN l_linenumber % 4 = 0 THEN 'HETATM' ELSE 'ATOM' END",
    "serial": "CAST(l_orderkey % 99999 AS INT)",
    "atom_name": case("l_partkey % 5", NAMES),
    "altloc": case("l_orderkey % 4", ["", "A", "B", ""]),
    "resname": f"CASE WHEN l_linenumber % 4 <> 0 THEN {case('(l_partkey % 41 + 1) % 6', RESIDUES)} WHEN l_partkey % 2 = 0 THEN 'HOH' ELSE 'LIG' END",
    "chain": "l_linestatus",
    "resseq": "CAST(l_partkey % 41 + 1 AS INT)",
    "icode": "''",
    "x": "l_quantity * 0.5",
    "y": "l_linenumber * CAST(1.25 AS DOUBLE)",
    "z": "(l_partkey % 100) * CAST(0.25 AS DOUBLE)",
    "occupancy": "(l_orderkey % 10) / CAST(10 AS DOUBLE)",
    "b_factor": "l_linenumber * CAST(1.5 AS DOUBLE)",
}
L_SQL = "l AS (SELECT *, substr(atom_name, 1, 1) AS element FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FIELDS.items()) + " FROM lineitem))"
LAYOUT = "%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s"
ORDER = ["record", "serial", "atom_name", "altloc", "resname", "chain", "resseq", "icode", "x", "y", "z", "occupancy", "b_factor", "element"]
LINE_SQL = f"printf('{LAYOUT}', {', '.join(ORDER)})"
KNOWN = "('" + "', '".join(text.ONE_LETTER) + "')"


def atom_lines(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in FIELDS.items()]).withColumn("element", F.substring("atom_name", 1, 1))
    return a.select("structure_id", "line_no", once(F.format_string(LAYOUT, *ORDER)).alias("line"))


def atoms(spark, sf_dir):
    return text.atoms(atom_lines(spark, sf_dir))


ATOM_COLUMNS = ["structure_id", "line_no", *ORDER]


@query("atom_records", f"WITH {L_SQL} SELECT {', '.join(ATOM_COLUMNS)}, 1 AS model_no FROM l")
def atom_records(spark, sf_dir):
    return atoms(spark, sf_dir).select(*ATOM_COLUMNS, "model_no")


RESIDUE_SQL = f"""
WITH {L_SQL}, r AS (SELECT structure_id, chain, resseq, arg_min(resname, line_no) AS resname, min(line_no) AS first_line, max(CASE WHEN atom_name = 'CA' THEN {{'x': x, 'y': y, 'z': z}} END) AS ca
  FROM l WHERE record = 'ATOM' AND resname IN {KNOWN} GROUP BY ALL)
SELECT structure_id, chain, resseq, resname, CASE resname WHEN 'ALA' THEN 'A' WHEN 'CYS' THEN 'C' WHEN 'GLY' THEN 'G' WHEN 'LYS' THEN 'K' ELSE 'M' END AS aa1, first_line, ca.x AS x, ca.y AS y, ca.z AS z FROM r
"""


@query("residue_table", RESIDUE_SQL)
def residue_table(spark, sf_dir):
    return text.residues(atoms(spark, sf_dir)).select("structure_id", "chain", "resseq", "resname", "aa1", "first_line", "x", "y", "z")


@query("chain_completeness", f"WITH {L_SQL}, r AS (SELECT structure_id, chain, resseq, bool_or(atom_name = 'CA') AS ca FROM l GROUP BY ALL) SELECT structure_id, chain, count(*) AS n_modelled, count(*) FILTER (WHERE NOT ca) AS n_missing_ca FROM r GROUP BY ALL")
def chain_completeness(spark, sf_dir):
    return selection.completeness(atoms(spark, sf_dir))


@query("ligand_copies", f"WITH {L_SQL} SELECT structure_id, chain, resseq, round(avg(CASE WHEN occupancy = 0 THEN 1.0 ELSE occupancy END), 6) AS mean_occupancy, count(*) FILTER (WHERE altloc <> '') AS n_altloc_atoms FROM l WHERE record = 'HETATM' AND resname = 'LIG' GROUP BY ALL")
def ligand_copies(spark, sf_dir):
    a = atoms(spark, sf_dir).filter("record = 'HETATM' and resname = 'LIG'")
    return rounded(selection.copy_quality(a), "mean_occupancy")


CHOSEN = {
    "structure_id": "concat('S', s_suppkey)",
    "selected_chain": "CASE WHEN s_suppkey % 2 = 0 THEN 'O' ELSE 'F' END",
    "ligand_chain": "'O'",
    "ligand_comp_id": "'LIG'",
    "ligand_resnum": "CAST(s_suppkey % 41 + 1 AS INT)",
    "ligand_code": "CASE WHEN s_suppkey % 3 = 0 THEN 'UNK' ELSE 'LIG' END",
}
#: Atoms of the chosen chain and ligand, one alternative each.
C_SQL = f"""{L_SQL}, ch AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CHOSEN.items())} FROM supplier),
k AS (SELECT l.*, selected_chain, ligand_comp_id, ligand_code, CASE WHEN record = 'ATOM' AND chain = selected_chain AND resname IN {KNOWN} THEN 1 WHEN record = 'HETATM' AND resname = ligand_comp_id AND chain = ligand_chain AND resseq = ligand_resnum THEN 3 END AS block
  FROM l JOIN ch USING (structure_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY structure_id, block, chain, resseq, atom_name ORDER BY altloc IN ('', 'A') DESC, occupancy DESC, line_no) AS rn, count(*) OVER (PARTITION BY structure_id, block, chain, resseq, atom_name) - 1 AS n_dropped FROM k WHERE block IS NOT NULL),
cl AS (SELECT *, {LINE_SQL} AS raw FROM q WHERE rn = 1),
ln AS (SELECT *, CASE WHEN block = 3 AND ligand_code <> ligand_comp_id THEN substr(raw, 1, 17) || lpad(ligand_code, 3, ' ') || substr(raw, 21) ELSE raw END AS line FROM cl)"""


def chosen(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in CHOSEN.items()])


def cleaned(spark, sf_dir):
    return preparation.chosen_atoms(atoms(spark, sf_dir), chosen(spark, sf_dir))


@query("cleaned_atoms", f"WITH {C_SQL} SELECT structure_id, block, line_no, chain, resseq, atom_name, altloc, occupancy, n_dropped, line FROM ln")
def cleaned_atoms(spark, sf_dir):
    return cleaned(spark, sf_dir).select("structure_id", "block", "line_no", "chain", "resseq", "atom_name", "altloc", "occupancy", "n_dropped", "line")


CLEAN_SQL = f"""
WITH {C_SQL}, i AS (SELECT DISTINCT structure_id, selected_chain, ligand_comp_id FROM ln)
SELECT structure_id, block, line_no, line FROM ln
UNION ALL SELECT structure_id, 0, 0, 'REMARK   chain ' || selected_chain || ', ligand ' || ligand_comp_id FROM i
UNION ALL SELECT structure_id, 2, 0, 'TER' FROM i UNION ALL SELECT structure_id, 4, 0, 'END' FROM i
"""


@query("clean_lines", CLEAN_SQL)
def clean_lines(spark, sf_dir):
    return preparation.clean_lines(cleaned(spark, sf_dir))


MAP_SQL = f"""
WITH {C_SQL}, p AS (SELECT structure_id, chain, resseq, icode, resname, row_number() OVER (PARTITION BY structure_id ORDER BY min(line_no), chain, resseq) AS pose_resnum FROM cl WHERE block = 1 GROUP BY structure_id, chain, resseq, icode, resname),
t AS (SELECT structure_id, max(pose_resnum) + 1 AS pose_resnum FROM p GROUP BY ALL)
SELECT * FROM p UNION ALL SELECT DISTINCT structure_id, chain, resseq, icode, resname, pose_resnum FROM cl JOIN t USING (structure_id) WHERE block = 3
"""


@query("residue_mapping", MAP_SQL)
def residue_mapping(spark, sf_dir):
    return preparation.residue_mapping(cleaned(spark, sf_dir)).select("structure_id", "chain", "resseq", "icode", "resname", "pose_resnum")


NAMED = {"structure_id": "concat('S', o_custkey % 100)", "line_no": "o_orderkey", "chain": "CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END"}
THREE = [case(f"(o_orderkey + {k}) % 5", RESIDUES[:5]) for k in (0, 2, 3)]
SEQ_SQL = f"""
sq AS (SELECT structure_id, chain, row_number() OVER (PARTITION BY structure_id, chain ORDER BY line_no, i) AS pos, r[i] AS resname
  FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in NAMED.items())}, [{', '.join(THREE)}] AS r FROM orders), (SELECT unnest(range(1, 4)) AS i))
"""


def sequences(spark, sf_dir):
    """An order as a record of three residues of its customer's chain."""
    o = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in NAMED.items()], *[f"{e} AS r{k}" for k, e in enumerate(THREE)])
    line = F.format_string("SEQRES %3d %1s %4d  %s %s %s", F.col("line_no") % 1000, "chain", F.lit(3), "r0", "r1", "r2")
    return text.polymer_sequences(o.select("structure_id", "line_no", line.alias("line")))


@query("sequence_records", f"WITH {SEQ_SQL} SELECT structure_id, chain, pos, resname FROM sq")
def sequence_records(spark, sf_dir):
    return sequences(spark, sf_dir)


D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
SUMMARY_SQL = f"""
WITH {C_SQL}, {SEQ_SQL},
n AS (SELECT structure_id, count(*) FILTER (WHERE block = 1) AS pa, count(*) FILTER (WHERE block = 3) AS la, count(DISTINCT CASE WHEN block = 1 THEN resseq END) AS pr, sum(n_dropped)::BIGINT AS dropped FROM cl GROUP BY ALL),
s AS (SELECT sq.structure_id, count(*) AS seqres_length FROM sq JOIN ch ON ch.structure_id = sq.structure_id AND sq.chain = selected_chain GROUP BY ALL),
u AS (SELECT DISTINCT structure_id, resseq FROM cl WHERE block = 1), v AS (SELECT structure_id, resseq, lead(resseq) OVER (PARTITION BY structure_id ORDER BY resseq) AS nxt FROM u),
g AS (SELECT structure_id, string_agg((resseq + 1) || '-' || (nxt - 1), ';' ORDER BY resseq) AS holes FROM v WHERE nxt - resseq > 1 GROUP BY ALL),
sg AS (SELECT * FROM cl WHERE block = 1 AND resname = 'CYS' AND atom_name = 'SG'),
ss AS (SELECT a.structure_id, count(*) AS n_ss, string_agg(a.resseq || '-' || b.resseq, ';' ORDER BY a.resseq || '-' || b.resseq) AS pairs FROM sg a JOIN sg b ON a.structure_id = b.structure_id AND a.resseq < b.resseq AND {D} < 2.5 GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq ORDER BY atom_name <> 'O', line_no) AS rn FROM l WHERE resname = 'HOH') WHERE rn = 1),
b AS (SELECT a.structure_id, count(DISTINCT (a.chain, a.resseq)) AS n_w FROM w a JOIN cl b ON b.structure_id = a.structure_id AND b.block = 3 AND {D} <= 4.0 GROUP BY ALL)
SELECT ch.structure_id, coalesce(pa, 0) AS protein_atom_count, coalesce(la, 0) AS ligand_atom_count, coalesce(pr, 0) AS n_protein_residues, coalesce(dropped, 0)::BIGINT AS n_altloc_atoms_removed, seqres_length, holes AS missing_residue_ranges,
  coalesce(n_ss, 0) AS n_disulfides, pairs AS disulfide_pairs, coalesce(n_w, 0) AS n_bridging_waters, greatest(coalesce(seqres_length, 0) - coalesce(pr, 0), 0) AS n_missing_residues,
  CASE WHEN coalesce(pa, 0) = 0 THEN 'FAILED_NO_PROTEIN_ATOMS' WHEN coalesce(la, 0) = 0 THEN 'FAILED_NO_LIGAND_ATOMS' ELSE 'OK' END AS status
FROM ch LEFT JOIN n USING (structure_id) LEFT JOIN s USING (structure_id) LEFT JOIN g USING (structure_id) LEFT JOIN ss USING (structure_id) LEFT JOIN b USING (structure_id)
"""


@query("preparation_summary", SUMMARY_SQL)
def preparation_summary(spark, sf_dir):
    a, c = materialised(atoms(spark, sf_dir)), chosen(spark, sf_dir)
    s = preparation.summary(c, materialised(preparation.chosen_atoms(a, c)), sequences(spark, sf_dir), a)
    return s.select("structure_id", "protein_atom_count", "ligand_atom_count", "n_protein_residues", "n_altloc_atoms_removed", "seqres_length", "missing_residue_ranges", "n_disulfides", "disulfide_pairs", "n_bridging_waters", "n_missing_residues", "status")


@query("first_alternatives", f"WITH {L_SQL} SELECT structure_id, line_no, '' AS altloc FROM l WHERE altloc IN ('', 'A')")
def first_alternatives(spark, sf_dir):
    return selection.first_alternative(atoms(spark, sf_dir)).select("structure_id", "line_no", "altloc")


@query("geometry_view", f"WITH {L_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY structure_id, chain, resseq, atom_name ORDER BY occupancy DESC, line_no) AS rn FROM l) SELECT structure_id, line_no, occupancy FROM q WHERE rn = 1")
def geometry_view(spark, sf_dir):
    return selection.highest_occupancy(atoms(spark, sf_dir)).select("structure_id", "line_no", "occupancy")


EXPECTED = {"structure_id": "concat('S', s_suppkey)", "comp_id": "CASE WHEN s_suppkey % 5 = 0 THEN 'ZZZ' ELSE 'LIG' END"}
FILE_SQL = f"""
{L_SQL}, f AS (SELECT structure_id, rpad('HEADER', 62, ' ') || CASE WHEN substr(structure_id, 2)::BIGINT % 7 = 0 THEN 'XXXX' ELSE structure_id END || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY line_no, {LINE_SQL}) AS t,
  count(*) AS atom_count, bool_or(record = 'HETATM' AND resname = 'LIG') AS lig FROM l GROUP BY structure_id),
m AS (SELECT x.structure_id, comp_id, t IS NOT NULL AS downloaded, sha256(t) AS sha256, strlen(t)::BIGINT AS bytes, atom_count, CASE WHEN t IS NOT NULL THEN substr(x.structure_id, 2)::BIGINT % 7 <> 0 AND length(x.structure_id) <= 4 ELSE false END AS id_match, coalesce(lig AND comp_id = 'LIG', false) AS ligand_found
  FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in EXPECTED.items())} FROM supplier) x LEFT JOIN f USING (structure_id)),
mm AS (SELECT *, CASE WHEN NOT downloaded THEN 'DOWNLOAD_FAILED' WHEN NOT id_match THEN 'ID_MISMATCH' WHEN NOT ligand_found THEN 'LIGAND_NOT_FOUND' ELSE 'OK' END AS status FROM m)
"""


def verified(spark, sf_dir):
    """Structures as files: a header with an id, wrong for some, and the atom lines."""
    rows = atom_lines(spark, sf_dir).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    own = F.when(F.expr("CAST(substring(structure_id, 2) AS BIGINT) % 7 = 0"), "XXXX").otherwise(F.col("structure_id"))
    body = F.concat(F.rpad(F.lit("HEADER"), 62, " "), own, F.lit("\n"), F.array_join(F.transform("l", lambda s: s["line"]), "\n"))
    expected = table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in EXPECTED.items()])
    return text.integrity(rows.select("structure_id", body.cast("binary").alias("content")), expected)


@query("integrity_manifest", f"WITH {FILE_SQL} SELECT structure_id, comp_id, downloaded, sha256, bytes, atom_count, id_match, ligand_found, status FROM mm")
def integrity_manifest(spark, sf_dir):
    m = verified(spark, sf_dir)
    return m.select("structure_id", "comp_id", "downloaded", "sha256", "bytes", F.col("atom_count").cast("long").alias("atom_count"), "id_match", "ligand_found", "status")


SKIP_SQL = f"""
WITH {FILE_SQL}, k AS (SELECT structure_id, CASE WHEN substr(structure_id, 2)::BIGINT % 3 = 0 THEN 'old' ELSE sha256 END AS known, status FROM mm)
SELECT mm.structure_id, CASE WHEN known = sha256 AND k.status = 'OK' THEN 'SKIPPED_ALREADY_PRESENT' ELSE mm.status END AS status FROM mm JOIN k USING (structure_id)
"""


@query("skip_present", SKIP_SQL)
def skip_present(spark, sf_dir):
    """A manifest in which a third of the checksums are of older files."""
    from lodestone.streaming.incremental import skip_present as skip

    m = verified(spark, sf_dir)
    old = F.when(F.expr("CAST(substring(structure_id, 2) AS BIGINT) % 3 = 0"), "old").otherwise(F.col("sha256"))
    return skip(m.select("structure_id", old.alias("sha256"), "status"), m).select("structure_id", "status")


FASTA_SQL = """
SELECT doc_id, md5(string_agg(trim(l[i]), '' ORDER BY i)) AS md5, sum(length(trim(l[i])))::BIGINT AS n
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE NOT starts_with(l[i], '>') GROUP BY doc_id
"""


@query("fasta_sequences", FASTA_SQL)
def fasta_sequences(spark, sf_dir):
    s = text.fasta(text.lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"]), ["doc_id"])
    return s.select("doc_id", F.md5(F.col("sequence").cast("binary")).alias("md5"), F.length("sequence").cast("long").alias("n"))


@query("parameter_names", "SELECT p_brand AS structure_id, p_partkey AS line_no, trim(substr(p_type, 1, 4)) AS name FROM part")
def parameter_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.format_string("ATOM %-4s %s", F.substring("p_type", 1, 4), "p_name")
    other = F.format_string("BOND %-4s", F.substring("p_type", 1, 4))
    rows = p.select(F.col("p_brand").alias("structure_id"), F.col("p_partkey").alias("line_no"), F.explode(F.array(line, other)).alias("line"))
    return text.parameter_atoms(rows)


@query("first_lines", "SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, least(len(l), 3) + 1)) AS i)")
def first_lines(spark, sf_dir):
    """The first three lines of each text."""
    return text.lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"]).filter("line_no < 3")

