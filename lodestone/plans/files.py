"""Queries on component, molecule and table files, laid out from the given tables.

An order's line items are the atoms of a molecule, each bonded to the next one.
"""

from pyspark.sql import functions as F

from lodestone.functions.storage import work_dir
from lodestone.operators import molgraph, selection
from lodestone.plans.tables import query, table
from lodestone.sources import cif, molecules, tables, text

#: Fields of an atom, the same in Spark and DuckDB, with k its number from 1 and n the molecule's size.
ATOM = {
    "name": "CASE l_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'O5''' WHEN 2 THEN 'C A' ELSE 'S1' END",
    "elem": "CASE l_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'O' WHEN 2 THEN 'C' ELSE 'S' END",
    "charge": "CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 END",
    "x": "l_quantity * CAST(0.5 AS DOUBLE)",
    "y": "l_linenumber * CAST(1.25 AS DOUBLE)",
    "z": "(l_partkey % 50) * CAST(0.25 AS DOUBLE)",
    "bond": "CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END",
    "linked": "l_returnflag <> 'A'",
    "side": "CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END",
    "seq": "CAST(l_partkey AS STRING)",
}
KEY = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_extendedprice"
I_SQL = f"i AS (SELECT l_orderkey AS structure_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {KEY}) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, {', '.join(f'{e} AS {c}' for c, e in ATOM.items())} FROM lineitem)"


def items(spark, sf_dir):
    """(structure_id, items): the atoms of each molecule in order."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS structure_id", f"struct({KEY}) AS key", f"struct({', '.join(f'{e} AS {c}' for c, e in ATOM.items())}) AS a")
    g = li.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("key", "a"))).alias("l"))
    return g.select("structure_id", F.transform("l", lambda s: s["a"]).alias("l"))


def loop(category, columns, rows):
    head = "loop_\n" + "".join(f"_{category}.{c}\n" for c in columns)
    return F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit("\n#\n"))


def component_files(spark, sf_dir):
    """Two loops of atoms and bonds, then one of links; names with blanks or quotes are quoted."""
    quoted = lambda t: F.when(t.contains("'"), F.concat(F.lit('"'), t, F.lit('"'))).when(t.contains(" "), F.concat(F.lit("'"), t, F.lit("'"))).otherwise(t)
    number = lambda v: F.format_string("%.3f", v)
    atom = F.transform("l", lambda a, k: F.concat_ws(" ", F.lit("LIG"), quoted(a["name"]), a["elem"], F.coalesce(a["charge"].cast("string"), F.lit("?")), number(a["x"]), number(a["y"]), number(a["z"])))
    order = lambda a: F.when(a["bond"] == 1, "SING N").when(a["bond"] == 2, "DOUB N").when(a["bond"] == 3, "TRIP N").otherwise("SING Y")
    last = F.size("l") - 1
    bond = F.filter(F.transform("l", lambda a, k: F.when(k < last, F.concat_ws(" ", F.lit("LIG"), quoted(a["name"]), quoted(F.get("l", k + 1)["name"]), order(a)))), lambda x: x.isNotNull())
    side = lambda a, k: F.when(a["side"] == k, F.concat(F.lit("LIG A . "), quoted(a["name"]))).otherwise(F.concat(F.lit("CYS B "), a["seq"], F.lit(" SG")))
    link = F.transform("l", lambda a: F.concat_ws(" ", F.when(a["linked"], "covale").otherwise("metalc"), number(a["x"]), side(a, 1), side(a, 2)))
    sides = [f"ptnr{k}_{c}" for k in (1, 2) for c in ("label_comp_id", "label_asym_id", "auth_seq_id", "label_atom_id")]
    value = F.concat(
        F.lit("data_LIG\n#\n"), loop("chem_comp_atom", ["comp_id", "atom_id", "type_symbol", "charge", "model_Cartn_x", "model_Cartn_y", "model_Cartn_z"], atom),
        loop("chem_comp_bond", ["comp_id", "atom_id_1", "atom_id_2", "value_order", "pdbx_aromatic_flag"], bond), loop("struct_conn", ["conn_type_id", "pdbx_dist_value", *sides], link),
    )
    return items(spark, sf_dir).select("structure_id", value.alias("value"), F.lit("LIG").alias("ligand"))


@query("cif_atoms", f"WITH {I_SQL} SELECT structure_id, (k - 1)::INT AS row_no, 'LIG' AS comp_id, name AS atom_id, elem AS type_symbol, charge, x, y, z FROM i")
def cif_atoms(spark, sf_dir):
    return cif.component_atoms(component_files(spark, sf_dir))


@query("cif_bonds", f"WITH {I_SQL} SELECT a.structure_id, (a.k - 1)::INT AS row_no, 'LIG' AS comp_id, a.name AS atom_id_1, b.name AS atom_id_2, a.bond AS bond_order FROM i a JOIN i b ON a.structure_id = b.structure_id AND b.k = a.k + 1")
def cif_bonds(spark, sf_dir):
    return cif.component_bonds(component_files(spark, sf_dir))


LINK_SQL = f"""
WITH {I_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY k) AS rn FROM i WHERE linked AND side > 0)
SELECT structure_id, 'CYS' AS protein_resname, seq AS protein_resnum, 'SG' AS protein_atom, 'LIG' AS ligand_resname, name AS ligand_atom, x AS bond_distance FROM r WHERE rn = 1
"""


@query("covalent_links", LINK_SQL)
def covalent_links(spark, sf_dir):
    return cif.covalent_links(component_files(spark, sf_dir))


def numbered(arrays):
    return arrays.select("structure_id", F.posexplode("lines").alias("line_no", "line"))


def mol2_arrays(spark, sf_dir):
    kind = lambda a: F.when(a["elem"] == "C", "C.3").when(a["elem"] == "N", "N.ar").when(a["elem"] == "O", "O.2").otherwise("S.3")
    atom = F.transform("l", lambda a, k: F.format_string("%7d %-4s %9.4f %9.4f %9.4f %-5s 1 LIG %8.4f", k + 1, F.regexp_replace(a["name"], " ", ""), a["x"], a["y"], a["z"], kind(a), F.coalesce(a["charge"], F.lit(0)).cast("double")))
    last = F.size("l") - 1
    code = lambda a: F.when(a["bond"] == 4, "ar").otherwise(a["bond"].cast("string"))
    bond = F.filter(F.transform("l", lambda a, k: F.when(k < last, F.format_string("%6d %4d %4d %s", k + 1, k + 1, k + 2, code(a)))), lambda x: x.isNotNull())
    one = lambda *t: F.array(*[F.lit(x) for x in t])
    lines = F.concat(one("# a comment", "@<TRIPOS>MOLECULE", "LIG", "", "@<TRIPOS>ATOM"), atom, one("@<TRIPOS>BOND"), bond)
    return items(spark, sf_dir).select("structure_id", lines.alias("lines"))


def mol2_lines(spark, sf_dir):
    return numbered(mol2_arrays(spark, sf_dir))


@query("mol2_atoms", f"WITH {I_SQL} SELECT structure_id, 1 AS mol_no, k::INT AS atom_id, replace(name, ' ', '') AS name, x, y, z, CASE elem WHEN 'C' THEN 'C.3' WHEN 'N' THEN 'N.ar' WHEN 'O' THEN 'O.2' ELSE 'S.3' END AS sybyl_type, elem, coalesce(charge, 0)::DOUBLE AS partial_charge FROM i")
def mol2_atoms(spark, sf_dir):
    return molecules.mol2_atoms(mol2_lines(spark, sf_dir))


BOND_SQL = f"WITH {I_SQL} SELECT structure_id, 1 AS mol_no, k::INT AS a1, (k + 1)::INT AS a2, bond AS bond_order FROM i WHERE k < n"


@query("mol2_bonds", BOND_SQL)
def mol2_bonds(spark, sf_dir):
    return molecules.mol2_bonds(mol2_lines(spark, sf_dir))


def sdf_arrays(spark, sf_dir):
    atom = F.transform("l", lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", a["x"], a["y"], a["z"], a["elem"]))
    last = F.size("l") - 1
    bond = F.filter(F.transform("l", lambda a, k: F.when(k < last, F.format_string("%3d%3d%3d  0", k + 1, k + 2, a["bond"]))), lambda x: x.isNotNull())
    charge = F.filter(F.transform("l", lambda a, k: F.when(a["charge"].isNotNull(), F.format_string("M  CHG%3d%4d%4d", F.lit(1), k + 1, a["charge"]))), lambda x: x.isNotNull())
    head = F.array(F.lit("LIG"), F.lit("  laid out"), F.lit(""), F.format_string("%3d%3d  0  0  0  0            999 V2000", F.size("l"), last))
    return items(spark, sf_dir).select("structure_id", F.concat(head, atom, bond, charge, F.array(F.lit("M  END"), F.lit("$$$$"))).alias("lines"))


def sdf_lines(spark, sf_dir):
    return numbered(sdf_arrays(spark, sf_dir))


@query("sdf_atoms", f"WITH {I_SQL} SELECT structure_id, 1 AS mol_no, k::INT AS atom_id, x, y, z, elem FROM i")
def sdf_atoms(spark, sf_dir):
    return molecules.sdf_atoms(sdf_lines(spark, sf_dir))


@query("sdf_bonds", BOND_SQL)
def sdf_bonds(spark, sf_dir):
    return molecules.sdf_bonds(sdf_lines(spark, sf_dir))


@query("formal_charges", f"WITH {I_SQL} SELECT structure_id, 1 AS mol_no, k::INT AS atom_id, charge AS formal_charge FROM i WHERE charge IS NOT NULL")
def formal_charges(spark, sf_dir):
    return molecules.formal_charges(sdf_lines(spark, sf_dir))


PART_ITEMS = 125_000  # atoms of a library's file, about


def written(spark, sf_dir, arrays):
    """Four libraries of molecules, each in order of its ids: a folder ``lib`` a library, and in it a file ``part`` for each range of ids.

    Files are of a bounded size, so no task holds a library.
    """
    path = work_dir(spark)
    ids = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi")).first()
    parts = max(ids["n"] // (4 * PART_ITEMS), 1)
    width = ((ids["hi"] or 0) - (ids["lo"] or 0)) // parts + 1
    own = F.when(F.col("structure_id").isNotNull(), F.concat(F.lit("L"), F.col("structure_id").cast("string")))
    value = F.array_join(F.transform("lines", lambda x: F.when(x == "LIG", own).otherwise(x)), "\n")
    one = arrays(spark, sf_dir).select("structure_id", value.alias("value"), (F.col("structure_id") % 4).alias("lib"), F.floor((F.col("structure_id") - F.lit(ids["lo"])) / F.lit(width)).cast("int").alias("part"))
    one = one.repartition(4 * parts, "lib", "part").sortWithinPartitions("lib", "part", "structure_id")
    one.select("value", "lib", "part").write.partitionBy("lib", "part").text(path)
    return path


L_SQL = f"{I_SQL}, m AS (SELECT structure_id, (structure_id % 4)::INT AS lib, row_number() OVER (PARTITION BY structure_id % 4 ORDER BY structure_id) AS mol_no FROM (SELECT DISTINCT structure_id FROM i)), j AS (SELECT i.*, lib, mol_no, 'L' || i.structure_id AS title FROM i JOIN m USING (structure_id))"


@query("library_atoms", f"WITH {L_SQL} SELECT lib, mol_no, title, k::INT AS atom_id, x, y, z, elem FROM j")
def library_atoms(spark, sf_dir):
    """Records of large files, read in byte ranges; numbers count on over the ranges of a file."""
    return molecules.library_atoms(molecules.sdf_library(spark, written(spark, sf_dir, sdf_arrays), "part")).drop("structure_id", "part")


@query("library_bonds", f"WITH {L_SQL} SELECT lib, mol_no, title, k::INT AS a1, (k + 1)::INT AS a2, bond AS bond_order FROM j WHERE k < n")
def library_bonds(spark, sf_dir):
    return molecules.library_bonds(molecules.sdf_library(spark, written(spark, sf_dir, sdf_arrays), "part")).drop("structure_id", "part")


@query("library_charges", f"WITH {L_SQL} SELECT lib, mol_no, title, k::INT AS atom_id, charge AS formal_charge FROM j WHERE charge IS NOT NULL")
def library_charges(spark, sf_dir):
    return molecules.library_charges(molecules.sdf_library(spark, written(spark, sf_dir, sdf_arrays), "part")).drop("structure_id", "part")


@query("library_mol2_atoms", f"WITH {L_SQL} SELECT lib, mol_no, title, k::INT AS atom_id, replace(name, ' ', '') AS name, x, y, z, CASE elem WHEN 'C' THEN 'C.3' WHEN 'N' THEN 'N.ar' WHEN 'O' THEN 'O.2' ELSE 'S.3' END AS sybyl_type, elem, coalesce(charge, 0)::DOUBLE AS partial_charge FROM j")
def library_mol2_atoms(spark, sf_dir):
    return molecules.library_mol2_atoms(molecules.mol2_library(spark, written(spark, sf_dir, mol2_arrays), "part")).drop("structure_id", "part")


@query("library_mol2_bonds", f"WITH {L_SQL} SELECT lib, mol_no, title, k::INT AS a1, (k + 1)::INT AS a2, bond AS bond_order FROM j WHERE k < n")
def library_mol2_bonds(spark, sf_dir):
    return molecules.library_mol2_bonds(molecules.mol2_library(spark, written(spark, sf_dir, mol2_arrays), "part")).drop("structure_id", "part")


@query("fasta_library", "SELECT (c_custkey % 4)::INT AS lib, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS entry, c_name AS header, replace(c_mktsegment || c_name, ' ', '') AS sequence FROM customer")
def fasta_library(spark, sf_dir):
    """Four files of entries of two lines each."""
    path = work_dir(spark)
    c = table(spark, sf_dir, "customer").withColumn("lib", F.col("c_custkey") % 4)
    c.repartition(4, "lib").sortWithinPartitions("lib", "c_custkey").select(F.concat(F.lit(">"), F.col("c_name"), F.lit("\n"), F.regexp_replace("c_mktsegment", " ", ""), F.lit("\n"), F.regexp_replace("c_name", " ", "")).alias("value"), "lib").write.partitionBy("lib").text(path)
    return text.fasta_records(spark, path).drop("structure_id")


def molecule(spark, sf_dir):
    """The molecules as atom and bond tables, every third atom a hydrogen."""
    l = items(spark, sf_dir).select(F.col("structure_id").alias("mol_id"), F.posexplode("l").alias("at", "a"))  # noqa: E741
    elem = F.when(F.col("at") % 3 == 1, "H").otherwise(F.col("a.elem"))
    atoms = l.select("mol_id", (F.col("at") + 1).alias("atom_id"), elem.alias("elem"), F.col("a.name").alias("name"), "a.bond")
    bonds = items(spark, sf_dir).select(F.col("structure_id").alias("mol_id"), F.size("l").alias("n"), F.posexplode("l").alias("at", "a")).filter("at + 1 < n")
    return atoms, bonds.select("mol_id", (F.col("at") + 2).alias("a1"), (F.col("at") + 1).alias("a2"), F.col("a.bond").alias("bond_order"))


ORDER_SQL = f"""
WITH {I_SQL}, a AS (SELECT structure_id, k, k % 3 = 2 AS h FROM i),
t AS (SELECT structure_id AS mol_id, 'atom' AS kind, k::INT AS one, 0 AS two, row_number() OVER (PARTITION BY structure_id ORDER BY h, k)::INT AS place FROM a
UNION ALL SELECT structure_id, 'bond', k::INT, (k + 1)::INT, row_number() OVER (PARTITION BY structure_id ORDER BY k)::INT FROM i WHERE k < n) SELECT * FROM t
"""


@query("molecule_order", ORDER_SQL)
def molecule_order(spark, sf_dir):
    """Places of heavy atoms before hydrogens, and of bonds by their ends."""
    a, b = molgraph.ordered(*molecule(spark, sf_dir))
    return a.select("mol_id", F.lit("atom").alias("kind"), F.col("atom_id").alias("one"), F.lit(0).alias("two"), "place").unionByName(b.select("mol_id", F.lit("bond").alias("kind"), F.col("lo").alias("one"), F.col("hi").alias("two"), "place"))


UNIQUE_SQL = f"""
WITH {I_SQL}, a AS (SELECT structure_id AS mol_id, k, elem, elem || CASE WHEN bond = 4 THEN '' ELSE bond::VARCHAR END AS name FROM i),
c AS (SELECT *, count(*) OVER (PARTITION BY mol_id, name) > 1 AS clash FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY mol_id, elem ORDER BY k) AS at FROM c WHERE clash),
f AS (SELECT mol_id, elem, number, row_number() OVER (PARTITION BY mol_id, elem ORDER BY number) AS at FROM (SELECT DISTINCT mol_id, elem FROM d) g, (SELECT unnest(range(1, 60)) AS number)
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE NOT clash AND c.mol_id = g.mol_id AND c.name = g.elem || number))
SELECT mol_id, k::INT AS atom_id, elem, name FROM c WHERE NOT clash UNION ALL SELECT d.mol_id, k::INT, d.elem, d.elem || number FROM d JOIN f ON f.mol_id = d.mol_id AND f.elem = d.elem AND f.at = d.at
"""


@query("unique_names", UNIQUE_SQL)
def unique_names(spark, sf_dir):
    """Atom names of element and number, with repeats in most molecules."""
    a = items(spark, sf_dir).select(F.col("structure_id").alias("mol_id"), F.posexplode("l").alias("at", "a"))
    name = F.concat(F.col("a.elem"), F.when(F.col("a.bond") == 4, "").otherwise(F.col("a.bond").cast("string")))
    return selection.unique_names(a.select("mol_id", (F.col("at") + 1).alias("atom_id"), F.col("a.elem").alias("elem"), name.alias("name")), ["mol_id"])


STATUS = {"has_structure": "p_size % 7 <> 0", "has_mol2": "p_size % 5 <> 0", "has_params": "p_size % 3 <> 0", "names_match": "p_size % 2 = 0"}


@query("parameter_status", f"SELECT p_partkey, CASE WHEN NOT ({STATUS['has_structure']}) THEN 'NO_CLEAN_PDB_FOUND' WHEN NOT ({STATUS['has_mol2']}) THEN 'MOL2_GENERATION_FAILED' WHEN NOT ({STATUS['has_params']}) THEN 'PARAMS_GENERATION_FAILED' WHEN {STATUS['names_match']} THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status FROM part")
def parameter_status(spark, sf_dir):
    e = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in STATUS.items()])
    return molgraph.parameter_status(e).select("p_partkey", "status")


@query("csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Written as CSV and read by a declared schema, in which an id stays text."""
    path = work_dir(spark)
    tables.write_csv(table(spark, sf_dir, "customer"), path)
    return tables.csv(spark, path, "c_custkey string, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("partition_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def partition_round_trip(spark, sf_dir):
    """A folder a status; one that is written again replaces its own rows only."""
    path = work_dir(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    tables.write_partitions(o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))), path, "o_orderstatus")
    tables.write_partitions(o.filter("o_orderstatus = 'F'"), path, "o_orderstatus")
    return tables.parquet(spark, path)


@query("structure_files", "SELECT 'B' || replace(p_brand, 'Brand#', '') AS structure_id, p_partkey AS line_no, 'ATOM  ' || p_name AS line FROM part")
def structure_files(spark, sf_dir):
    """A folder of text for each brand, read again as numbered lines and as whole files."""
    path = work_dir(spark)
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("B"), F.regexp_replace("p_brand", "Brand#", "")).alias("structure_id"), F.lit(1).alias("block"), F.col("p_partkey").alias("line_no"), F.concat(F.lit("ATOM  "), F.col("p_name")).alias("line"))
    tables.write_structures(p, path)
    own = spark.read.text(path).select("structure_id", F.col("value").alias("line"))
    # lines stand in order of their numbers, so the k-th of a folder is the k-th part
    numbered = text.lines_of(own.groupBy("structure_id").agg(F.array_join(F.collect_list("line"), "\n").alias("t")), "t", ["structure_id"])
    place = F.row_number().over(selection.Window.partitionBy("structure_id").orderBy("line_no")) - 1
    return numbered.withColumnRenamed("line_no", "at").join(p.select("structure_id", "line_no", place.alias("at")).hint("merge"), ["structure_id", "at"]).select("structure_id", "line_no", "line")


@query("override_table", "SELECT r_name, r_regionkey, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS side, CASE r_name WHEN 'ASIA' THEN 'large' END AS note FROM region")
def override_table(spark, sf_dir):
    o = tables.overrides(spark, {"ASIA": {"side": "east", "note": "large"}, "EUROPE": {"side": "west"}}, "r_name")
    return table(spark, sf_dir, "region").select("r_name", "r_regionkey").join(F.broadcast(o), "r_name", "left").select("r_name", "r_regionkey", "side", "note")


@query("binary_files", "SELECT lib, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM (SELECT (p_partkey % 5)::VARCHAR AS lib, string_agg(p_partkey || ' ' || p_name || chr(10), '' ORDER BY p_partkey) AS t FROM part GROUP BY ALL)")
def binary_files(spark, sf_dir):
    """Files read as bytes: five of lines of parts, with their sizes and checksums."""
    path = work_dir(spark)
    p = table(spark, sf_dir, "part").withColumn("lib", (F.col("p_partkey") % 5).cast("string"))
    p.repartition(5, "lib").sortWithinPartitions("lib", "p_partkey").select("lib", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("value")).write.partitionBy("lib").text(path)
    b = text.binary(spark, path + "/lib=*").withColumn("lib", F.regexp_extract("path", "lib=([^/]*)/", 1))
    return b.select("lib", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
