from pyspark.sql import functions as F

from lodestone.operators import preparation, selection
from lodestone.sources import cif, molecules, tables, text


def atom(record, serial, name, alt, res, chain, seq, x, y, z, occ="1.00", elem="C"):
    return f"{record:<6}{serial:>5} {name:<4}{alt:1}{res:>3} {chain}{seq:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{occ:>6}{20.0:6.2f}          {elem:>2}"


LINES = [
    f"{'HEADER':<62}1ABC",
    "SEQRES   1 A    5  ALA CYS GLY CYS LYS",
    atom("ATOM", 1, " N", "", "ALA", "A", 10, 0, 0, 0, elem="N"),
    atom("ATOM", 2, " CA", "A", "ALA", "A", 10, 1, 0, 0, "0.40"),
    atom("ATOM", 3, " CA", "B", "ALA", "A", 10, 1.5, 0, 0, "0.60"),
    atom("ATOM", 4, " CA", "", "CYS", "A", 11, 4, 0, 0),
    atom("ATOM", 5, " SG", "", "CYS", "A", 11, 4, 2, 0, elem="S"),
    atom("ATOM", 6, " CA", "", "CYS", "A", 14, 8, 0, 0),
    atom("ATOM", 7, " SG", "", "CYS", "A", 14, 5, 3.5, 0, elem="S"),
    atom("HETATM", 8, " C1", "", "634", "A", 901, 4, 5, 0, ""),
    atom("HETATM", 9, " O", "", "HOH", "A", 1001, 4, 8, 0, elem="O"),
    atom("HETATM", 10, " O", "", "HOH", "A", 1002, 4, 19, 0, elem="O"),
    "END",
]


def load(spark, tmp_path):
    (tmp_path / "pdb").mkdir()
    (tmp_path / "pdb" / "1ABC.pdb").write_text("\n".join(LINES) + "\n")
    return text.lines(spark, str(tmp_path / "pdb"))


def test_atoms_and_cleaning(spark, tmp_path):
    numbered = load(spark, tmp_path)
    atoms = text.atoms(numbered)
    assert atoms.count() == 10 and {r.structure_id for r in atoms.collect()} == {"1ABC"}
    first = atoms.orderBy("line_no").first()
    assert (first.atom_name, first.resname, first.resseq, first.x, first.occupancy, first.element) == ("N", "ALA", 10, 0.0, 1.0, "N")
    assert [r.resname for r in text.polymer_sequences(numbered).orderBy("pos").collect()] == ["ALA", "CYS", "GLY", "CYS", "LYS"]
    chosen = spark.createDataFrame([("1ABC", "A", "A", "634", 901, "LG1")], "structure_id string, selected_chain string, ligand_chain string, ligand_comp_id string, ligand_resnum int, ligand_code string")
    clean = preparation.chosen_atoms(atoms, chosen)
    assert clean.filter("block = 1").count() == 6
    assert clean.filter("atom_name = 'CA' and resseq = 10").first().altloc == "A"
    lines = [r.line for r in preparation.clean_lines(clean).orderBy("block", "line_no").collect()]
    assert lines[0].startswith("REMARK") and lines[-1] == "END" and lines[-2][17:20] == "LG1" and "TER" in lines
    mapping = {(r.resseq, r.pose_resnum) for r in preparation.residue_mapping(clean).collect()}
    assert mapping == {(10, 1), (11, 2), (14, 3), (901, 4)}
    s = preparation.summary(chosen, clean, text.polymer_sequences(numbered), atoms).first()
    assert (s.status, s.protein_atom_count, s.ligand_atom_count, s.n_protein_residues, s.n_missing_residues) == ("OK", 6, 1, 3, 2)
    assert (s.n_altloc_atoms_removed, s.missing_residue_ranges, s.disulfide_pairs, s.n_bridging_waters) == (1, "12-13", "11-14", 1)


def test_written_structures_read_back(spark, tmp_path):
    numbered = load(spark, tmp_path)
    rows = numbered.withColumn("block", F.lit(0))
    tables.write_structures(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert [r.value for r in back.collect()] == LINES


def test_integrity(spark):
    content = ("\n".join(LINES)).encode()
    files = spark.createDataFrame([("1ABC", content)], "structure_id string, content binary")
    want = spark.createDataFrame([("1ABC", "634"), ("2XYZ", "AAA")], "structure_id string, comp_id string")
    got = {r.structure_id: r for r in text.integrity(files, want).collect()}
    assert got["1ABC"].status == "OK" and got["1ABC"].atom_count == 10 and got["1ABC"].bytes == len(content)
    assert got["2XYZ"].status == "DOWNLOAD_FAILED"


def test_fasta_and_parameters(spark):
    n = text.lines_of(spark.createDataFrame([("p", ">head\nABC\nDEF\n")], "structure_id string, value string"), "value", ["structure_id"])
    assert text.fasta(n).first().sequence == "ABCDEF"
    n = text.lines_of(spark.createDataFrame([("p", "NAME X\nATOM  C1  CH1\nATOM  H12 Hapo\n")], "structure_id string, value string"), "value", ["structure_id"])
    assert [r.name for r in text.parameter_atoms(n).orderBy("line_no").collect()] == ["C1", "H12"]


CIF = """data_FMM
#
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.atom_id
_chem_comp_atom.type_symbol
_chem_comp_atom.charge
_chem_comp_atom.model_Cartn_x
_chem_comp_atom.model_Cartn_y
_chem_comp_atom.model_Cartn_z
FMM C1 C 0 1.5 2.5 -3.5
FMM "O1'" O -1 0.0 1.0 2.0
#
loop_
_chem_comp_bond.comp_id
_chem_comp_bond.atom_id_1
_chem_comp_bond.atom_id_2
_chem_comp_bond.value_order
_chem_comp_bond.pdbx_aromatic_flag
FMM C1 "O1'" DOUB N
#
_struct_conn.conn_type_id covale
_struct_conn.pdbx_dist_value 1.81
_struct_conn.ptnr1_label_comp_id FMM
_struct_conn.ptnr1_label_atom_id C1
_struct_conn.ptnr2_label_comp_id CYS
_struct_conn.ptnr2_label_atom_id SG
_struct_conn.ptnr2_auth_seq_id 797
#
"""


def test_cif(spark):
    files = spark.createDataFrame([("x", CIF, "FMM")], "structure_id string, value string, ligand string")
    a = cif.component_atoms(files).orderBy("row_no").collect()
    assert [(r.atom_id, r.type_symbol, r.charge, r.x, r.z) for r in a] == [("C1", "C", 0, 1.5, -3.5), ("O1'", "O", -1, 0.0, 2.0)]
    b = cif.component_bonds(files).first()
    assert (b.atom_id_1, b.atom_id_2, b.bond_order) == ("C1", "O1'", 2)
    link = cif.covalent_links(files).first()
    assert (link.protein_resname, link.protein_resnum, link.protein_atom, link.ligand_atom, link.bond_distance) == ("CYS", "797", "SG", "C1", 1.81)


MOL2 = """@<TRIPOS>MOLECULE
one
@<TRIPOS>ATOM
1 C1 0.0 0.0 0.0 C.ar 1 LIG 0.1
2 N1 1.0 0.0 0.0 N.3 1 LIG -0.1
@<TRIPOS>BOND
1 1 2 ar
@<TRIPOS>MOLECULE
two
@<TRIPOS>ATOM
1 O1 0.0 0.0 0.0 O.2 1 LIG 0.0
"""
SDF = "x\n\n\n  2  1  0\n    0.0000    0.0000    0.0000 C   0\n    1.2000    0.0000    0.0000 Cl  0\n  1  2  1  0\nM  CHG  1   2  -1\nM  END\n$$$$\ny\n\n\n  1  0  0\n    0.0000    0.0000    0.0000 O   0\nM  END\n$$$$\n"


def test_molecules(spark):
    n = text.lines_of(spark.createDataFrame([("f", MOL2)], "structure_id string, value string"), "value", ["structure_id"])
    a = molecules.mol2_atoms(n).orderBy("mol_no", "atom_id").collect()
    assert [(r.mol_no, r.name, r.elem, r.partial_charge) for r in a] == [(1, "C1", "C", 0.1), (1, "N1", "N", -0.1), (2, "O1", "O", 0.0)]
    assert [(r.mol_no, r.a1, r.a2, r.bond_order) for r in molecules.mol2_bonds(n).collect()] == [(1, 1, 2, 4)]
    n = text.lines_of(spark.createDataFrame([("f", SDF)], "structure_id string, value string"), "value", ["structure_id"])
    a = molecules.sdf_atoms(n).orderBy("mol_no", "atom_id").collect()
    assert [(r.mol_no, r.atom_id, r.elem, r.x) for r in a] == [(1, 1, "C", 0.0), (1, 2, "CL", 1.2), (2, 1, "O", 0.0)]
    assert [(r.mol_no, r.a1, r.a2, r.bond_order) for r in molecules.sdf_bonds(n).collect()] == [(1, 1, 2, 1)]
    assert [(r.mol_no, r.atom_id, r.formal_charge) for r in molecules.formal_charges(n).collect()] == [(1, 2, -1)]


def test_paths_and_overrides(spark):
    p = tables.Paths("in", "out", "cp")
    q = p.with_outputs(results="new", structures="s")
    assert (p.results, q.results, q.data) == ("out", "new", "in") and q.structure_folder("1A", "L") == "s/1A_L" and p.structure_folder("1A", "L") is None
    assert p.target("t", "1A") == "out/test/t_1A" and p.target("t") == "out/t"
    o = tables.overrides(spark, {"1E10": {"ligand_comp_id": "634"}, "2B": {"chain": "A"}})
    assert {(r.pdb_id, r.chain, r.ligand_comp_id) for r in o.collect()} == {("1E10", None, "634"), ("2B", "A", None)}


def test_first_alternative(spark):
    d = spark.createDataFrame([("A",), ("B",), ("",), (None,)], "altloc string")
    assert selection.first_alternative(d).count() == 3


def test_sinks_and_skips(spark, tmp_path):
    from lodestone.streaming.incremental import skip_present

    out = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "structure_id string, v int")
    tables.write_partitions(a, out)
    tables.write_partitions(spark.createDataFrame([("b", 9)], "structure_id string, v int"), out)
    assert {(r.structure_id, r.v) for r in tables.parquet(spark, out).collect()} == {("a", 1), ("b", 9)}
    tables.write_csv(spark.createDataFrame([("1E10", 1.5)], "id string, v double"), str(tmp_path / "c"), one_file=True)
    row = tables.csv(spark, str(tmp_path / "c"), "id string, v double").first()
    assert (row.id, row.v) == ("1E10", 1.5)
    (tmp_path / "j.json").write_text('{"pdb_id": "1A", "resolution": 2.5}')
    assert tables.json(spark, str(tmp_path / "j.json"), "pdb_id string, resolution double").first().resolution == 2.5
    manifest = spark.createDataFrame([("a", "x", "OK"), ("b", "y", "ID_MISMATCH")], "structure_id string, sha256 string, status string")
    landed = spark.createDataFrame([("a", "x", "OK"), ("b", "y", "ID_MISMATCH"), ("c", "z", "OK")], "structure_id string, sha256 string, status string")
    assert {r.structure_id: r.status for r in skip_present(manifest, landed).collect()} == {"a": "SKIPPED_ALREADY_PRESENT", "b": "ID_MISMATCH", "c": "OK"}


def test_quality_of_copies_and_chains(spark, tmp_path):
    atoms = text.atoms(load(spark, tmp_path))
    q = selection.copy_quality(atoms.filter("resname = '634'")).first()
    assert (q.mean_occupancy, q.n_altloc_atoms) == (1.0, 0)
    c = selection.completeness(atoms.filter("record = 'ATOM'")).first()
    assert (c.n_modelled, c.n_missing_ca) == (3, 0)
    b = text.binary(spark, str(tmp_path / "pdb")).first()
    assert b.structure_id == "1ABC" and b.content.startswith(b"HEADER")
    r = {x.resseq: (x.aa1, x.x) for x in text.residues(selection.highest_occupancy(atoms)).collect()}
    assert r == {10: ("A", 1.5), 11: ("C", 4.0), 14: ("C", 8.0)}


def test_parameter_status(spark):
    from lodestone.operators.molgraph import parameter_status

    e = [("a", False, False, False, False), ("b", True, False, False, False), ("c", True, True, False, False), ("d", True, True, True, True), ("e", True, True, True, False)]
    d = spark.createDataFrame(e, "id string, has_structure boolean, has_mol2 boolean, has_params boolean, names_match boolean")
    assert [r.status for r in parameter_status(d).orderBy("id").collect()] == ["NO_CLEAN_PDB_FOUND", "MOL2_GENERATION_FAILED", "PARAMS_GENERATION_FAILED", "OK", "NEEDS_REVIEW"]


def test_work_folder_without_setting(spark, monkeypatch):
    from lodestone.functions import storage

    assert storage.work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    class Bare:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    one, two = storage.work_dir(Bare), storage.work_dir(Bare)
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]
    d = storage.materialised(spark.range(5))
    assert d.count() == 5
    storage.drop_written(d)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cif_tokens_are_found_once(spark, tmp_path):
    """Conditions on blocks and tokens find neither again, and links read their files once."""
    value = "data_X\nloop_\n_struct_conn.conn_type_id\n_struct_conn.ptnr1_label_comp_id\n_struct_conn.ptnr2_label_comp_id\n_struct_conn.ptnr1_label_atom_id\n_struct_conn.ptnr2_label_atom_id\ncovale CYS LIG SG 'C 1'\ncovale LIG CYS \"O5'\" .\n#\n"
    spark.createDataFrame([("s", value, "LIG")], "structure_id string, value string, ligand string").write.parquet(str(tmp_path / "f"))
    links = cif.covalent_links(spark.read.parquet(str(tmp_path / "f")))
    plan = plan_of(links)
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(") == 1 and plan.count("Relation [") == 1
    assert [(r.protein_resname, r.protein_atom, r.ligand_resname, r.ligand_atom) for r in links.collect()] == [("CYS", "SG", "LIG", "C 1")]


def test_lines_are_laid_out_once(spark):
    """Fields of a record come from one line, and lines around a structure from one pass over what is cleaned."""
    from conftest import SF

    from lodestone.plans import preparation as plans

    for name, f in (("chain_completeness", plans.chain_completeness), ("ligand_copies", plans.ligand_copies), ("cleaned_atoms", plans.cleaned_atoms), ("clean_lines", plans.clean_lines)):
        plan = plan_of(f(spark, SF))
        assert plan.count("format_string(%-6s") == 1, name
