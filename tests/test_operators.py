import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import ensemble, metadata, molgraph, relational, selection, stats
from lodestone.streaming import incremental


def test_partners_and_thresholds(spark):
    c = spark.createDataFrame([("s", 1, 2), ("s", 1, 3), ("s", 2, 4)], "structure_id string, resi int, resj int")
    got = {}
    for r in ensemble.partners(c).collect():
        got.setdefault(r.i, set()).add(r.k)
    assert got == {1: {2, 3}, 2: {1, 4}, 3: {1}, 4: {2}}
    f = spark.createDataFrame([(x,) for x in (1.5, 0.79, -1.5, -1.01, 0.0, 0.77, -0.99, math.nan)], "f double")
    labels = [r[0].split("_")[0] for r in f.select(scalar.three_way(F.col("f"))).collect()]
    assert labels == ["minimally", "minimally", "highly", "highly", "neutral", "neutral", "neutral", "neutral"]


def test_pocket_summary_golden(spark):
    rows = [("s", 1, 6, "minimally_frustrated"), ("s", 2, 7, "highly_frustrated"), ("s", 3, 8, "neutral"), ("s", 4, 9, "minimally_frustrated"), ("s", 5, 10, "neutral")]
    s = spark.createDataFrame(rows, "structure_id string, resi int, resj int, frustration_class string")
    region = spark.createDataFrame([("s", 1), ("s", 3)], "structure_id string, resi int")
    r = ensemble.region_summary(s, region).first()
    assert (r.n_contacts_total, r.n_minimally_frustrated, r.n_neutral, r.n_highly_frustrated, r.frac_minimally) == (2, 1, 1, 0, 0.5)


def test_z_score_golden(spark):
    decoys = [-3.0, -4.0, -6.0, -7.0, -5.5, -4.5, -3.5, -6.5, -5.0, -4.0]
    rows = [("s", 0, 1, 2, -5.0)] + [("s", k + 1, 1, 2, d) for k, d in enumerate(decoys)]
    v = spark.createDataFrame(rows, "structure_id string, replicate int, resi int, resj int, energy double")
    r = ensemble.ensemble_score(v, F.col("replicate") == 0).first()
    mean = sum(decoys) / 10
    sd = math.sqrt(sum((d - mean) ** 2 for d in decoys) / 9)
    assert r.F_index == pytest.approx((mean + 5.0) / sd) and r.n_decoys == 10


def test_survey_equals_every_contact_in_every_replicate(spark):
    draw = random.Random(3)
    c = [(s, i, j) for s in range(3) for i in range(12) for j in range(i + 3, 12)]
    t = [(s, r, i, j, term, draw.gauss(-1, 3)) for s, i, j in c if i < 9 for r in range(1 if s == 2 else 0, 7) if r == 6 or draw.random() < 0.2 for term in ("a", "fa_rep")]
    t += [(0, 1, 40, 41, "a", -5.0), (1, None, 0, 3, "a", -5.0), (1, 2, 0, 3, "a", None), (0, 9, 50, 60, "a", 1.0)]
    contacts = spark.createDataFrame([*c, *c[:5], (7, 0, 3)], "structure_id long, resi long, resj long")
    terms = spark.createDataFrame(t, "structure_id long, replicate long, resi long, resj long, term string, value double")
    edges = ensemble.edge_energy(terms, {"a": 2.0})
    whole = ensemble.ensemble_score(ensemble.neighbourhood_energy(ensemble.on_contacts(contacts, edges, terms)), F.col("replicate") == 0)
    key = ["structure_id", "resi", "resj", "n_decoys", "frustration_class"]
    row = lambda r: (tuple(r[k] for k in key), [r[k] for k in ("E_native", "decoy_mean", "decoy_std", "F_index")])
    want, got = (sorted(row(r) for r in d.collect()) for d in (whole, ensemble.survey(contacts, terms, {"a": 2.0})))
    assert [k for k, _ in got] == [k for k, _ in want] and {k[0] for k, _ in got} == {0, 1}
    for (_, a), (_, b) in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_contact_energy_has_rows_where_edges_are(spark):
    contacts = spark.range(0, 1000).selectExpr("0 as structure_id", "id as resi", "id + 4 as resj")
    edges = spark.createDataFrame([(0, r, 8, 12, -1.0) for r in range(50)], "structure_id int, replicate int, resi long, resj long, e double")
    r = ensemble.contact_energy(contacts, edges)
    assert r.count() == 3 * 50  # the contact, and one at either end
    assert {(x.resi, x.energy) for x in r.filter("replicate = 3").collect()} == {(4, -0.5), (8, -1.0), (12, -0.5)}


def test_survey_terms(spark):
    c = spark.createDataFrame([("s", 1, 5), ("s", 1, 6)], "structure_id string, resi int, resj int")
    t = [("s", k, 1, 5, term, v * (1 + k)) for k in range(4) for term, v in (("a", 1.0), ("fa_rep", 100.0))]
    terms = spark.createDataFrame(t, "structure_id string, replicate int, resi int, resj int, term string, value double")
    r = {(x.resi, x.resj): x for x in ensemble.survey(c, terms, {"a": 2.0}).collect()}
    # pair (1, 6) has no edge: e = 0, so Eq. 2 gives half of what point 1 shares
    assert r[(1, 5)].E_native == 2.0 and r[(1, 6)].E_native == 1.0
    assert r[(1, 5)].decoy_mean == pytest.approx(6.0)


def test_correlations(spark):
    d = spark.createDataFrame([(float(x), 2.0 * x + 1, 5.0) for x in range(6)], "x double, y double, k double")
    r = stats.correlation(d, "x", "y").first()
    assert (r.r, r.slope, r.intercept) == (pytest.approx(1), pytest.approx(2), pytest.approx(1))
    assert stats.correlation(d, "k", "y").first().r is None and stats.correlation(d.limit(2), "x", "y").first().r is None
    p = spark.createDataFrame([(0.5, 20)], "r double, n long").select(stats.t_test_p("r", "n").alias("p")).first().p
    assert p == pytest.approx(0.0247, abs=2e-4)


def test_motifs_and_copies(spark):
    letters = [("s", "A", p, a) for p, a in [(825, "H"), (826, "R"), (827, "D"), (845, "D"), (846, "F"), (847, "G"), (735, "K"), (752, "E")]] + [("s", "B", 835, "H")]
    d = spark.createDataFrame(letters, "structure_id string, chain string, pos int, aa string")
    keys = ("structure_id", "chain")
    hits = {835: selection.motif_hits(d, "HRD", low=700, high=900), 855: selection.motif_hits(d, "DFG", low=700, high=900)}
    off = selection.numbering_offset(d, hits)
    assert {(r.chain, r.offset) for r in off.collect()} == {("A", 10), ("B", None)}
    want = {745: "K", 762: "E", 835: "H", 836: "R", 837: "D", 855: "D", 856: "F", 857: "G"}
    r = {x.chain: x for x in selection.motif_check(d, off, want, keys=keys).collect()}
    assert (r["A"].n_ok, r["A"].all_ok, r["A"].calibration_status) == (8, True, "OFFSET_DETECTED(10)")
    assert (r["B"].n_missing, r["B"].all_ok, r["B"].calibration_status) == (8, False, "FAILED_MOTIF_NOT_FOUND")
    copies = spark.createDataFrame([("s", 1, 0.0, 0.0, 3.0), ("s", 2, 0.0, 0.0, 3.5), ("s", 3, 50.0, 0.0, 0.0)], "structure_id string, copy int, x double, y double, z double")
    residues = spark.createDataFrame([("s", "A", 735, 0.0, 0.0, 0.0), ("s", "A", 845, 0.0, 1.0, 0.0)], "structure_id string, chain string, resseq int, x double, y double, z double")
    dist = selection.pocket_distances(copies, residues, off, {"k": [745], "d": [855], "hinge": range(788, 796)})
    one = dist.filter("copy = 1").first()
    assert one.d_k == 3.0 and one.d_hinge is None and one.mean_pocket_dist == pytest.approx((3 + math.sqrt(10)) / 2)
    quality = spark.createDataFrame([("s", 1, 0.5, 0), ("s", 2, 1.0, 0), ("s", 3, 1.0, 0)], "structure_id string, copy int, mean_occupancy double, n_altloc_atoms int")
    complete = spark.createDataFrame([("s", "A", 0)], "structure_id string, chain string, n_missing_ca int")
    best = selection.select_copy(dist, quality, complete, selection.motif_check(d, off, want, keys=keys)).first()
    # within a band of 1 the higher occupancy decides
    assert (best.selected_copy, best.selected_chain, best.selection_status, best.n_pocket_ligand_copies, best.n_valid_motif_chains) == (2, "A", "OK", 2, 1)


def test_unique_names(spark):
    d = spark.createDataFrame([(1, 1, "C1", "C"), (1, 2, "C", "C"), (1, 3, "C", "C"), (1, 4, "C3", "C"), (1, 5, "", "N")], "mol_id int, atom_id int, name string, elem string")
    got = {r.atom_id: r.name for r in selection.unique_names(d, ["mol_id"]).collect()}
    assert got == {1: "C1", 2: "C2", 3: "C4", 4: "C3", 5: "N1"}


def test_unique_names_in_one_pass(spark, tmp_path):
    """Taken numbers are passed over, whatever their order or zeros; the table is read once and nothing is joined."""
    names = ["C1", "C01", "C4", "C2", "C0", "C10", "Cx", "N2", *["C"] * 6, *["N"] * 3, ""]
    rows = [(m, k, x, x[0] if x else "N") for m in (1, 2) for k, x in enumerate(names)]
    spark.createDataFrame(rows, "mol_id int, atom_id int, name string, elem string").write.parquet(str(tmp_path / "n"))
    got = selection.unique_names(spark.read.parquet(str(tmp_path / "n")), ["mol_id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    want = [*names[:8], "C3", "C5", "C6", "C7", "C8", "C9", "N1", "N3", "N4", "N5"]
    assert sorted((r.mol_id, r.atom_id, r.name) for r in got.collect()) == [(m, k, x) for m in (1, 2) for k, x in enumerate(want)]


ETHANOL = [(1, "C"), (2, "C"), (3, "O"), (4, "H"), (5, "H"), (6, "H"), (7, "H"), (8, "H"), (9, "H")]
ETHANOL_BONDS = [(1, 2), (2, 3), (1, 4), (1, 5), (1, 6), (2, 7), (2, 8), (3, 9)]
BENZENE = [(k, "C") for k in range(1, 7)] + [(k, "H") for k in range(7, 13)]
BENZENE_BONDS = [(k, k % 6 + 1, 4) for k in range(1, 7)] + [(k, k + 6, 1) for k in range(1, 7)]


@pytest.fixture(scope="module")
def molecules(spark):
    atoms = [("e", i, x, float(i), 0.0, 0.0, None) for i, x in ETHANOL] + [("b", i, x, math.cos(i), math.sin(i), 0.0, None) for i, x in BENZENE]
    bonds = [("e", a, b, 1) for a, b in ETHANOL_BONDS] + [("b", a, b, o) for a, b, o in BENZENE_BONDS]
    return (spark.createDataFrame(atoms, "mol_id string, atom_id int, elem string, x double, y double, z double, partial_charge double"), spark.createDataFrame(bonds, "mol_id string, a1 int, a2 int, bond_order int"))


def test_molecule_graphs(spark, molecules):
    from lodestone.operators.graph import ring_sizes

    atoms, bonds = molecules
    rings = ring_sizes(bonds)
    assert {(r.mol_id, r.ring_size) for r in rings.collect()} == {("e", None), ("b", 6), ("b", None)}
    typed = molgraph.atom_types(atoms, bonds, rings)
    kinds = {(r.mol_id, r.atom_id): (r.atom_type, r.coarse_type) for r in typed.collect()}
    assert kinds[("e", 1)] == ("CH3", "CAbb") and kinds[("e", 2)] == ("CH2", "CAbb") and kinds[("e", 3)] == ("OH", "OCbb")
    assert kinds[("e", 9)] == ("Hpol", "HNbb") and kinds[("e", 4)] == ("Hapo", None)
    assert kinds[("b", 1)] == ("aroC", "CAbb") and kinds[("b", 7)] == ("Haro", None)
    charged = molgraph.charges(typed, {"CH3": -0.3, "OH": -0.6, "Hpol": 0.4}, spark.createDataFrame([("e", -1.0)], "mol_id string, net_charge double"))
    total = {r.mol_id: r.s for r in charged.groupBy("mol_id").agg(F.round(F.sum("charge"), 9).alias("s")).collect()}
    assert total == {"e": -1.0, "b": 0.0}
    rotors = molgraph.rotatable(atoms, bonds, rings)
    assert {(r.mol_id, r.a1, r.a2, r.is_proton_rotor) for r in rotors.filter("can_rotate").collect()} == {("e", 2, 3, True)}
    groups = molgraph.rigid_groups(atoms, rotors)
    assert groups.filter("mol_id = 'b'").select("rigid_id").distinct().count() == 1
    flags = {r.mol_id: r for r in molgraph.molecule_flags(atoms, bonds).collect()}
    assert not flags["b"].aromaticity_warning and not flags["e"].hydrogen_warning
    kept, left = molgraph.strip(atoms, bonds, F.col("elem") == "H")
    assert kept.count() == 9 and left.count() == 8
    parts = molgraph.fragments(atoms, bonds, bonds.filter("mol_id = 'e' and a1 = 2 and a2 = 3"))
    checked = {(r.mol_id, r.fragment): r for r in molgraph.fragment_flags(atoms, parts, rotors).collect()}
    assert checked[("e", 1)].n_atoms == 7 and checked[("e", 2)].size_error and not checked[("b", 1)].size_warning
    c = {r.mol_id: r.centre for r in molgraph.centre_atom(atoms, bonds).collect()}
    assert c["e"] == 2


def test_unknown_element_is_an_error(spark):
    from lodestone.operators.graph import ring_sizes

    a = spark.createDataFrame([("m", 1, "Xx", 0.0, 0.0, 0.0, None), ("m", 2, "C", 1.0, 0.0, 0.0, None)], "mol_id string, atom_id int, elem string, x double, y double, z double, partial_charge double")
    b = spark.createDataFrame([("m", 1, 2, 1)], "mol_id string, a1 int, a2 int, bond_order int")
    with pytest.raises(Exception, match="no type for element"):
        molgraph.atom_types(a, b, ring_sizes(b)).collect()


def test_inventory(spark):
    entry = ("1ABC", "t", 3.2, "X-RAY", "2020-01-02", "2020-02-03", 1, [("1", "EGFR kinase", ["P00533"], ["A", "B"], "MKR", [("mutation", [3])], [("P00533", [(1, 3, 856)])])], [("HOH", "water", 18.0, ["A"], False), ("634", "drug", 400.0, ["A"], False), ("ABC", "other", 300.0, ["B"], False)])
    e = spark.createDataFrame([entry], metadata.ENTRY_SCHEMA)
    r = metadata.inventory(e, "P00533", "epidermal", F.lit("x" * 857 + "L" + "x" * 10)).first()
    assert (r.egfr_chain, r.n_egfr_chains, r.ligand_comp_id, r.n_candidate_ligands, r.mutation_string) == ("A", 2, "634", 2, "L858R")
    assert r.metadata_status == "MULTIPLE_LIGAND_CANDIDATES" and r.covalent_status == "INTERMOL_COVALENT_BUT_NOT_ON_LIGAND" and r.manual_review_required and "low resolution" in r.notes
    qc = {x.qc_name for x in relational.qc_split(metadata.inventory(e, "P00533", "", F.lit("")), metadata.qc_checks(), ["pdb_id"]).collect()}
    assert qc == {"qc_multiple_egfr_chains", "qc_multiple_ligand_candidates", "qc_low_resolution", "qc_manual_review_required"}


def test_affinity_survey(spark):
    lig = spark.createDataFrame([("1A", "L1", 400.0), ("1A", "HOH", 18.0), ("2B", "L2", 400.0), ("3C", "L3", 400.0)], "pdb_id string, ligand_id string, ligand_mw double")
    aff = spark.createDataFrame([("1A", "L1", "IC50", 5.0, "nM"), ("1A", "L1", "Kd", 7.0, "nM"), ("2B", "", "KI", 1.0, "uM"), ("2B", "", "KI", 3.0, "stone")], "pdb_id string, ligand_id string, affinity_type string, value double, unit_raw string")
    res = spark.createDataFrame([("1A", 2.0), ("2B", 2.8)], "pdb_id string, resolution_A double")
    known = spark.createDataFrame([("9Z", "K9", "KD", 10.0)], "pdb_id string, ligand_id string, affinity_type string, affinity_pM double")
    got = {r.pdb_id: (r.affinity_type, r.affinity_pM) for r in metadata.affinity_survey(lig, aff, res, known).collect()}
    assert got == {"1A": ("Kd", 7000.0), "2B": ("KI", 1e6), "9Z": ("KD", 10.0)}


def test_scalar_functions(spark):
    one = spark.range(1)
    v = lambda *xs: [F.lit(float(x)) for x in xs]
    r = one.select(scalar.dihedral(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0), v(0, 1, 1)).alias("d"), scalar.angle(v(1, 0, 0), v(0, 0, 0), v(0, 1, 0)).alias("a"), scalar.mutation_label(F.lit("L"), F.lit(858), F.lit("R")).alias("m"), scalar.mutation_label(F.lit("?"), F.lit(858), F.lit("R")).alias("u"), scalar.has_token(F.lit("x 634 y"), "634").alias("t"), scalar.has_token(F.lit("x6345"), "634").alias("f"), scalar.mean_of_present(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)).alias("p")).first()
    assert abs(abs(r.d) - 90) < 1e-9 and r.a == pytest.approx(90) and (r.m, r.u, r.t, r.f, r.p) == ("L858R", "pos<858>", True, False, 2.0)
    q = one.select(scalar.pad_atom_name(F.lit("CA"), F.lit("C")).alias("a"), scalar.pad_atom_name(F.lit("CL1"), F.lit("CL")).alias("b"), scalar.pad_atom_name(F.lit("HH11"), F.lit("H")).alias("c")).first()
    assert (q.a, q.b, q.c) == (" CA ", "CL1 ", "HH11")


def test_incremental(spark, tmp_path):
    d = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 3.0), ("s", 3, 8.0)], "k string, replicate int, energy double")
    whole = incremental.from_moments(incremental.moments(d, ["k"])).first()
    assert (whole.n, whole.mean, whole.sd) == (3, 4.0, pytest.approx(math.sqrt(13)))
    for part in (1, 2):
        d.filter(F.col("replicate") % 2 == part % 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = incremental.stream_moments(spark, str(tmp_path / "in"), d.schema, ["k"], "energy")
    incremental.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.n, r.mean, r.sd) == (3, 4.0, pytest.approx(math.sqrt(13)))
    native = spark.createDataFrame([("s", 1.0)], "k string, energy double")
    assert incremental.score_from_state(native, spark.read.parquet(str(tmp_path / "out")), ["k"]).first().frustration_class == "minimally_frustrated"


def test_missing_and_required(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="2"):
        relational.require(a, b, "k")
    with pytest.raises(ValueError):
        relational.only(spark.createDataFrame([("a",)], "id string"), "id", "b")
    assert relational.only(spark.createDataFrame([("Ab",)], "id string"), "id", "aB").count() == 1
    assert relational.same_rows(a, a) and not relational.same_rows(a, b)


@pytest.mark.parametrize("ties,want", [("min", [1, 2, 2, 4, 5, 5]), ("max", [1, 3, 3, 4, 6, 6]), ("average", [1, 2.5, 2.5, 4, 5.5, 5.5]), ("first", [1, 2, 3, 4, 5, 6]), ("random", [1, 2, 3, 4, 5, 6])])
def test_ranks_of_a_whole_table(spark, ties, want):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, None, 3.0, 7.0, None])], "i int, v double")
    rows = stats.rank(d, "v", ties=ties).collect()
    assert sorted(r["rank"] for r in rows) == want
    by = {r.i: r["rank"] for r in rows}
    assert by[1] == 1 and by[4] == 4 and min(by[2], by[5]) >= 5
    first = {r.i: r["rank"] for r in stats.rank(d, "v", ties="min", nulls="first").collect()}
    assert first[2] == first[5] == 1 and first[1] == 3
    assert stats.rank(d, "v", nulls="omit").count() == 4


def test_radius_join_at_cell_edges(spark):
    """Negative coordinates, points on cube faces, and distances of exactly the cutoff."""
    import itertools

    from lodestone.operators import geometry

    grid = [-4.0, -2.0, -0.5, 0.0, 1.5, 2.0]
    pts = [(k, *p) for k, p in enumerate(itertools.product(grid, repeat=3))]
    d = spark.createDataFrame([("s", *p) for p in pts], "structure_id string, resi int, x double, y double, z double")
    near = {(a[0], b[0]) for a in pts for b in pts if b[0] - a[0] >= 4 and math.dist(a[1:], b[1:]) <= 2.0}
    assert {(r.resi, r.resj) for r in geometry.contacts(d, 2.0).collect()} == near
    strict = geometry.radius_join(d, d, 2.0, ["structure_id"], strict=True, condition=F.col("r_resi") > F.col("l_resi"))
    assert {(r.l_resi, r.r_resi) for r in strict.collect()} == {(a[0], b[0]) for a in pts for b in pts if b[0] > a[0] and math.dist(a[1:], b[1:]) < 2.0}
    probes = d.filter("resi % 50 = 0")
    assert {r.resi for r in geometry.within_any(d, probes, 1.5).collect()} == {a[0] for a in pts if any(b[0] % 50 == 0 and math.dist(a[1:], b[1:]) <= 1.5 for b in pts)}


def test_eq2_is_the_neighbour_sum(spark):
    """Against the definition, with a repeated pair."""
    e = {(1, 2): 1.0, (1, 3): -2.0, (2, 4): 0.5, (3, 4): 3.0, (2, 3): 0.25}
    rows = [("s", 0, i, j, v) for (i, j), v in e.items()] + [("s", 0, 1, 2, 1.0)]
    got = {(r.resi, r.resj): r.energy for r in ensemble.neighbourhood_energy(spark.createDataFrame(rows, "structure_id string, replicate int, resi int, resj int, e double")).collect()}
    at = lambda i, j: e.get((min(i, j), max(i, j)), 0.0)
    for (i, j), v in e.items():
        want = v + 0.5 * sum(at(i, k) for k in range(1, 5) if k not in (i, j)) + 0.5 * sum(at(j, k) for k in range(1, 5) if k not in (i, j))
        assert got[(i, j)] == pytest.approx(want)


def test_centre_of_rigid_groups_equals_all_pairs(spark):
    """Paths through groups, whose pairs are not made, against relaxation over all of those pairs; some atoms are in no group."""
    import math
    import random

    draw = random.Random(11)
    atoms = [(m, k, "C" if k % 5 else "H", *(draw.random() * 4 for _ in "xyz")) for m in (1, 2) for k in range(40)]
    at = {(m, k): x for m, k, _, *x in atoms}
    bonds = [(m, k, k + 1, 1) for m in (1, 2) for k in range(39) if k != 30] + [(m, k, (k * 7) % 30, 1) for m in (1, 2) for k in range(1, 30, 3) if (k * 7) % 30 != k]
    rigid = [(m, k, k // 6 if m == 1 else k // 25) for m in (1, 2) for k in range(36)]
    edges = {(m, *sorted((a, b))) for m, a, b, _ in bonds} | {(m, a, b) for m, a, g in rigid for n, b, h in rigid if m == n and g == h and a < b}
    want = {}
    for m in (1, 2):
        d = {(a, b): 0.0 if a == b else math.inf for a in range(40) for b in range(40)}
        for n, a, b in edges:
            if n == m:
                d[a, b] = d[b, a] = math.dist(at[m, a], at[m, b])
        for k in range(40):
            for a in range(40):
                for b in range(40):
                    d[a, b] = min(d[a, b], d[a, k] + d[k, b])
        heavy = {}
        for n, a, b in {(n, a, b) for n, a, b, _ in bonds if n == m}:
            heavy[a], heavy[b] = heavy.get(a, 0) + (b % 5 > 0), heavy.get(b, 0) + (a % 5 > 0)
        far = {a: max(v for (s, _), v in d.items() if s == a and v < math.inf) for a in range(40) if a % 5 and heavy.get(a, 0) >= 2}
        want[m] = min((round(v, 9), a) for a, v in far.items())
    frames = spark.createDataFrame(atoms, "mol_id int, atom_id int, elem string, x double, y double, z double"), spark.createDataFrame(bonds, "mol_id int, a1 int, a2 int, bond_order int"), spark.createDataFrame(rigid, "mol_id int, atom_id int, rigid_id int")
    got = {r.mol_id: (round(r.radius, 9), r.centre) for r in molgraph.centre_atom(*frames).collect()}
    assert got == want


def test_eq2_moves_points_only(spark):
    """Two joins: of points with their sums, and of points in neighbouring cubes; what it gives is not dealt again."""
    from conftest import SF

    from lodestone.plans import spatial

    plan = spatial.eq2_energy(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and "Aggregate" not in plan


def test_centre_of_dense_points_searches_few(spark):
    """Paths over contacts that are never made, against all pairs' paths; distances from farthest nodes leave few candidates to search."""
    import numpy as np

    from lodestone.operators import graph

    at, cutoff = np.random.default_rng(3).random((400, 3)) * [0.5, 0.3, 0.2], 0.1
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    k = np.arange(400)
    d[(d > cutoff) | ((abs(k[:, None] - k) < 4) & (k[:, None] != k))] = np.inf
    for m in k:
        d = np.minimum(d, d[:, m, None] + d[m])
    assert np.isfinite(d).all()
    p = spark.createDataFrame([("s", int(i), *map(float, x)) for i, x in zip(k, at)], "mol_id string, node int, x double, y double, z double")
    searched = []

    def paths(picked):
        searched.extend(r.source for r in picked.collect())
        return graph.near_paths(p, cutoff, picked)

    r = graph.centre(None, p.select("mol_id", "node"), paths=paths, sweep=True).collect()
    far = d.max(1)
    assert len(r) == 1 and (round(far[r[0].centre], 9), r[0].centre) == min((round(v, 9), i) for i, v in enumerate(far)) and r[0].radius == pytest.approx(far.min())
    assert len(searched) == len(set(searched)) < 60
    got = {x.node: x.dist for x in graph.near_paths(p, cutoff, p.filter("node = 7").select("mol_id", F.col("node").alias("source"))).collect()}
    assert np.allclose([got[i] for i in range(400)], d[7])


def test_inventory_deals_rows_once(spark):
    """One exchange of short rows and no join; ids that repeat share chains and mutations, null ids and polymers have none."""
    region = [("P1", [(1, 3, 11)]), ("P1", [(2, 5, 22)]), ("Q", [(1, 9, 90)])]
    one = ("1", "x", ["P1"], ["B"], "MKRT", [("mutation", [3, 4, 9]), ("other", [1]), ("mutation", None)], region)
    two = ("2", "the TARGET", None, None, "MK", None, None)
    three = ("3", "Target", ["Z"], ["A", "B"], "MK", [("mutation", [2])], None)
    row = lambda name, *polymers: (name, "t", 1.0, "X", "2020-01-02", "2020-02-03", 0, list(polymers) or None, [("L1", "l", 3.0, ["A"], False)])
    e = spark.createDataFrame([row("1", one), row("2", one, two), row("2", three), row("3", two), row("4"), row(None, one)], metadata.ENTRY_SCHEMA)
    i = metadata.inventory(e, "P1", "target", F.lit("ACDEFGHIKLMNPQRSTVWYACDEFG"))
    got = sorted(((r.pdb_id or "-", r.egfr_chain, r.n_egfr_chains, r.mutation_string) for r in i.collect()), key=str)
    labels = "E24T,P13R,pos<9>"
    assert got == [("-", None, 0, None), ("1", "B", 1, labels), ("2", "A", 2, "C2K," + labels), ("2", "A", 2, "C2K," + labels), ("3", None, 0, None), ("4", None, 0, None)]
    plan = i._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and i._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
