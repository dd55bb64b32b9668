"""Ligand libraries as graphs: one job over all molecules.

``atoms(mol_id, atom_id, elem, x, y, z, partial_charge)``, ``bonds(mol_id, a1, a2,
bond_order)`` with orders 1 to 3, 4 for aromatic.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import distance, lookup, vector
from lodestone.functions.storage import materialised
from lodestone.operators import graph

KEY = ["mol_id"]
HYDROGENS = ["H", "D"]
#: Types of elements that have but one (fixed values).
SINGLE_TYPES = {"S": "S", "P": "Phos", "F": "F", "CL": "Cl", "BR": "Br", "I": "I", "B": "Bsp2", "NA": "Na1p", "K": "K1p", "MG": "Mg2p", "FE": "Fe3p", "CA": "Ca2p", "ZN": "Zn2p", "CO": "Co2p", "CU": "Cu2p"}
DONORS, ACCEPTORS, POLAR_H = ["Ntrp", "NH2O", "Nlys", "Narg", "Npro", "Nbb"], ["Nhis", "OH", "ONH2", "OOC", "Oaro", "OCbb"], ["Hpol", "HNbb"]


def is_h(elem: Column) -> Column:
    return elem.isin(*HYDROGENS)


def neighbours(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Each atom beside each partner: element of both, and the order of their bond.

    Bonds that have the elements as ``e1`` and ``e2`` are not joined.
    """
    if {"e1", "e2"} <= set(bonds.columns):
        b = bonds.select(*KEY, "a1", "a2", "bond_order", "e1", "e2")
        return b.union(b.select(*KEY, "a2", "a1", "bond_order", "e2", "e1"))
    two = graph.both_ways(bonds, KEY, ["bond_order"])
    a = atoms.select(*KEY, F.col("atom_id").alias("a1"), F.col("elem").alias("e1"))
    b = atoms.select(*KEY, F.col("atom_id").alias("a2"), F.col("elem").alias("e2"))
    return two.join(a.hint("merge"), [*KEY, "a1"]).join(b.hint("merge"), [*KEY, "a2"])


def degrees(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """degree, heavy degree, hydrogens, valence (aromatic 1.5), and whether bonds are all single or any aromatic."""
    n, h = neighbours(atoms, bonds), is_h(F.col("e2"))
    d = n.groupBy(*KEY, F.col("a1").alias("atom_id")).agg(
        F.count("*").alias("degree"), F.count_if(~h).alias("heavy_degree"), F.count_if(h).alias("n_h"), F.sum(F.when(F.col("bond_order") == 4, 1.5).otherwise(F.col("bond_order"))).alias("valence"),
        F.bool_and(F.col("bond_order") == 1).alias("saturated"), F.bool_or(F.col("bond_order") == 4).alias("aromatic"),
        F.bool_and((F.col("bond_order") == 1) | h).alias("heavy_single"),
    )
    return atoms.join(d.hint("merge"), [*KEY, "atom_id"], "left").fillna({"degree": 0, "heavy_degree": 0, "n_h": 0, "valence": 0.0, "saturated": True, "aromatic": False, "heavy_single": True})


def valence_flags(atoms: DataFrame, bonds: DataFrame, most: float = 4.5) -> DataFrame:
    """Hydrogens with several bonds are errors; too large sums of orders are warnings."""
    d = degrees(atoms, bonds)
    return d.select(*KEY, "atom_id", "elem", "degree", "valence", (is_h(F.col("elem")) & (F.col("degree") > 1)).alias("h_error"), (F.col("valence") > most).alias("valence_warning"))


def molecule_flags(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Molecules with double but no aromatic bonds, and without hydrogens."""
    b = bonds.groupBy(*KEY).agg(F.count_if(F.col("bond_order") == 2).alias("n_double"), F.count_if(F.col("bond_order") == 4).alias("n_aromatic"))
    a = atoms.groupBy(*KEY).agg(F.count("*").alias("n_atoms"), F.bool_or(is_h(F.col("elem"))).alias("has_h"))
    out = a.join(b.hint("merge"), KEY, "left").fillna(0, ["n_double", "n_aromatic"])
    return out.withColumns({"aromaticity_warning": (F.col("n_double") > 0) & (F.col("n_aromatic") == 0), "hydrogen_warning": ~F.col("has_h")})


def atom_types(atoms: DataFrame, bonds: DataFrame, rings: DataFrame, other_types: Mapping[str, str] | None = None) -> DataFrame:
    """Types by element and bonding pattern; an element without a rule or a type in ``other_types`` is an error.

    ``rings`` has the bonds' ring sizes; it may leave out bonds that have ``three``, which are in one of three.

    A hydrogen is aromatic beside a carbon that is typed aromatic or has an aromatic
    bond, which takes carbons first and a second pass over their neighbours.
    """
    d = degrees(atoms, bonds)
    n = neighbours(atoms, bonds)
    order, to = F.col("bond_order"), F.col("e2")
    saturated = d.select(*KEY, F.col("atom_id").alias("a2"), F.col("saturated").alias("sat2"), F.col("aromatic").alias("aro2"))
    beside_n = n.groupBy(*KEY, F.col("a1").alias("a2")).agg(F.bool_or(to == "N").alias("n_beside2"))
    pattern = n.groupBy(*KEY, F.col("a1").alias("atom_id")).agg(
        F.count_if((order == 2) & (to != "O")).alias("dbl"), F.count_if((order == 4) & (to != "O")).alias("aro"), F.count_if((order == 4) & (to == "N")).alias("aro_n"),
        F.count_if(to.isin("N", "O", "S")).alias("polar"), F.count_if(to == "N").alias("n_n"),
    )
    # what partners have beside them counts for oxygens only
    around = n.filter(F.upper("e1") == "O").join(saturated.hint("merge"), [*KEY, "a2"]).join(beside_n.hint("merge"), [*KEY, "a2"])
    around = around.groupBy(*KEY, F.col("a1").alias("atom_id")).agg(F.count_if((to == "C") & F.col("n_beside2")).alias("c_n"), F.count_if(~F.col("sat2")).alias("unsat"))
    ring = rings.select(*KEY, "a1", "a2", "ring_size")
    if "three" in bonds.columns:
        ring = ring.unionByName(bonds.filter("three").select(*KEY, "a1", "a2", F.lit(3).alias("ring_size")))
    ring = graph.both_ways(ring, KEY, ["ring_size"]).groupBy(*KEY, F.col("a1").alias("atom_id")).agg(F.min("ring_size").alias("ring"))
    d = d.join(pattern.hint("merge"), [*KEY, "atom_id"], "left").join(around.hint("merge"), [*KEY, "atom_id"], "left").join(ring.hint("merge"), [*KEY, "atom_id"], "left").fillna(0, ["dbl", "aro", "aro_n", "polar", "n_n", "c_n", "unsat"])
    c = lambda x: F.col(x)
    carbon = F.when(c("saturated"), F.when(c("n_h") >= 3, "CH3").when(c("n_h") == 2, "CH2").otherwise("CH1")).when((c("aro") >= 2) | (c("dbl") >= 1), "aroC").when(c("aro_n") >= 1, "CNH2").otherwise("COO")
    nitrogen = F.when(c("n_h") >= 3, "Nlys").when(c("n_h") == 2, "NH2O").when(c("n_h") == 1, "Ntrp").when((c("heavy_degree") <= 2) | ((c("heavy_degree") == 3) & c("saturated")), "Nhis").otherwise("Npro")
    small = c("ring").isNotNull() & (c("ring") < 5)
    bridging = F.when((c("n_h") > 0) | small, "OH").when(c("ring").isNotNull() & (c("unsat") > 0), "Oaro").otherwise("OH")
    oxygen = F.when(c("saturated"), F.when(c("degree") >= 2, bridging).otherwise("OOC")).when(c("n_h") > 0, "OH").when((c("n_n") > 0) | (c("c_n") > 0), "ONH2").otherwise("OOC")
    unknown = F.raise_error(F.concat(F.lit("no type for element "), c("elem"))).cast("string")
    elem = F.upper("elem")
    typed = d.withColumn("atom_type", F.when(is_h(elem), F.lit(None)).when(elem == "C", carbon).when(elem == "N", nitrogen).when(elem == "O", oxygen).otherwise(F.coalesce(lookup(elem, (other_types or {}) | SINGLE_TYPES), unknown)))
    aromatic_c = typed.filter((elem == "C") & (c("aromatic") | (c("atom_type") == "aroC"))).select(*KEY, c("atom_id").alias("a2"), F.lit(True).alias("aro_c"))
    h = n.filter(is_h(F.col("e1")) & (F.upper("e2") == "C")).join(aromatic_c.hint("merge"), [*KEY, "a2"], "left").groupBy(*KEY, F.col("a1").alias("atom_id")).agg(F.bool_or(F.coalesce("aro_c", F.lit(False))).alias("by_aromatic"))
    typed = typed.join(h.hint("merge"), [*KEY, "atom_id"], "left")
    hydrogen = F.when(c("polar") >= 1, "Hpol").when(F.coalesce("by_aromatic", F.lit(False)), "Haro").otherwise("Hapo")
    typed = typed.withColumn("atom_type", F.when(is_h(elem), hydrogen).otherwise(c("atom_type")))
    kind = F.when(c("atom_type").isin(*POLAR_H), "HNbb").when(c("atom_type").isin(*DONORS), "Nbb").when(c("atom_type").isin(*ACCEPTORS), "OCbb").when(~is_h(elem), "CAbb")
    return typed.select(*atoms.columns, "atom_type", kind.alias("coarse_type"), F.lit("X").alias("mechanics_type"))


def charges(atoms: DataFrame, table: Mapping[str, float], target: DataFrame | None = None) -> DataFrame:
    """Charges by type, shifted equally over the non-virtual atoms to the net charge of the molecule.

    Charges that are all given and not all zero stay; given for some only is an error.
    ``target`` has (mol_id, net_charge); without it the net charge is 0.
    """
    w = Window.partitionBy(*KEY)
    a = atoms if target is None else atoms.join(target.hint("merge"), KEY, "left")
    net = F.coalesce("net_charge", F.lit(0.0)) if target is not None else F.lit(0.0)
    given, total = F.count("partial_charge").over(w), F.count("*").over(w)
    whole = (given == total) & (F.sum(F.abs("partial_charge")).over(w) > 0)
    mixed = (given > 0) & (given < total)
    real = F.coalesce("atom_type", F.lit("")) != "VIRT"
    base = F.when(real, lookup(F.col("atom_type"), dict(table), 0.0)).otherwise(0.0)
    a = a.withColumns({"_base": base, "_real": real, "_net": net, "_whole": whole, "_mixed": mixed})
    shift = F.when(F.col("_real"), (F.col("_net") - F.sum("_base").over(w)) / F.count_if("_real").over(w)).otherwise(0.0)
    charge = F.when(F.col("_mixed"), F.raise_error(F.concat(F.lit("some atoms lack a charge in "), F.col("mol_id").cast("string"))).cast("double")).when(F.col("_whole"), F.col("partial_charge")).otherwise(F.col("_base") + shift)
    return a.withColumn("charge", charge).select(*atoms.columns, "charge")


def rotatable(atoms: DataFrame, bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """Bonds with ``can_rotate`` and ``is_proton_rotor``: single, in no ring, heavy neighbours on both sides.

    Bonds that have ``three`` are in a ring of three and are not joined; ``rings`` may leave them out.
    Of those that have ``tree`` it comes out, true for bonds without ``three``.
    """
    d = degrees(atoms, bonds)
    ok = (F.col("heavy_degree") >= 2) | ((F.col("heavy_degree") == 1) & F.col("heavy_single") & (F.col("n_h") == 1) & (F.col("elem") != "C"))
    d = d.select(*KEY, "atom_id", ok.alias("ok"), (F.col("heavy_degree") == 1).alias("end"))
    side = lambda k: d.select(*KEY, F.col("atom_id").alias(f"a{k}"), F.col("ok").alias(f"ok{k}"), F.col("end").alias(f"end{k}"))
    told, tree = "three" in bonds.columns, ["tree"] if "tree" in bonds.columns else []
    whole = bonds.select(*KEY, F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2"), "bond_order", *(["three"] if told else []), *tree)
    b = whole.filter("not three").drop("three", "tree") if told else whole.drop("tree")
    b = b.join(rings.hint("merge"), [*KEY, "a1", "a2"], "left").join(side(1).hint("merge"), [*KEY, "a1"]).join(side(2).hint("merge"), [*KEY, "a2"])
    can = (F.col("bond_order") == 1) & F.col("ring_size").isNull() & F.col("ok1") & F.col("ok2")
    b = b.select(*KEY, "a1", "a2", "bond_order", "ring_size", can.alias("can_rotate"), (can & (F.col("end1") | F.col("end2"))).alias("is_proton_rotor"), *[F.lit(True).alias(c) for c in tree])
    if told:
        fixed = [F.lit(3).alias("ring_size"), F.lit(False).alias("can_rotate"), F.lit(False).alias("is_proton_rotor")]
        b = b.unionByName(whole.filter("three").select(*KEY, "a1", "a2", "bond_order", *fixed, *tree))
    return b


def rigid_groups(atoms: DataFrame, rotors: DataFrame) -> DataFrame:
    """(mol_id, atom_id, rigid_id): components over bonds that do not rotate, numbered by first atom."""
    nodes = atoms.select(*KEY, F.col("atom_id").alias("node"))
    c = graph.components(nodes, rotors.filter("not can_rotate"), KEY)
    return c.select(*KEY, F.col("node").alias("atom_id"), F.dense_rank().over(Window.partitionBy(*KEY).orderBy("component")).alias("rigid_id"))


def fragments(atoms: DataFrame, bonds: DataFrame, broken: DataFrame) -> DataFrame:
    """(mol_id, atom_id, fragment): components when the broken bonds are cut."""
    cut = broken.select(*KEY, F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2"))
    kept = bonds.select(*KEY, F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).join(cut.hint("merge"), [*KEY, "a1", "a2"], "left_anti")
    c = graph.components(atoms.select(*KEY, F.col("atom_id").alias("node")), kept, KEY)
    return c.select(*KEY, F.col("node").alias("atom_id"), F.dense_rank().over(Window.partitionBy(*KEY).orderBy("component")).alias("fragment"))


def fragment_flags(atoms: DataFrame, parts: DataFrame, rotors: DataFrame) -> DataFrame:
    """Size checks of fragments: below 3 atoms an error; outside usual sizes or over 4 rotors a warning; over 9 fragments an error."""
    p = atoms.join(parts.hint("merge"), [*KEY, "atom_id"])
    size = p.groupBy(*KEY, "fragment").agg(F.count("*").alias("n_atoms"), F.count_if(~is_h(F.col("elem"))).alias("n_heavy"))
    inside = rotors.filter("can_rotate").join(parts.withColumnsRenamed({"atom_id": "a1", "fragment": "f1"}).hint("merge"), [*KEY, "a1"]).join(parts.withColumnsRenamed({"atom_id": "a2", "fragment": "f2"}).hint("merge"), [*KEY, "a2"]).filter("f1 = f2")
    turns = inside.groupBy(*KEY, F.col("f1").alias("fragment")).agg(F.count("*").alias("n_rotors"))
    s = size.join(turns.hint("merge"), [*KEY, "fragment"], "left").fillna(0, ["n_rotors"]).withColumn("n_fragments", F.count("*").over(Window.partitionBy(*KEY)))
    warn = ~F.col("n_atoms").between(7, 24) | ~F.col("n_heavy").between(4, 22) | (F.col("n_rotors") > 4)
    return s.withColumns({"size_error": (F.col("n_atoms") < 3) | (F.col("n_fragments") > 9), "size_warning": warn})


def fragment_averages(sizes: DataFrame) -> DataFrame:
    """(mol_id, n_fragments, atoms and heavy atoms a fragment, rounded half-even to one place) from ``fragment_flags``."""
    s = sizes.groupBy(*KEY).agg(F.count("*").alias("n_fragments"), F.sum("n_atoms").alias("_a"), F.sum("n_heavy").alias("_h"))
    return s.select(*KEY, "n_fragments", F.bround(F.col("_a") / F.col("n_fragments"), 1).alias("mean_atoms"), F.bround(F.col("_h") / F.col("n_fragments"), 1).alias("mean_heavy"))


def centre_atom(atoms: DataFrame, bonds: DataFrame, rigid: DataFrame | None = None) -> DataFrame:
    """The heavy atom with two heavy neighbours at least that is nearest to its farthest atom.

    Edges are bonds and all pairs of a rigid group, as long as their distance; the pairs
    are not made, see ``graph.rigid_paths``.  As no path is shorter than a straight line, the
    outermost atoms tell which candidates need a search.
    """
    d = degrees(atoms, bonds)
    good = d.filter(~is_h(F.col("elem")) & (F.col("heavy_degree") >= 2)).select(*KEY, F.col("atom_id").alias("node"))
    nodes = atoms.select(*KEY, F.col("atom_id").alias("node"), "x", "y", "z")
    # an atom that no group lists is one of its own
    own = F.concat(F.lit("a"), F.col("node").cast("string"))
    groups = rigid.select(*KEY, F.col("atom_id").alias("node"), F.concat(F.lit("g"), F.col("rigid_id").cast("string")).alias("group")) if rigid is not None else None
    nodes = nodes.withColumn("group", own) if groups is None else nodes.join(groups.hint("merge"), [*KEY, "node"], "left").withColumn("group", F.coalesce("group", own))
    nodes = materialised(nodes)
    at = lambda k: nodes.select(*KEY, F.col("node").alias(f"a{k}"), F.col("group").alias(f"g{k}"), *[F.col(c).alias(f"p{k}{c}") for c in "xyz"])
    e = bonds.select(*KEY, "a1", "a2").join(at(1).hint("merge"), [*KEY, "a1"]).join(at(2).hint("merge"), [*KEY, "a2"]).filter("g1 <> g2")
    e = materialised(e.select(*KEY, "a1", "a2", distance(vector("p1"), vector("p2")).alias("weight")))
    first = nodes.groupBy(*KEY, "group").agg(F.min("node").alias("a2"))
    star = nodes.join(first.hint("merge"), [*KEY, "group"]).select(*KEY, F.col("node").alias("a1"), "a2").filter("a1 <> a2")
    bounds = graph.straight_bounds(nodes, e.select(*KEY, "a1", "a2").unionByName(star), KEY)
    return graph.centre(e, good.join(bounds.hint("merge"), [*KEY, "node"], "left").fillna(0.0, ["low"]), KEY, paths=lambda picked: graph.rigid_paths(e, nodes, picked, KEY))


def strip(atoms: DataFrame, bonds: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Atoms that match go, with their bonds; the rest is numbered anew from 1."""
    kept = atoms.filter(~drop).withColumn("_new", F.row_number().over(Window.partitionBy(*KEY).orderBy("atom_id")))
    ids = kept.select(*KEY, F.col("atom_id").alias("_old"), "_new")
    b = bonds
    for side in ("a1", "a2"):
        t = ids.withColumnsRenamed({"_old": side, "_new": f"_{side}"})
        b = b.join(t.hint("merge"), [*KEY, side]).drop(side).withColumnRenamed(f"_{side}", side)
    return kept.drop("atom_id").withColumnRenamed("_new", "atom_id").select(*atoms.columns), b.select(*bonds.columns)


def ordered(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heavy atoms before hydrogens, each in file order; bonds with the lower atom first."""
    a = atoms.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(is_h(F.col("elem")), "atom_id")))
    b = bonds.withColumns({"lo": F.least("a1", "a2"), "hi": F.greatest("a1", "a2")})
    return a, b.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("lo", "hi")))


def conformer_bound(rotors: DataFrame, sp2: Column, base: int = 1, most: float = 5000, keys: Sequence[str] = KEY) -> DataFrame:
    """base times 6 for each sp2 rotor and 9 for each other, and whether that is too many."""
    r = rotors.filter("can_rotate").groupBy(*keys).agg(F.count_if(sp2).alias("n_sp2"), F.count_if(~sp2).alias("n_sp3"))
    bound = F.lit(float(base)) * F.pow(F.lit(6.0), "n_sp2") * F.pow(F.lit(9.0), "n_sp3")
    return r.select(*keys, "n_sp2", "n_sp3", bound.alias("conformers"), (bound > most).alias("too_many"))


def parameter_status(evidence: DataFrame) -> DataFrame:
    """Status of a ligand from what exists: has_structure, has_mol2, has_params, names_match."""
    s = F.when(~F.col("has_structure"), "NO_CLEAN_PDB_FOUND").when(~F.col("has_mol2"), "MOL2_GENERATION_FAILED").when(~F.col("has_params"), "PARAMS_GENERATION_FAILED").when(F.col("names_match"), "OK").otherwise("NEEDS_REVIEW")
    return evidence.withColumn("status", s)
