"""Cleaning of structures: selected chain and ligand, alternatives, numbering, and a summary."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import geometry, selection
from lodestone.sources.text import ONE_LETTER


def chosen_atoms(atoms: DataFrame, chosen: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Atoms of the chosen chain (block 1) and ligand copy (block 3), one alternative each.

    ``chosen`` has chain, ligand_chain, ligand_comp_id, ligand_resnum, and the name
    that the ligand is to have in ``ligand_code``.
    """
    a = atoms.join(chosen.hint("merge"), list(keys))
    protein = (F.col("record") == "ATOM") & (F.col("chain") == F.col("selected_chain")) & F.col("resname").isin(*ONE_LETTER)
    ligand = (F.col("record") == "HETATM") & (F.col("resname") == F.col("ligand_comp_id")) & (F.col("chain") == F.col("ligand_chain")) & (F.col("resseq") == F.col("ligand_resnum"))
    a = a.withColumn("block", F.when(protein, 1).when(ligand, 3)).filter("block is not null")
    best = selection.best_alternative(a, (*keys, "block", "chain", "resseq", "icode", "atom_name"))
    renamed = F.concat(F.substring("line", 1, 17), F.lpad("ligand_code", 3, " "), F.expr("substring(line, 21)"))
    return best.withColumn("line", F.when((F.col("block") == 3) & (F.col("ligand_code") != F.col("ligand_comp_id")), renamed).otherwise(F.col("line")))


def clean_lines(cleaned: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Text lines of the cleaned structures: remark, protein, TER, ligand, END."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("block", "line_no")) == 1
    row = lambda block, at, line: F.struct(F.lit(block).cast("int").alias("block") if isinstance(block, int) else F.col(block).alias("block"), at.cast("long").alias("line_no"), line.alias("line"))
    own = row("block", F.col("line_no"), F.col("line"))
    frame = [row(b, F.lit(0), x) for b, x in ((0, F.format_string("REMARK   chain %s, ligand %s", "selected_chain", "ligand_comp_id")), (2, F.lit("TER")), (4, F.lit("END")))]
    # the lines around a structure come with its first one: what is cleaned is made once
    return cleaned.withColumn("_first", first).select(*keys, F.inline(F.when(F.col("_first"), F.array(own, *frame)).otherwise(F.array(own))))


def residue_mapping(cleaned: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Native numbers to 1..n by first appearance, the ligand as n + 1."""
    protein = selection.renumber(cleaned.filter("block = 1"), keys, ["chain", "resseq", "icode", "resname"], "line_no")
    ligand = cleaned.filter("block = 3").select(*keys, "chain", "resseq", "icode", "resname").distinct()
    return selection.number_with_ligand(protein, ligand, keys)


def bridging_waters(atoms: DataFrame, ligand_atoms: DataFrame, cutoff: float = 4.0, keys=("structure_id",)) -> DataFrame:
    """Waters within the cutoff of the ligand's heavy atoms, each by its oxygen or first atom."""
    w = atoms.filter(F.col("resname") == "HOH")
    w = selection.first_by(w, (*keys, "chain", "resseq", "icode"), [(F.col("atom_name") != "O").cast("int"), F.col("line_no")])
    return geometry.nearest_within(w, ligand_atoms.filter(F.upper("element") != "H"), cutoff, keys, ("chain", "resseq"))


def summary(chosen: DataFrame, cleaned: DataFrame, sequences: DataFrame, atoms: DataFrame, links: DataFrame | None = None, keys=("structure_id",)) -> DataFrame:
    """Status, counts, gaps, disulfides, waters and covalent link of each structure."""
    k = list(keys)
    counts = cleaned.groupBy(*keys).agg(F.count_if(F.col("block") == 1).alias("protein_atom_count"), F.count_if(F.col("block") == 3).alias("ligand_atom_count"), F.count_distinct(F.when(F.col("block") == 1, F.struct("resseq", F.coalesce("icode", F.lit(""))))).alias("n_protein_residues"))
    dropped = cleaned.select(*keys, "block", "chain", "resseq", "icode", "atom_name", "n_dropped").groupBy(*keys).agg(F.sum("n_dropped").alias("n_altloc_atoms_removed"))
    protein = cleaned.filter("block = 1")
    chain = chosen.select(*keys, F.col("selected_chain").alias("chain"))
    length = sequences.join(chain.hint("merge"), [*k, "chain"], "left_semi").groupBy(*keys).agg(F.count("*").alias("seqres_length"))
    holes = selection.gap_text(protein, (*keys, "chain")).drop("chain")
    ss = geometry.disulfides(protein, keys=(*keys, "chain")).groupBy(*keys).agg(F.count("*").alias("n_disulfides"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "res_i", "res_j"))), ";").alias("disulfide_pairs"))
    water = bridging_waters(atoms, cleaned.filter("block = 3"), keys=keys).groupBy(*keys).agg(F.count("*").alias("n_bridging_waters"))
    out = chosen
    for t in (counts, dropped, length, holes, ss, water):
        out = out.join(t.hint("merge"), k, "left")
    out = out.fillna(0, ["protein_atom_count", "ligand_atom_count", "n_protein_residues", "n_altloc_atoms_removed", "n_disulfides", "n_bridging_waters"])
    status = F.when(F.col("protein_atom_count") == 0, "FAILED_NO_PROTEIN_ATOMS").when(F.col("ligand_atom_count") == 0, "FAILED_NO_LIGAND_ATOMS").otherwise("OK")
    out = out.withColumns({"n_missing_residues": F.greatest(F.coalesce("seqres_length", F.lit(0)) - F.col("n_protein_residues"), F.lit(0)), "status": status})
    if links is not None:
        out = out.join(links.hint("merge"), k, "left").withColumn("is_covalent", F.col("ligand_atom").isNotNull())
    return out
