"""Nested metadata documents to a flat inventory; affinity surveys."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import letter_at, log10_floor, mutation_label, once, to_picomolar
from lodestone.operators.relational import append_absent, match_or_blank, review
from lodestone.operators.selection import keep_first

# Fixed values, in alphabetical order: components that are never the ligand of an entry, and those that a survey leaves out.
NOT_LIGANDS = [
    "12P", "15P", "1PE", "2PE", "6PE", "ACE", "ACT", "ACY", "AG", "AU", "AZI", "BA", "BEZ", "BME", "BO4",
    "BR", "BU2", "BU3", "CA", "CAC", "CD", "CE", "CIT", "CL", "CO", "CO3", "CS", "CU", "CXS", "DMS", "DTT",
    "EDO", "EPE", "EU", "F", "FE", "FMT", "GD", "GOL", "GSH", "GTT", "HEPES", "HG", "HOH", "IMD", "IOD",
    "IPA", "K", "LA", "LI", "LU", "MES", "MG", "MN", "MPD", "MRD", "NA", "NH4", "NI", "NO3", "OXL", "P33",
    "P6G", "PB", "PBM", "PEG", "PEK", "PEO", "PG4", "PGE", "PO4", "PT", "PUT", "RB", "SCN", "SIN", "SM",
    "SO4", "SPD", "SPM", "SR", "TAM", "TLA", "TRS", "UNK", "UNX", "YB", "ZN",
]
NOT_SURVEYED = [
    "12P", "15P", "1PE", "2PE", "3AN", "7PE", "ACE", "ACO", "ACT", "ACY", "ADP", "AG", "AMP", "ANP", "APC",
    "ATP", "AU", "BA", "BCT", "BME", "BOG", "BR", "BRO", "BTB", "BU1", "BU2", "BU3", "C8E", "CA", "CD", "CE",
    "CE1", "CIT", "CL", "CLO", "CM", "CME", "CMO", "CO", "CO3", "CS", "CSD", "CSO", "CSX", "CU", "DMS", "DRG",
    "DTT", "DVT", "EDO", "EGL", "EOH", "EPE", "F", "FE", "FLC", "FLO", "FME", "FMT", "FRU", "GAL", "GDP",
    "GLA", "GMP", "GOL", "GTP", "HED", "HG", "HIC", "HOH", "IMD", "IOD", "IPA", "K", "KCX", "LI", "LLP",
    "M3L", "MAN", "MES", "MG", "MLI", "MLY", "MN", "MOH", "MOO", "MPD", "MPO", "MRD", "MSE", "NA", "NEP",
    "NH4", "NHE", "NI", "NO3", "OCS", "OGA", "OXL", "P6G", "PCM", "PDO", "PEG", "PER", "PG4", "PGE", "PGO",
    "PO4", "PTR", "PUT", "PYL", "RB", "SEC", "SEP", "SIN", "SO3", "SO4", "SPD", "SPM", "SR", "SUL", "TAR",
    "TFA", "TLA", "TNG", "TPO", "TRD", "TRS", "UNL", "UNX", "XPE", "XX1", "XYP", "ZN",
]

#: Nested documents: polymer entities with features and alignments, and ligands.
ENTRY_SCHEMA = """
pdb_id string, title string, resolution double, method string, deposit_date string, release_date string, inter_mol_covalent int,
polymers array<struct<entity_id: string, description: string, uniprot_ids: array<string>, chains: array<string>, sequence: string,
    features: array<struct<type: string, positions: array<int>>>,
    alignments: array<struct<uniprot_id: string, regions: array<struct<beg: int, length: int, ref_beg: int>>>>>>,
ligands array<struct<comp_id: string, name: string, weight: double, chains: array<string>, linked: boolean>>
"""


def flat(arrays: Column) -> Column:
    """The elements of all arrays that are not NULL."""
    return F.flatten(F.filter(arrays, lambda x: x.isNotNull()))


def targets(polymers: Column, uniprot: str, words: str) -> Column:
    """The polymers of the target: by accession, or by description in any case."""
    return F.filter(polymers, lambda p: F.array_contains(p["uniprot_ids"], uniprot) | F.lower(p["description"]).contains(words.lower()))


def mutated(polymers: Column) -> Column:
    """(entity, position, mutant) of each mutated position, with the polymer's own letter."""
    spot = lambda p: lambda x: F.struct(p["entity_id"].alias("entity"), x.alias("position"), letter_at(p["sequence"], x).alias("mutant"))
    return flat(F.transform(polymers, lambda p: flat(F.transform(F.filter(p["features"], lambda f: f["type"] == "mutation"), lambda f: F.transform(f["positions"], spot(p))))))


def aligned(polymers: Column, uniprot: str) -> Column:
    """(entity, a_no, r_no, beg, length, ref_beg) of each region that is aligned to the target."""
    region = lambda p, i: lambda r, j: F.struct(p["entity_id"].alias("entity"), i.alias("a_no"), j.alias("r_no"), r["beg"].alias("beg"), r["length"].alias("length"), r["ref_beg"].alias("ref_beg"))
    return flat(F.transform(polymers, lambda p: flat(F.transform(p["alignments"], lambda a, i: F.when(a["uniprot_id"] == uniprot, F.transform(a["regions"], region(p, i)))))))


def mutation_string(spots: Column, regions: Column, reference: Column) -> Column:
    """Mutated positions in reference numbers, distinct and sorted; NULL without any.

    Positions are mapped by the first alignment region that holds them.  Letters
    come from ``reference`` (the target's own sequence) and from the polymer.
    """

    def mapped(s):
        hit = F.array_min(F.filter(regions, lambda r: (r["entity"] == s["entity"]) & s["position"].between(r["beg"], r["beg"] + r["length"] - 1)))
        return F.struct(F.coalesce(hit["ref_beg"] + s["position"] - hit["beg"], s["position"]).alias("at"), s["mutant"].alias("mutant"))

    labels = F.transform(F.transform(spots, mapped), lambda m: mutation_label(letter_at(reference, m["at"]), m["at"], m["mutant"]))
    labels = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(spots) > 0, F.array_join(F.sort_array(F.array_distinct(labels)), ","))


def inventory(entries: DataFrame, uniprot: str, words: str, reference: Column, max_resolution: float = 3.0, deny: Sequence[str] = tuple(NOT_LIGANDS)) -> DataFrame:
    """One row an entry: chains, first candidate ligand, covalent state, status, review flag and notes."""
    real = F.filter(F.coalesce("ligands", F.array().cast("array<struct<comp_id:string,name:string,weight:double,chains:array<string>,linked:boolean>>")), lambda x: ~x["comp_id"].isin(*deny))
    e = entries.withColumn("_e", once(F.struct(real.alias("l"), targets(F.col("polymers"), uniprot, words).alias("t"))))
    ligands = F.transform("_e.l", lambda x: F.struct(x["comp_id"].alias("comp_id"), x["name"].alias("name"), x["linked"].alias("linked")))
    chains = flat(F.transform("_e.t", lambda p: p["chains"]))
    e = e.select("pdb_id", "title", "resolution", "method", "deposit_date", "release_date", "inter_mol_covalent", ligands.alias("_l"), chains.alias("_chains"), mutated(F.col("_e.t")).alias("_spots"), aligned(F.col("_e.t"), uniprot).alias("_regions"))
    # rows that share an id share their polymers; what is dealt are short rows, and once
    same = Window.partitionBy("pdb_id")
    e = e.withColumns({c: F.when(F.col("pdb_id").isNotNull(), F.flatten(F.collect_list(c).over(same))) for c in ("_chains", "_spots", "_regions")})
    e = e.withColumns({"chains": F.array_sort(F.array_distinct("_chains")), "_first": F.get("_l", F.lit(0)), "mutation_string": mutation_string(F.col("_spots"), F.col("_regions"), reference)})
    n, linked_elsewhere = F.size("_l"), F.coalesce("inter_mol_covalent", F.lit(0)) > 0
    e = e.select(
        "pdb_id", "title", F.get("chains", F.lit(0)).alias("egfr_chain"), F.coalesce(F.size("chains"), F.lit(0)).alias("n_egfr_chains"), "mutation_string",
        F.col("_first.comp_id").alias("ligand_comp_id"), F.col("_first.name").alias("ligand_common_name"), n.alias("n_candidate_ligands"),
        F.array_join(F.transform("_l", lambda x: x["comp_id"]), ",").alias("candidate_ligands"),
        F.when(n == 0, F.when(linked_elsewhere, "UNKNOWN_NO_LIGAND").otherwise("NOT_APPLICABLE_NO_LIGAND")).when(F.exists("_l", lambda x: x["linked"]), "COVALENT_CONFIRMED").when(linked_elsewhere, "INTERMOL_COVALENT_BUT_NOT_ON_LIGAND").otherwise("NON_COVALENT").alias("covalent_status"),
        F.col("resolution").alias("resolution_A"), F.col("method").alias("experimental_method"), F.to_date("deposit_date").alias("deposit_date"), F.to_date("release_date").alias("release_date"),
    )
    e = e.withColumn("metadata_status", F.when(n_is(0), "NO_LIGAND_FOUND").when(F.col("n_candidate_ligands") > 1, "MULTIPLE_LIGAND_CANDIDATES").otherwise("OK"))
    return review(
        e,
        (F.col("n_egfr_chains") == 0, "no target chain"),
        (n_is(0), "no candidate ligand"),
        (F.col("n_candidate_ligands") > 1, "several candidate ligands"),
        (F.col("covalent_status") == "COVALENT_CONFIRMED", "covalent ligand"),
        (F.col("covalent_status") == "INTERMOL_COVALENT_BUT_NOT_ON_LIGAND", "covalent link elsewhere"),
        (F.col("n_egfr_chains") > 1, "several target chains"),
        (F.col("resolution_A") > max_resolution, "low resolution"),
    )


def n_is(k: int) -> Column:
    return F.col("n_candidate_ligands") == k


def qc_checks() -> dict[str, Column]:
    """The subsets of an inventory that need a look; confirmed covalent ligands are one of their own."""
    return {
        "qc_no_ligand_found": F.col("metadata_status") == "NO_LIGAND_FOUND",
        "qc_multiple_ligand_candidates": F.col("metadata_status") == "MULTIPLE_LIGAND_CANDIDATES",
        "qc_suspected_covalent": F.col("covalent_status") == "SUSPECTED_COVALENT",
        "qc_covalent_confirmed": F.col("covalent_status") == "COVALENT_CONFIRMED",
        "qc_multiple_egfr_chains": F.col("n_egfr_chains") > 1,
        "qc_low_resolution": F.coalesce("resolution_A", F.lit(0.0)) > 3.0,
        "qc_entry_fetch_failed": F.col("metadata_status") == "ENTRY_FETCH_FAILED",
        "qc_manual_review_required": F.col("manual_review_required"),
    }


def affinity_survey(ligands: DataFrame, affinities: DataFrame, resolutions: DataFrame, known: DataFrame, *, min_weight: float = 200, max_weight: float = 900, max_resolution: float = 2.8, kinds: Sequence[str] = ("KD", "KI", "IC50", "EC50"), deny: Sequence[str] = tuple(NOT_SURVEYED)) -> DataFrame:
    """Candidate ligands with their preferred affinity in pM.

    Weights (missing: 0) and resolutions (missing: 99) are filtered first; values
    match by ligand, or have a blank ligand where none matches; known rows are added
    where their entry is absent; kinds in the given order, then the lowest value, decide.
    """
    lig = ligands.filter(~F.col("ligand_id").isin(*deny) & F.coalesce("ligand_mw", F.lit(0.0)).between(min_weight, max_weight))
    lig = lig.join(resolutions, "pdb_id", "left").withColumn("resolution_A", F.coalesce("resolution_A", F.lit(99.0))).filter(F.col("resolution_A") <= max_resolution)
    a = affinities.filter(F.upper("affinity_type").isin(*kinds)).withColumn("affinity_pM", to_picomolar(F.col("value"), F.col("unit_raw")))
    a = a.filter("affinity_pM is not null").withColumn("v", F.struct("affinity_type", "affinity_pM", "unit_raw"))
    out = match_or_blank(lig, a, ["pdb_id"], "ligand_id", "v").select(*lig.columns, "v.*")
    out = append_absent(out, known, ["pdb_id"])
    rank = F.lit(len(kinds))
    for k, name in reversed(list(enumerate(kinds))):
        rank = F.when(F.upper("affinity_type") == name, k).otherwise(rank)
    out = keep_first(out, [rank.asc_nulls_last(), F.col("affinity_pM").asc_nulls_last(), F.col("unit_raw")], ["pdb_id", "ligand_id"])
    return out.withColumn("log10_affinity_pM", log10_floor(F.col("affinity_pM")))
