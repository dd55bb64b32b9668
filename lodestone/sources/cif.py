"""Category loops and key/value blocks of CIF text as rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import once

TOKEN = "'[^']*'|\"[^\"]*\"|\\S+"


def loop_rows(files: DataFrame, category: str, columns: list[str], text: str = "value", keys=("structure_id",)) -> DataFrame:
    """Rows of one category (``loop_`` or key/value form), the asked columns as text.

    Quoted tokens stay whole and lose their quotes; ``.`` and ``?`` are NULL; a
    column that the file does not have is NULL.  Order is in ``row_no``.
    """
    name = f"_{category}."
    # the lines from the category's first name to the next '#', 'loop_' or other category
    block = F.regexp_extract(F.concat(F.lit("\n"), F.col(text), F.lit("\n#\n")), f"(?s)\\n((?:loop_\\s*\\n)?{name.replace('.', chr(92) + '.')}.*?)\\n(?:#|loop_|data_|_(?!{category}\\.))", 1)
    # once() keeps the conditions that follow from finding blocks and tokens again
    b = files.select(*keys, once(block).alias("_b")).filter("_b <> ''")
    b = b.select(*keys, once(F.regexp_extract_all("_b", F.lit(f"({TOKEN})"), 1)).alias("_t"))
    is_name = lambda t: t.startswith(name)
    named = b.select(*keys, F.filter("_t", is_name).alias("_n"), F.filter("_t", lambda t: ~is_name(t) & (t != "loop_")).alias("_v"))
    at = [F.array_position("_n", name + c).cast("int").alias(f"_at{k}") for k, c in enumerate(columns)]
    b = named.select(*keys, once(F.struct("_v", F.size("_n").alias("_w"), *at)).alias("_s")).select(*keys, "_s.*")
    whole = b.filter((F.col("_w") > 0) & (F.size("_v") >= F.col("_w")))
    rows = whole.withColumn("row_no", F.explode(F.sequence(F.lit(0), (F.floor(F.size("_v") / F.col("_w")) - 1).cast("int"))))
    rows = rows.select(*keys, "row_no", *[F.when(F.col(f"_at{k}") > 0, F.get("_v", F.col("row_no") * F.col("_w") + F.col(f"_at{k}") - 1)).alias(c) for k, c in enumerate(columns)])
    bare = lambda t: F.when(t.startswith("'") | t.startswith('"'), F.regexp_replace(t, "^(['\"])(.*)\\1$", "$2")).otherwise(t)
    return rows.select(*keys, "row_no", *[F.when(~F.col(c).isin(".", "?"), bare(F.col(c))).alias(c) for c in columns])


def component_atoms(files: DataFrame, keys=("structure_id",)) -> DataFrame:
    cols = ["comp_id", "atom_id", "type_symbol", "charge", "model_Cartn_x", "model_Cartn_y", "model_Cartn_z", "pdbx_ordinal"]
    r = loop_rows(files, "chem_comp_atom", cols, keys=keys)
    return r.select(*keys, "row_no", "comp_id", "atom_id", "type_symbol", F.col("charge").try_cast("int").alias("charge"), *[F.col(f"model_Cartn_{c}").try_cast("double").alias(c) for c in "xyz"])


def component_bonds(files: DataFrame, keys=("structure_id",)) -> DataFrame:
    r = loop_rows(files, "chem_comp_bond", ["comp_id", "atom_id_1", "atom_id_2", "value_order", "pdbx_aromatic_flag"], keys=keys)
    order = F.when(F.col("pdbx_aromatic_flag") == "Y", 4).when(F.col("value_order") == "SING", 1).when(F.col("value_order") == "DOUB", 2).when(F.col("value_order") == "TRIP", 3).when(F.col("value_order") == "AROM", 4)
    return r.select(*keys, "row_no", "comp_id", "atom_id_1", "atom_id_2", order.alias("bond_order"))


def covalent_links(files: DataFrame, ligand: str = "ligand", keys=("structure_id",)) -> DataFrame:
    """First covalent link of each file whose either partner is the ligand, turned so the protein comes first."""
    from lodestone.operators.selection import first_by

    sides = ["label_comp_id", "label_asym_id", "auth_seq_id", "label_atom_id"]
    cols = ["conn_type_id", "pdbx_dist_value", *[f"ptnr{k}_{s}" for k in (1, 2) for s in sides]]
    r = loop_rows(files, "struct_conn", cols, keys=(*keys, ligand))
    one, two = F.col("ptnr1_label_comp_id") == F.col(ligand), F.col("ptnr2_label_comp_id") == F.col(ligand)
    r = first_by(r.filter((F.col("conn_type_id") == "covale") & (one | two)), keys, [F.col("row_no")])
    pick = lambda s, mine: F.when(one, F.col(f"ptnr{1 if mine else 2}_{s}")).otherwise(F.col(f"ptnr{2 if mine else 1}_{s}"))
    return r.select(*keys, pick("label_comp_id", False).alias("protein_resname"), pick("auth_seq_id", False).alias("protein_resnum"), pick("label_atom_id", False).alias("protein_atom"), pick("label_comp_id", True).alias("ligand_resname"), pick("label_atom_id", True).alias("ligand_atom"), F.col("pdbx_dist_value").try_cast("double").alias("bond_distance"))
