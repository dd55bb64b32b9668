"""Best rows per key: alternatives, copies, priorities; gaps, numbering and motifs in sequences."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import mean_of_present
from lodestone.operators.geometry import min_distance


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.  The order must be total for a result that reruns repeat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def best_alternative(atoms: DataFrame, keys=("structure_id", "chain", "resseq", "icode", "atom_name")) -> DataFrame:
    """One alternate location per atom, with ``n_dropped`` of its key.

    Among blank and ``A`` the highest occupancy, else the highest of all; the first
    line on ties; blank occupancy counts 1.
    """
    usual = F.coalesce("altloc", F.lit("")).isin("", " ", "A")
    w = Window.partitionBy(*keys)
    ranked = atoms.withColumn("_rn", F.row_number().over(w.orderBy(usual.desc(), F.coalesce("occupancy", F.lit(1.0)).desc(), "line_no")))
    return ranked.withColumn("n_dropped", F.count("*").over(w) - 1).filter("_rn = 1").drop("_rn")


def first_alternative(atoms: DataFrame) -> DataFrame:
    """Only blank and ``A`` locations, the mark removed."""
    return atoms.filter(F.coalesce("altloc", F.lit("")).isin("", " ", "A")).withColumn("altloc", F.lit(""))


def highest_occupancy(atoms: DataFrame, keys=("structure_id", "model_no", "chain", "resseq", "icode", "atom_name")) -> DataFrame:
    """The view that geometry uses: first model only, one location per atom name."""
    first = atoms.filter(F.coalesce("model_no", F.lit(1)) == 1)
    return first_by(first, keys, [F.coalesce("occupancy", F.lit(1.0)).desc(), F.col("line_no")])


def gaps(df: DataFrame, keys=("structure_id", "chain"), number: str = "resseq") -> DataFrame:
    """Missing runs of a numbered sequence: one row ``first``-``last`` per gap."""
    w = Window.partitionBy(*keys).orderBy(number)
    d = df.select(*keys, number).distinct().withColumn("nxt", F.lead(number).over(w)).filter(F.col("nxt") - F.col(number) > 1)
    return d.select(*keys, (F.col(number) + 1).alias("first"), (F.col("nxt") - 1).alias("last"))


def gap_text(df: DataFrame, keys=("structure_id", "chain"), number: str = "resseq") -> DataFrame:
    g = gaps(df, keys, number)
    label = F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    return g.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", label.alias("t")))), lambda s: s["t"]), ";").alias("missing_residue_ranges"))


def renumber(df: DataFrame, keys: Sequence[str], item: Sequence[str], order: str, out: str = "pose_resnum") -> DataFrame:
    """Items numbered 1.. by their first appearance within a key."""
    first = df.groupBy(*keys, *item).agg(F.min(order).alias("_first"))
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("_first", *item))).drop("_first")


def number_with_ligand(residues: DataFrame, ligands: DataFrame, keys=("structure_id",), out: str = "pose_resnum") -> DataFrame:
    """The ligand's row after its structure's last residue."""
    last = residues.groupBy(*keys).agg((F.max(out) + 1).alias(out))
    return residues.unionByName(ligands.join(last.hint("merge"), list(keys)), allowMissingColumns=True)


def in_band(df: DataFrame, keys: Sequence[str], distance: str, band: float, order: Sequence[Column]) -> DataFrame:
    """Best row of each key among those within ``band`` of the smallest distance; ``n_equal`` tells how many."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_min", F.min(distance).over(w)).filter(F.col(distance) <= F.col("_min") + band)
    return first_by(d.withColumn("n_equal", F.count("*").over(w)), keys, order).drop("_min")


def keep_first(df: DataFrame, sort: Sequence[Column], subset: Sequence[str]) -> DataFrame:
    """Sort, then the first row of each subset; NULL sorts last as given by the columns."""
    return first_by(df, subset, sort)


def motif_hits(letters: DataFrame, motif: str, keys=("structure_id", "chain"), position: str = "pos", letter: str = "aa", low: int | None = None, high: int | None = None) -> DataFrame:
    """Positions where the motif's letters have consecutive numbers (not merely consecutive rows)."""
    s = letters.select(*keys, F.col(position).alias("pos"), F.col(letter).alias("_a"))
    out = s.filter(F.col("_a") == motif[0])
    if low is not None:
        out = out.filter(F.col("pos").between(low, high))
    out = out.select(*keys, "pos")
    for k, x in enumerate(motif[1:], 1):
        nxt = s.filter(F.col("_a") == x).select(*keys, (F.col("pos") - k).alias("pos"))
        out = out.join(nxt.hint("merge"), [*keys, "pos"], "left_semi")
    return out.distinct()


def numbering_offset(chains: DataFrame, hits: Mapping[int, DataFrame], keys=("structure_id", "chain")) -> DataFrame:
    """Offset of each chain's numbers from the usual ones: by two motifs and their usual positions.

    Both found once and equal: that; one found once and the other not at all: that; else NULL.
    """
    out = chains.select(*keys).distinct()
    names = []
    for k, (usual, found) in enumerate(hits.items()):
        c = found.groupBy(*keys).agg(F.count("*").alias(f"n{k}"), F.min(F.lit(usual) - F.col("pos")).alias(f"o{k}"))
        out = out.join(c.hint("merge"), list(keys), "left").withColumn(f"n{k}", F.coalesce(f"n{k}", F.lit(0)))
        names.append((F.col(f"n{k}"), F.col(f"o{k}")))
    (n0, o0), (n1, o1) = names
    offset = F.when((n0 == 1) & (n1 == 1) & (o0 == o1), o0).when((n0 == 1) & (n1 == 0), o0).when((n1 == 1) & (n0 == 0), o1)
    return out.select(*keys, offset.cast("int").alias("offset"))


def motif_check(letters: DataFrame, offsets: DataFrame, expected: Mapping[int, str], tolerated: Sequence[int] = (), least: int = 6, keys=("structure_id", "chain"), position: str = "pos", letter: str = "aa") -> DataFrame:
    """How many of the expected letters a chain has at its calibrated positions.

    Positions where mutants are known count as right with any letter.
    """
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("want")) for p, a in expected.items()])
    want = offsets.withColumn("_e", F.explode(table)).select(*keys, "offset", F.col("_e.p").alias("p"), F.col("_e.want").alias("want"))
    have = letters.select(*keys, F.col(position).alias("_pos"), F.col(letter).alias("have"))
    j = want.withColumn("_pos", F.col("p") - F.col("offset")).join(have.hint("merge"), [*keys, "_pos"], "left")
    ok = F.col("have").isNotNull() & ((F.col("have") == F.col("want")) | F.col("p").isin(*tolerated) if tolerated else F.col("have") == F.col("want"))
    c = j.groupBy(*keys, "offset").agg(F.count_if(ok).cast("int").alias("n_ok"), F.count("have").cast("int").alias("n_checked"))
    c = c.withColumn("n_missing", F.lit(len(expected)) - F.col("n_checked"))
    status = F.when(F.col("offset").isNull(), "FAILED_MOTIF_NOT_FOUND").when(F.col("offset") == 0, "OK").otherwise(F.concat(F.lit("OFFSET_DETECTED("), F.col("offset").cast("string"), F.lit(")")))
    return c.select(*keys, "offset", "n_ok", "n_checked", "n_missing", ((F.col("n_ok") == F.col("n_checked")) & (F.col("n_checked") >= least)).alias("all_ok"), status.alias("calibration_status"))


def copy_quality(ligand_atoms: DataFrame, keys=("structure_id", "chain", "resseq")) -> DataFrame:
    """Mean occupancy of heavy atoms (blank or 0: 1) and atoms with an alternate location, per copy."""
    heavy = ligand_atoms.filter(~F.upper("element").isin("H", "D"))
    occ = F.when(F.coalesce("occupancy", F.lit(0.0)) == 0, 1.0).otherwise(F.col("occupancy"))
    return heavy.groupBy(*keys).agg(F.avg(occ).alias("mean_occupancy"), F.count_if(~F.coalesce("altloc", F.lit("")).isin("", " ")).alias("n_altloc_atoms"))


def completeness(atoms: DataFrame, keys=("structure_id", "chain")) -> DataFrame:
    """Residues modelled and residues without an alpha carbon."""
    r = atoms.groupBy(*keys, "resseq", "icode").agg(F.bool_or(F.col("atom_name") == "CA").alias("ca"))
    return r.groupBy(*keys).agg(F.count("*").alias("n_modelled"), F.count_if(~F.col("ca")).alias("n_missing_ca"))


def pocket_distances(copies: DataFrame, residues: DataFrame, offsets: DataFrame, references: Mapping[str, Sequence[int]], keys=("structure_id",)) -> DataFrame:
    """Smallest distance of each ligand copy to each reference of each calibrated chain, and their mean.

    ``references`` names usual positions; several (a range) give the smallest of all.
    """
    table = F.array(*[F.struct(F.lit(n).alias("ref"), F.lit(p).alias("p")) for n, ps in references.items() for p in ps])
    spots = offsets.filter("offset is not null").withColumn("_r", F.explode(table)).select(*keys, "chain", F.col("_r.ref").alias("ref"), (F.col("_r.p") - F.col("offset")).alias("resseq"))
    atoms = residues.join(spots.hint("merge"), [*keys, "chain", "resseq"]).withColumn("target", F.struct("chain", "ref"))
    d = min_distance(copies, atoms, keys, "copy", "target")
    names = list(references)
    nearest = [F.min(F.when(F.col("target.ref") == n, F.col("dist"))).alias(f"d_{n}") for n in names]
    wide = d.groupBy(*keys, "copy", F.col("target.chain").alias("chain")).agg(*nearest)
    return wide.withColumn("mean_pocket_dist", mean_of_present(*[F.col(f"d_{n}") for n in names]))


def select_copy(distances: DataFrame, quality: DataFrame, complete: DataFrame, checks: DataFrame, pocket: float = 10.0, band: float = 1.0, keys=("structure_id",)) -> DataFrame:
    """The copy and chain to use for each structure, with status and reason.

    Nearest chain per copy; copies strictly within ``pocket``; those within ``band``
    of the best count as equal and are told apart by missing CA, occupancy, altlocs, distance.
    """
    near = first_by(distances.filter("mean_pocket_dist is not null"), [*keys, "copy"], [F.col("mean_pocket_dist"), F.col("chain")])
    near = near.filter(F.col("mean_pocket_dist") < pocket).join(quality.hint("merge"), [*keys, "copy"], "left").join(complete.hint("merge"), [*keys, "chain"], "left").withColumn("n_missing_ca", F.coalesce("n_missing_ca", F.lit(999)))
    near = near.withColumn("n_pocket_ligand_copies", F.count("*").over(Window.partitionBy(*keys)))
    label = F.format_string("%s (%.2f)", F.col("copy").cast("string"), F.col("mean_pocket_dist"))
    every = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("copy", label.alias("t")))).alias("_all"))
    best = in_band(near, keys, "mean_pocket_dist", band, [F.col("n_missing_ca"), F.col("mean_occupancy").desc(), F.col("n_altloc_atoms"), F.col("mean_pocket_dist"), F.col("copy")])
    valid = checks.groupBy(*keys).agg(F.count_if("all_ok").alias("n_valid_motif_chains"))
    out = checks.select(*keys).distinct().join(best.hint("merge"), list(keys), "left").join(every.hint("merge"), list(keys), "left").join(valid.hint("merge"), list(keys), "left")
    status = F.when(F.col("copy").isNull(), "NO_POCKET_LIGAND_FOUND").when(F.col("n_valid_motif_chains") >= 1, "OK").otherwise("MOTIF_CHECK_FAILED")
    tie = F.when(F.col("n_equal") > 1, F.format_string(" %d copies were equal in distance; told apart by missing CA %d, occupancy %.2f, altlocs %d.", "n_equal", "n_missing_ca", "mean_occupancy", "n_altloc_atoms")).otherwise("")
    others = F.array_join(F.transform(F.filter("_all", lambda s: s["copy"] != F.col("copy")), lambda s: s["t"]), ", ")
    reason = F.when(F.col("copy").isNull(), "no copy within the pocket").otherwise(F.concat(F.format_string("copy %s is nearest (mean %.2f), chain %s.", F.col("copy").cast("string"), "mean_pocket_dist", "chain"), tie, F.when(others != "", F.concat(F.lit(" Others: "), others, F.lit("."))).otherwise("")))
    return out.select(*keys, F.col("chain").alias("selected_chain"), F.col("copy").alias("selected_copy"), status.alias("selection_status"), reason.alias("reason"), F.coalesce("n_pocket_ligand_copies", F.lit(0)).alias("n_pocket_ligand_copies"), F.coalesce("n_valid_motif_chains", F.lit(0)).alias("n_valid_motif_chains"))


def unique_names(df: DataFrame, keys: Sequence[str], name: str = "name", element: str = "elem", order: str = "atom_id") -> DataFrame:
    """Repeated or empty names become element + smallest free number within the key.

    A number is free if no name that stays has it.  The k-th free one is k and the
    taken ones before it: the j-th taken number t has ``t - j`` free ones before it, so
    it is passed over by all that come after those.  Windows only, no joins.
    """
    w = Window.partitionBy(*keys, name)
    clash = (F.count("*").over(w) > 1) | (F.coalesce(F.col(name), F.lit("")) == "")
    d = df.withColumn("_clash", clash)
    stem, number = F.regexp_extract(name, "^([A-Za-z]+)[0-9]+$", 1), F.regexp_extract(name, "^[A-Za-z]+([0-9]+)$", 1).try_cast("int")
    d = d.withColumn("_e", F.when(F.col("_clash"), F.col(element)).when(number > 0, stem)).withColumn("_k", F.when(~F.col("_clash") & (number > 0), number))
    own = Window.partitionBy(*keys, "_e", "_clash")
    d = d.withColumns({"_at": F.when(F.col("_clash"), F.row_number().over(own.orderBy(order))), "_j": F.dense_rank().over(own.orderBy("_k")), "_again": F.row_number().over(Window.partitionBy(*keys, "_e", "_clash", "_k").orderBy(order))})
    d = d.withColumns({"_v": F.when(F.col("_clash"), F.col("_at")).otherwise(F.col("_k") - F.col("_j") + 1), "_one": F.when(F.col("_k").isNotNull() & (F.col("_again") == 1), 1).otherwise(0)})
    before = F.sum("_one").over(Window.partitionBy(*keys, "_e").orderBy("_v", "_clash").rowsBetween(Window.unboundedPreceding, 0))
    new = F.concat(F.col(element), (F.col("_at") + before).cast("string"))
    return d.withColumn("_new", new).withColumn(name, F.when(F.col("_clash"), F.col("_new")).otherwise(F.col(name))).select(*df.columns)


def first_match(base: DataFrame, rows: DataFrame, keys: Sequence[str], name: str, wanted: str, number: str, letters: int = 3, out: str = "found") -> DataFrame:
    """Smallest number of the rows whose name starts like the wanted one; NULL if there is none."""
    want = base.select(*keys, F.substring(wanted, 1, letters).alias("_w")).distinct()
    hit = rows.select(*keys, F.substring(name, 1, letters).alias("_w"), number).join(want.hint("merge"), [*keys, "_w"]).groupBy(*keys, "_w").agg(F.min(number).alias(out))
    return base.withColumn("_w", F.substring(wanted, 1, letters)).join(hit.hint("merge"), [*keys, "_w"], "left").drop("_w")


def by_priority(df: DataFrame, keys: Sequence[str], name: str, priority: Mapping[str, int], order: str, out: str = "place") -> DataFrame:
    """Places of rows within a key by a priority of names (0 if not listed), then by order."""
    rank = F.lit(0)
    for k, v in priority.items():
        rank = F.when(F.col(name) == k, v).otherwise(rank)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(rank, order)))
