"""Molecule files with many molecules each: atom and bond tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import element_of
from lodestone.sources import text

#: Bond codes of files (fixed values): 4 is aromatic.
BOND_CODES = {"1": 1, "2": 2, "3": 3, "4": 4, "ar": 4, "am": 4, "du": 1, "un": 1, "nc": 1}


def bond_order(code: Column) -> Column:
    """Order of a bond code; an unknown code is an error."""
    out = None
    for k, v in BOND_CODES.items():
        out = F.when(F.lower(code) == k, v) if out is None else out.when(F.lower(code) == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown bond code: "), code)).cast("int"))


def _mol2(numbered: DataFrame, keys) -> DataFrame:
    """Lines with molecule number and section, by running counts of headers."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    head = F.col("line").startswith("@<TRIPOS>")
    d = numbered.filter(~F.col("line").startswith("#"))
    d = d.withColumn("mol_no", F.sum(F.col("line").startswith("@<TRIPOS>MOLECULE").cast("int")).over(w))
    d = d.withColumn("section", F.last(F.when(head, F.expr("substring(line, 10)")), ignorenulls=True).over(w))
    return d.filter(~head & (F.trim("line") != "")).withColumn("f", F.split(F.trim("line"), "\\s+"))


def mol2_atoms(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    d = _mol2(numbered, keys).filter("section = 'ATOM'")
    f = lambda k: F.get("f", F.lit(k))
    return d.select(*keys, "mol_no", f(0).try_cast("int").alias("atom_id"), f(1).alias("name"), *[f(2 + k).try_cast("double").alias(c) for k, c in enumerate("xyz")], f(5).alias("sybyl_type"), element_of(f(5)).alias("elem"), f(8).try_cast("double").alias("partial_charge"))


def mol2_bonds(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    d = _mol2(numbered, keys).filter("section = 'BOND'")
    f = lambda k: F.get("f", F.lit(k))
    return d.select(*keys, "mol_no", f(1).try_cast("int").alias("a1"), f(2).try_cast("int").alias("a2"), bond_order(f(3)).alias("bond_order"))


def _v2000(numbered: DataFrame, keys) -> DataFrame:
    """Lines of V2000 records with their number in the molecule and its counts."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    d = numbered.withColumn("mol_no", F.coalesce(F.sum((F.col("line") == "$$$$").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    m = Window.partitionBy(*keys, "mol_no").orderBy("line_no")
    d = d.withColumn("k", F.row_number().over(m))
    counts = F.max(F.when(F.col("k") == 4, F.col("line"))).over(Window.partitionBy(*keys, "mol_no"))
    d = d.withColumn("_c", counts)
    return d.withColumns({"n_atoms": F.trim(F.substring("_c", 1, 3)).try_cast("int"), "n_bonds": F.trim(F.substring("_c", 4, 3)).try_cast("int")})


def sdf_atoms(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    d = _v2000(numbered, keys).filter((F.col("k") > 4) & (F.col("k") <= 4 + F.col("n_atoms")))
    num = lambda s: F.trim(F.substring("line", s, 10)).try_cast("double")
    return d.select(*keys, "mol_no", (F.col("k") - 4).alias("atom_id"), num(1).alias("x"), num(11).alias("y"), num(21).alias("z"), F.upper(F.trim(F.substring("line", 32, 3))).alias("elem"))


def sdf_bonds(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    d = _v2000(numbered, keys).filter((F.col("k") > 4 + F.col("n_atoms")) & (F.col("k") <= 4 + F.col("n_atoms") + F.col("n_bonds")))
    num = lambda s: F.trim(F.substring("line", s, 3))
    return d.select(*keys, "mol_no", num(1).try_cast("int").alias("a1"), num(4).try_cast("int").alias("a2"), bond_order(num(7)).alias("bond_order"))


def formal_charges(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    """(atom_id, charge) of charge lines: a count, then pairs of atom and charge."""
    d = _v2000(numbered, keys).filter(F.col("line").startswith("M  CHG"))
    f = F.split(F.trim(F.expr("substring(line, 10)")), "\\s+")
    d = d.withColumn("_f", f).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.size("_f") / 2 - 1).cast("int"))))
    return d.select(*keys, "mol_no", F.get("_f", F.col("_i") * 2).try_cast("int").alias("atom_id"), F.get("_f", F.col("_i") * 2 + 1).try_cast("int").alias("formal_charge"))


# ---- libraries: files of many molecules, read in byte ranges and parsed a molecule at a time, without a shuffle ----

SDF_MARK, MOL2_MARK = "\n$$$$", "@<TRIPOS>MOLECULE"


def _earlier(shard: str | None) -> Column:
    return F.col("before") if shard else F.lit(0)


def sdf_library(spark: SparkSession, path: str, shard: str | None = None) -> DataFrame:
    """(structure_id, partition columns, mol_no, title, lines) of V2000 records; records without a character are dropped, but count.

    Numbers go on over the files that ``shard`` orders, see ``text.records``.
    """
    r = text.records(spark, path, SDF_MARK, shard)
    # after a mark its line ends first
    body = F.when(F.col("record_no") == 0, F.col("record")).otherwise(F.regexp_replace("record", "^[^\\n]*\\n", ""))
    r = r.filter(F.trim(F.regexp_replace("record", "\\s", "")) != "").withColumn("lines", text.pieces(body))
    return r.select(*[c for c in r.columns if c not in ("path", "before", "record_no", "record", "lines")], (F.col("record_no") + 1 + _earlier(shard)).alias("mol_no"), F.trim(F.get("lines", F.lit(0))).alias("title"), "lines")


def mol2_library(spark: SparkSession, path: str, shard: str | None = None) -> DataFrame:
    """(structure_id, partition columns, mol_no, title, lines) of the molecules of MOL2 files; comments and blank lines are left out.

    Numbers go on over the files that ``shard`` orders, see ``text.records``.
    """
    r = text.records(spark, path, MOL2_MARK, shard, open_end=False).filter("record_no > 0")
    rest = F.regexp_replace("record", "^[^\\n]*\\n", "")
    r = r.withColumn("lines", F.filter(text.pieces(rest), lambda x: ~x.startswith("#") & (F.trim(x) != "")))
    return r.select(*[c for c in r.columns if c not in ("path", "before", "record_no", "record", "lines")], (F.col("record_no") + _earlier(shard)).alias("mol_no"), F.trim(F.get("lines", F.lit(0))).alias("title"), "lines")


def _kept(library: DataFrame) -> list[str]:
    return [c for c in library.columns if c != "lines"]


def _v2000_part(library: DataFrame, part: str) -> DataFrame:
    """Lines of the atoms or bonds of records, by the numbers in their fourth line."""
    counts = F.get("lines", F.lit(3))
    n = [F.greatest(F.coalesce(F.trim(F.substring(counts, s, 3)).try_cast("int"), F.lit(0)), F.lit(0)) for s in (1, 4)]
    first, size = (F.lit(5), n[0]) if part == "atoms" else (F.lit(5) + n[0], n[1])
    return library.select(*_kept(library), F.posexplode(F.slice("lines", first, size)).alias("k", "line"))


def library_atoms(library: DataFrame) -> DataFrame:
    num = lambda s: F.trim(F.substring("line", s, 10)).try_cast("double")
    return _v2000_part(library, "atoms").select(*_kept(library), (F.col("k") + 1).alias("atom_id"), num(1).alias("x"), num(11).alias("y"), num(21).alias("z"), F.upper(F.trim(F.substring("line", 32, 3))).alias("elem"))


def library_bonds(library: DataFrame) -> DataFrame:
    num = lambda s: F.trim(F.substring("line", s, 3))
    return _v2000_part(library, "bonds").select(*_kept(library), num(1).try_cast("int").alias("a1"), num(4).try_cast("int").alias("a2"), bond_order(num(7)).alias("bond_order"))


def library_charges(library: DataFrame) -> DataFrame:
    """(atom_id, formal_charge) of charge lines: a count, then pairs of atom and charge."""
    charges = F.filter("lines", lambda x: x.startswith("M  CHG"))
    d = library.select(*_kept(library), F.explode(charges).alias("line")).withColumn("_f", F.split(F.trim(F.expr("substring(line, 10)")), "\\s+"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("_f") / 2 - 1).cast("int")), lambda i: F.struct(F.get("_f", i * 2).try_cast("int").alias("atom_id"), F.get("_f", i * 2 + 1).try_cast("int").alias("formal_charge")))
    return d.filter(F.size("_f") >= 2).select(*_kept(library), F.inline(pair))


def _section(library: DataFrame, name: str) -> DataFrame:
    """Fields of the lines below each header of a name, up to the next header."""
    head = "@<TRIPOS>"
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x.startswith(head), F.struct(i.alias("i"), F.rtrim(F.substring(x, len(head) + 1, 80)).alias("name")))), lambda h: h.isNotNull())
    d = library.withColumn("_heads", heads)
    stop = lambda j: F.coalesce(F.get("_heads", j + 1)["i"], F.size("lines"))
    below = F.flatten(F.transform("_heads", lambda h, j: F.when(h["name"] == name, F.slice("lines", h["i"] + 2, stop(j) - h["i"] - 1)).otherwise(F.array().cast("array<string>"))))
    return d.select(*_kept(library), F.explode(below).alias("line")).withColumn("f", F.split(F.trim("line"), "\\s+"))


def library_mol2_atoms(library: DataFrame) -> DataFrame:
    f = lambda k: F.get("f", F.lit(k))
    return _section(library, "ATOM").select(*_kept(library), f(0).try_cast("int").alias("atom_id"), f(1).alias("name"), *[f(2 + k).try_cast("double").alias(c) for k, c in enumerate("xyz")], f(5).alias("sybyl_type"), element_of(f(5)).alias("elem"), f(8).try_cast("double").alias("partial_charge"))


def library_mol2_bonds(library: DataFrame) -> DataFrame:
    f = lambda k: F.get("f", F.lit(k))
    return _section(library, "BOND").select(*_kept(library), f(1).try_cast("int").alias("a1"), f(2).try_cast("int").alias("a2"), bond_order(f(3)).alias("bond_order"))
