"""Landed text files as rows: fixed-width records, sequences, parameter names, checksums.

Files of one entry are read whole, one row a file, many at once; lines keep their number
within the file.  Files of many records are read in byte ranges, see ``records``.  Ids
come from the file name.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import lookup, slice_text
from lodestone.functions.storage import materialised

#: One-letter codes of residues, modified ones as their parents (fixed values).
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEP": "S", "TPO": "T", "PTR": "Y"}

#: Fixed-width fields of atom records: column, start, width, type (fixed values).
ATOM_FIELDS = [("record", 1, 6, "string"), ("serial", 7, 5, "int"), ("atom_name", 13, 4, "string"), ("altloc", 17, 1, "string"), ("resname", 18, 3, "string"), ("chain", 22, 1, "string"), ("resseq", 23, 4, "int"), ("icode", 27, 1, "string"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("occupancy", 55, 6, "double"), ("b_factor", 61, 6, "double"), ("element", 77, 2, "string")]


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, line_no, line) of every file under the path."""
    whole = spark.read.text(path, wholetext=True).select(file_stem().alias("structure_id"), "value")
    return lines_of(whole, "value", ["structure_id"])


def lines_of(df: DataFrame, text: str, keys) -> DataFrame:
    """Numbered lines (from 0) of a text column; a last newline adds none."""
    return df.select(*keys, F.posexplode(pieces(F.col(text))).alias("line_no", "line"))


#: At most so many file blocks have their counts broadcast; beyond, records move to them.
FEW_BLOCKS = 100_000


def records(spark: SparkSession, path: str, mark: str, shard: str | None = None, open_end: bool = True) -> DataFrame:
    """(structure_id, path, partition columns, record_no, record): the pieces of files between marks, numbered from 0 in each file.

    Files are read in byte ranges, many tasks a file, so one file may be as large as
    a table.  Each range's records are counted first; sums of the counts before it,
    over one row a range, number its records.  A mark is no part of any record.

    With ``shard``, a partition column in whose order several files are one library, ``before``
    has how many records stand in the files before: their marks, and with ``open_end`` one
    more where something follows a file's last mark.
    """
    parts = spark.read.option("lineSep", mark).text(path)
    own = [c for c in parts.columns if c != "value"]
    at = parts.select(*own, "value", file_stem().alias("structure_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row"))
    block = ["_file", "_start", "_task"]
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    if shard is None:
        counts = at.groupBy(*block).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier("_file").orderBy("_start")), F.lit(0))).drop("_n")
    else:
        full = F.max_by(F.trim(F.regexp_replace("value", "\\s", "")) != "", "_row")
        counts = materialised(at.groupBy(*block, *own).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), full.alias("_full")))
        more = F.when(F.max_by("_full", "_start"), 1).otherwise(0) if open_end else F.lit(0)
        files = counts.groupBy("_file", *own).agg((F.sum("_n") - 1 + more).alias("_marks"))
        library = [c for c in own if c != shard]
        files = files.select("_file", F.coalesce(F.sum("_marks").over(earlier(*library).orderBy(shard, "_file")), F.lit(0)).alias("before"))
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier("_file").orderBy("_start")), F.lit(0))).join(files.hint("merge"), "_file").drop("_n", "_full", *own)
    before = materialised(before)
    side = F.broadcast(before) if before.count() <= FEW_BLOCKS else before.hint("merge")
    known = F.when(F.col("_before").isNull(), F.raise_error(F.lit("files changed while they were read"))).otherwise(F.col("_before") + F.col("_row") - F.col("_first"))
    return at.join(side, block, "left").select("structure_id", F.col("_file").alias("path"), *own, *(["before"] if shard else []), known.cast("long").alias("record_no"), F.col("value").alias("record"))


def pieces(text: Column) -> Column:
    """The lines of a text as an array; a last newline adds none."""
    return F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, entry, header, sequence) of each entry of files with many, read in byte ranges.

    Entries are numbered from 1; what stands before a file's first header is none.
    """
    r = records(spark, path, "\n>")
    # a file's first record has its sign still, or is what stands before the first header
    text = F.when(F.col("record_no") > 0, F.col("record")).when(F.col("record").startswith(">"), F.expr("substring(record, 2)"))
    starts = r.filter((F.col("record_no") == 0) & F.col("record").startswith(">")).select("path", F.lit(1).alias("_one")).distinct()
    l = F.col("_l")  # noqa: E741
    r = r.withColumn("_l", pieces(text)).filter(l.isNotNull()).join(starts.hint("merge"), "path", "left")
    sequence = F.array_join(F.transform(F.slice(l, F.lit(2), F.greatest(F.size(l) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    return r.select(*[c for c in r.columns if c not in ("path", "record_no", "record", "_l", "_one")], (F.col("record_no") + F.coalesce("_one", F.lit(0))).alias("entry"), F.trim(F.get(l, F.lit(0))).alias("header"), sequence.alias("sequence"))


def atoms(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Atom records with typed fields, the model they are in, and the line itself."""
    marks = numbered.filter(F.col("line").rlike("^(ATOM  |HETATM|MODEL )"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    marks = marks.withColumn("model_no", F.greatest(F.sum(F.col("line").startswith("MODEL ").cast("int")).over(w), F.lit(1)).cast("int"))
    a = marks.filter(~F.col("line").startswith("MODEL "))
    return a.select(*keys, "line_no", "model_no", *[slice_text(F.col("line"), s, n, t).alias(c) for c, s, n, t in ATOM_FIELDS], "line")


def polymer_sequences(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    """(keys, chain, pos, resname) in file order from sequence records."""
    s = numbered.filter(F.col("line").startswith("SEQRES"))
    s = s.select(*keys, "line_no", F.trim(F.substring("line", 12, 1)).alias("chain"), F.posexplode(F.split(F.trim(F.expr("substring(line, 20)")), "\\s+")).alias("at", "resname"))
    w = Window.partitionBy(*keys, "chain").orderBy("line_no", "at")
    return s.filter("resname <> ''").select(*keys, "chain", F.row_number().over(w).alias("pos"), "resname")


def one_letter(resname: Column) -> Column:
    return lookup(resname, ONE_LETTER, "X")


def residues(atom_rows: DataFrame, keys=("structure_id",)) -> DataFrame:
    """One row a protein residue, with its letter and alpha carbon."""
    p = atom_rows.filter((F.col("record") == "ATOM") & F.col("resname").isin(*ONE_LETTER))
    ca = F.max(F.when(F.col("atom_name") == "CA", F.struct("x", "y", "z")))
    r = p.groupBy(*keys, "chain", "resseq", "icode").agg(F.min_by("resname", "line_no").alias("resname"), ca.alias("ca"), F.min("line_no").alias("first_line"))
    return r.withColumn("aa1", one_letter(F.col("resname"))).select(*keys, "chain", "resseq", "icode", "resname", "aa1", "first_line", "ca", F.col("ca.x").alias("x"), F.col("ca.y").alias("y"), F.col("ca.z").alias("z"))


def fasta(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Sequence of each file: its lines but headers, in order."""
    s = numbered.filter(~F.col("line").startswith(">")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))).alias("l"))
    return s.select(*keys, F.array_join(F.transform("l", lambda x: x["t"]), "").alias("sequence"))


def parameter_atoms(numbered: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Atom names that a parameter file declares."""
    return numbered.filter(F.col("line").startswith("ATOM ")).select(*keys, "line_no", slice_text(F.col("line"), 6, 4).alias("name"))


def integrity(files: DataFrame, expected: DataFrame, key: str = "structure_id", id_line: str = "HEADER") -> DataFrame:
    """Checksum, size, atom count, id and ligand presence of files (key, content) against (key, comp_id)."""
    f = files.join(expected, key, "right")
    text = F.decode("content", "UTF-8")
    rows = F.split(F.coalesce(text, F.lit("")), "\n")
    header = F.filter(rows, lambda x: x.startswith(id_line))
    present = F.col("content").isNotNull()
    out = f.select(
        key, "comp_id", present.alias("downloaded"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"),
        F.when(present, F.size(F.filter(rows, lambda x: x.startswith("ATOM") | x.startswith("HETATM")))).alias("atom_count"),
        F.exists(header, lambda x: F.upper(F.trim(F.substring(x, 63, 4))) == F.upper(F.col(key))).alias("id_match"),
        F.exists(rows, lambda x: x.startswith("HETATM") & (F.trim(F.substring(x, 18, 3)) == F.col("comp_id"))).alias("ligand_found"),
    )
    status = F.when(~F.col("downloaded"), "DOWNLOAD_FAILED").when(F.col("atom_count") == 0, "EMPTY_FILE").when(~F.col("id_match"), "ID_MISMATCH").when(~F.col("ligand_found"), "LIGAND_NOT_FOUND").otherwise("OK")
    return out.withColumn("status", status)


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, path, content, modified) of landed files."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1).alias("structure_id"), "path", "content", F.col("modificationTime").alias("modified"))


