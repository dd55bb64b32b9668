"""Tables on disk: CSV, Parquet, nested JSON, override maps; and sinks with safe targets."""

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and a declared schema: ids such as 1E10 or 634 stay text."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A document or a list of them in each file, or with ``lines`` one in each line."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def overrides(spark: SparkSession, entries: Mapping[str, Mapping[str, str]], key: str = "pdb_id") -> DataFrame:
    """A map of id to fields as a table; fields that an entry lacks are NULL."""
    names = sorted({n for e in entries.values() for n in e})
    schema = ", ".join(f"`{c}` string" for c in [key, *names])
    return spark.createDataFrame([(k, *[e.get(n) for n in names]) for k, e in entries.items()], schema)


@dataclass(frozen=True)
class Paths:
    """Input and output roots; overriding outputs never changes inputs, nor the original."""

    data: str
    results: str
    checkpoints: str
    structures: str | None = None

    def with_outputs(self, results: str | None = None, checkpoints: str | None = None, structures: str | None = None) -> "Paths":
        new = {k: v for k, v in (("results", results), ("checkpoints", checkpoints), ("structures", structures)) if v}
        return replace(self, **new)

    def structure_folder(self, pdb_id: str, ligand: str) -> str | None:
        return f"{self.structures.rstrip('/')}/{pdb_id}_{ligand}" if self.structures else None

    def target(self, table: str, only_id: str | None = None) -> str:
        """Where a table goes: runs for a single id never overwrite the main table."""
        root = self.results.rstrip("/")
        return f"{root}/test/{table}_{only_id}" if only_id else f"{root}/{table}"


def write_partitions(df: DataFrame, path: str, by: str = "structure_id") -> None:
    """One folder per structure; only the structures at hand are overwritten."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One file only for summaries that are known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_structures(lines: DataFrame, path: str, key: str = "structure_id") -> None:
    """Text of each structure in a folder of its own, in order of ``block`` and ``line_no``."""
    lines.repartition(key).sortWithinPartitions(key, "block", "line_no").select(key, "line").write.partitionBy(key).mode("overwrite").text(path)

