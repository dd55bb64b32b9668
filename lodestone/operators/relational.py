"""Joins, filters, set operations and aggregates with the reference's semantics."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import notes
from lodestone.operators.selection import first_by


def only(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose id equals the value in any case; an error if there is none."""
    out = df.filter(F.lower(column) == value.lower())
    if out.isEmpty():
        raise ValueError(f"no row with {column} = {value!r}")
    return out


def allowed(df: DataFrame, column: str, values: Sequence, deny: bool = False) -> DataFrame:
    test = F.col(column).isin(*values)
    return df.filter(~test if deny else test)


def lookup_first(df: DataFrame, table: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Columns of the table's first row of each key, matched in any case."""
    t = first_by(table.withColumn("_k", F.lower(key)).drop(key), ["_k"], order)
    return df.withColumn("_k", F.lower(key)).join(t, "_k", "left").drop("_k")


def interval_map(points: DataFrame, regions: DataFrame, key: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """Positions mapped by the first region (``beg``, ``length``, ``ref_beg``) that holds them; NULL if none.

    ``key`` ties points to their regions, so the range test is a residual of a hash join.
    """
    r = regions.select(*key, "beg", "length", "ref_beg", *[F.col(o).alias(f"_o_{o}") for o in order])
    inside = F.col(position).between(F.col("beg"), F.col("beg") + F.col("length") - 1)
    hit = points.join(r.hint("merge"), list(key)).filter(inside)
    hit = first_by(hit, points.columns, [F.col(f"_o_{o}") for o in order])
    hit = hit.select(*[F.col(c).alias(f"_h_{c}") for c in points.columns], (F.col("ref_beg") + F.col(position) - F.col("beg")).alias("mapped"))
    on = F.lit(True)
    for c in points.columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return points.join(hit.hint("merge"), on, "left").select(*points.columns, "mapped")


def match_or_blank(df: DataFrame, table: DataFrame, on: Sequence[str], exact: str, value: str) -> DataFrame:
    """Values of rows that match on ``exact``; only where there are none, of rows with a blank ``exact``."""
    t = table.select(*on, F.col(exact).alias("_x"), F.col(value))
    j = df.join(t, list(on), "left")
    is_match, is_blank = F.col("_x") == F.col(exact), F.coalesce(F.trim("_x"), F.lit("")) == ""
    j = j.filter(F.col("_x").isNull() | is_match | is_blank).withColumn("_m", F.coalesce(is_match, F.lit(False)))
    j = j.withColumn("_any", F.max("_m").over(Window.partitionBy(*df.columns)))
    return j.filter(F.col("_m") | ~F.col("_any")).select(*df.columns, value)


def append_absent(df: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Known rows are added only where their key is absent."""
    return df.unionByName(known.join(df.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def missing_keys(wanted: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    return wanted.select(*key).distinct().join(present.select(*key), list(key), "left_anti")


def require(wanted: DataFrame, present: DataFrame, key: str, shown: int = 20) -> None:
    """An error that lists keys which are wanted and not present."""
    absent = [r[0] for r in missing_keys(wanted, present, [key]).orderBy(key).limit(shown).collect()]
    if absent:
        raise ValueError(f"not ready: {', '.join(map(str, absent))}")


def readiness(base: DataFrame, stages: Mapping[str, DataFrame], key: str, good: str = "OK") -> DataFrame:
    """One status column a stage (left joins) and whether all are good."""
    out = base
    for name, t in stages.items():
        out = out.join(t.select(key, F.col("status").alias(f"{name}_status")), key, "left")
    ready = F.lit(True)
    for name in stages:
        ready = ready & F.coalesce(F.col(f"{name}_status") == good, F.lit(False))
    return out.withColumn("ready", ready)


def candidates(inventory: DataFrame, prepared: DataFrame, validated: DataFrame, key: str, ligand: str, good: str = "OK") -> DataFrame:
    """Inventory rows that are prepared and whose ligand is validated; filters run before the joins."""
    ok = prepared.filter(F.col("status") == good).select(key)
    ligands = validated.filter(F.col("status") == good).select(ligand)
    return inventory.join(ok, key).join(ligands, ligand, "left_semi")


def qc_split(df: DataFrame, checks: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """(qc_name, keep) for each check a row fails, in one pass over the table."""
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    return df.select(F.explode(failed).alias("qc_name"), *keep)


def write_qc(df: DataFrame, checks: Mapping[str, Column], keep: Sequence[str], path: str) -> None:
    qc_split(df, checks, keep).write.partitionBy("qc_name").mode("overwrite").option("header", True).csv(path)


def review(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """``manual_review_required`` if any rule holds, and ``notes`` with the texts of those that do."""
    any_rule = F.lit(False)
    for test, _ in rules:
        any_rule = any_rule | F.coalesce(test, F.lit(False))
    return df.withColumns({"manual_review_required": any_rule, "notes": notes(*rules)})


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def name_reconciliation(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str, ignore_extra: Column | None = None) -> DataFrame:
    """Names only in a and only in b per key, and whether they agree; extras that are ignored do not count."""
    j = a.select(*keys, name).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys, name).distinct().withColumn("_b", F.lit(True)).hint("merge"), [*keys, name], "full")
    only_a, only_b = F.col("_b").isNull(), F.col("_a").isNull()
    counted = only_b if ignore_extra is None else only_b & ~ignore_extra
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(name)))), ",")
    return j.groupBy(*keys).agg(F.count_if(only_a).alias("n_only_a"), F.count_if(counted).alias("n_only_b"), names(only_a).alias("only_a"), names(counted).alias("only_b"), F.bool_and(~only_a & ~counted).alias("all_match"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reconcile(source: DataFrame, result: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts of both sides and keys that are lost or new, in one row."""
    a = source.groupBy(*key).agg(F.count("*").alias("na"))
    b = result.groupBy(*key).agg(F.count("*").alias("nb"))
    return a.join(b, list(key), "full").agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_out"), F.count_if(F.col("nb").isNull()).alias("lost"), F.count_if(F.col("na").isNull()).alias("new"))


def stage_completeness(stages: Mapping[str, DataFrame], key: str) -> DataFrame:
    """How many keys reached each stage, and how many reached all."""
    out = None
    for name, t in stages.items():
        s = t.select(key).distinct().withColumn(f"has_{name}", F.lit(True))
        out = s if out is None else out.join(s, key, "full")
    every = F.lit(True)
    for n in stages:
        every = every & F.coalesce(f"has_{n}", F.lit(False))
    return out.agg(F.count("*").alias("n_keys"), *[F.count(f"has_{n}").alias(f"n_{n}") for n in stages], F.count_if(every).alias("n_all"))


def source_cascade(base: DataFrame, sources: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first source that has one, and that source's name."""
    out = base
    for n, t in sources.items():
        out = out.join(t.select(key, F.col(value).alias(f"_{n}")), key, "left")
    method = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in sources])
    return out.withColumns({value: F.coalesce(*[F.col(f"_{n}") for n in sources]), "method": method}).drop(*[f"_{n}" for n in sources])
