"""Associations, ranks, histograms and their significance."""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.storage import materialised


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Pearson r, slope, intercept and n per group; NULL with fewer rows than ``least`` or a constant side.

    Rows with a NULL on either side are left out.  One aggregation without a join.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("_c"), F.stddev_samp(x).alias("_sx"), F.stddev_samp(y).alias("_sy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    ok = (F.col("n") >= least) & (F.col("_sx") > 0)
    slope = F.when(ok, F.try_divide("_c", F.col("_sx") * F.col("_sx")))
    r = F.when(ok & (F.col("_sy") > 0), F.try_divide("_c", F.col("_sx") * F.col("_sy")))
    return m.select(*by, F.col("n"), r.alias("r"), slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


FEW_RANGES = 100_000  # rows of counts that are broadcast
HOT = 1000  # a value with over a thousandth of all rows is joined on its own


def cumulative(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: Column | None = None, out: str = "before") -> DataFrame:
    """Each row with the sum of ``n`` (1 if not given) over the rows before it in its group's order.

    Rows are dealt by ranges of (group, order), summed up in their range, and moved on by
    the sums of the group's ranges before, so no task gets a whole group.  Of rows that
    the order does not tell apart any may be first.
    """
    by = list(by)
    d = df.withColumn("_n", F.lit(1) if n is None else n)
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    # written, since ranges that are drawn twice may differ
    dealt = materialised(d.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = materialised(sizes.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_at"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_moved")))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    side = F.broadcast(moved) if moved.count() <= FEW_RANGES else moved.hint("merge")
    return dealt.withColumn("_inside", inside).join(side, same).withColumn(out, F.col("_inside") + F.col("_moved")).select(*df.columns, out)


def rank(df: DataFrame, value: str, by: Sequence[str] = (), ties: str = "average", descending: bool = False, nulls: str = "last", out: str = "rank") -> DataFrame:
    """Ranks from 1 within a group; ties ``first``, ``min``, ``max``, ``average`` or ``random`` (by md5 of the row).

    Ties that share a rank are one row with a count while ranks are made, see
    ``cumulative``, and meet their rows again by a join in which values of many rows are
    broadcast (at most ``HOT`` of them).  Other ties are told apart within the ranges that
    rows are dealt by, so a value of many rows fills several.  ``nulls`` is ``last``, ``first``
    or ``omit``.
    """
    by = list(by)
    c = F.col(value)
    if nulls == "omit":
        df = df.filter(c.isNotNull())
    order = {(False, "first"): c.asc_nulls_first(), (True, "first"): c.desc_nulls_first()}.get((descending, nulls), c.desc_nulls_last() if descending else c.asc_nulls_last())
    if ties in ("first", "random"):
        rest = [F.col(d) for d in df.columns] if ties == "first" else [F.md5(F.to_json(F.struct(*df.columns)).cast("binary"))]
        return cumulative(df, by, [order, *rest], out="_before").withColumn(out, (F.col("_before") + 1).cast("int")).drop("_before")
    counts = materialised(df.groupBy(*by, value).agg(F.count("*").alias("_c")))
    total = counts.agg(F.sum("_c")).first()[0] or 0
    least = cumulative(counts, by, [order], F.col("_c"), "_before")
    shape = {"min": F.col("_before") + 1, "max": F.col("_before") + F.col("_c"), "average": F.col("_before") + (F.col("_c") + 1) / 2}[ties]
    ranks = materialised(least.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate([*by, value])], shape.alias(out), (F.col("_c") * HOT > total).alias("_hot")))
    on = None
    for j, k in enumerate([*by, value]):
        one = F.col(k).eqNullSafe(F.col(f"_k{j}"))
        on = one if on is None else on & one
    keep = [*[F.col(k) for k in df.columns], F.col(out)]
    hot, rare = ranks.filter("_hot").drop("_hot"), ranks.filter("not _hot").drop("_hot")
    many = df.join(F.broadcast(hot), on).select(*keep)
    few = df.join(F.broadcast(hot), on, "left_anti").join(rare.hint("merge"), on).select(*keep)
    return many.unionByName(few)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return correlation(rank(rank(both, x, by, out="_rx"), y, by, out="_ry"), "_rx", "_ry", by).select(*by, "n", F.col("r").alias("rho"))


@F.pandas_udf(DoubleType())
def t_test_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t; for one row an association, never for raw rows."""
    def beta(a, b, x):
        # continued fraction of the incomplete beta function (Lentz)
        if x in (0.0, 1.0):
            return x
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        f = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f / a

    def p(r, n):
        if r is None or r != r or n < 3:
            return None
        left = max(1 - r * r, 0.0)
        return beta((n - 2) / 2, 0.5, left)

    return pd.Series([p(a, b) for a, b in zip(r, n)], dtype="float64")


def permutation_p(df: DataFrame, x: str, y: str, ident: str, permutations: int = 200, seed: int = 0) -> DataFrame:
    """(n, r, p): share of permutations of y whose |r| reaches the observed one.

    Permutation k orders the rows by ``md5(seed|k|id)``, so any engine and any
    partitioning draw the same.  All permutations run at once as groups of one job;
    places come from the hash's first digits and an order within those, and rows
    meet their permuted partner by place: no task gets a whole permutation.
    """
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    base = materialised(rank(base, "id", ties="first", out="own"))
    drawn = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    drawn = drawn.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "k", "id").cast("binary"))).withColumn("part", F.substring("h", 1, 2))
    sizes = drawn.groupBy("k", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select("k", "part", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = drawn.join(sizes.hint("merge"), ["k", "part"])
    drawn = drawn.withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("k", "part").orderBy("h", "id")))
    pairs = drawn.select("k", F.col("own").alias("at"), "x").join(drawn.select("k", "at", "y").hint("merge"), ["k", "at"])
    null = correlation(pairs, "x", "y", ["k"]).select("k", F.col("r").alias("rk"))
    seen = correlation(base, "x", "y").select("n", "r")
    # one row, so it is broadcast
    return null.crossJoin(F.broadcast(seen)).groupBy("n", "r").agg(F.avg((F.abs("rk") >= F.abs("r") - 1e-12).cast("double")).alias("p"))


MOST_HELD = 1 << 20  # values of y that are shipped to tasks
MODULUS = (1 << 31) - 1


def _round(t, k, r: int, seed: int):
    """A whole number below 2^31 from another one; plain arithmetic, so any engine gives the same."""
    h = (t * 40503 + k * 65599 + r * 7919 + seed * 131 + 1) % MODULUS
    h = (h * h + 12345) % MODULUS
    return (h * 69621) % MODULUS


def _partner(i, k, rows: int, columns: int, seed: int):
    """A bijection of 0 to ``rows * columns - 1`` for each k: four rounds, each moving one coordinate by a hash of the other."""
    a, b = i // columns, i % columns
    for r in (1, 3):
        a = (a + _round(b, k, r, seed)) % rows
        b = (b + _round(a, k, r + 1, seed)) % columns
    return a * columns + b


def keyed_permutation(i, k, n: int, seed: int = 0):
    """Place of row ``i`` of ``n`` (numpy arrays) in permutation ``k``: what leaves 0 to n - 1 goes on until it is back."""
    rows = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    columns = -(-n // rows) or 1
    at = _partner(i, k, rows, columns, seed)
    while (out := at >= n).any():
        at = np.where(out, _partner(at, k, rows, columns, seed), at)
    return at


def permutation_test(df: DataFrame, x: str, y: str, ident: str, permutations: int = 200, seed: int = 0) -> DataFrame:
    """(n, r, p): share of permutations of y whose |r| reaches the observed one, by a keyed bijection of places.

    Rows are numbered by ``ident`` once.  A row's partner in each permutation is arithmetic, so
    nothing is sorted or drawn for a permutation.  Up to ``MOST_HELD`` values of y are shipped,
    and each task sums its rows for all permutations; beyond, rows meet their partners by place.
    Means and spreads are the same for all permutations: only products are summed.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = both.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")).first()
    n = m["n"]
    seen = correlation(both, "x", "y").select("n", "r")
    if n < 3 or not m["sx"] or not m["sy"]:
        return seen.withColumn("p", F.lit(None).cast("double"))
    base = rank(both, "id", ties="first", out="at").select((F.col("at") - 1).cast("long").alias("at"), (F.col("x") - m["mx"]).alias("x"), (F.col("y") - m["my"]).alias("y"))
    base = materialised(base)
    ks = np.arange(1, permutations + 1, dtype=np.int64)
    held = None
    if n <= MOST_HELD:
        held = np.empty(n)
        rows = base.select("at", "y").toPandas()
        held[rows["at"].to_numpy()] = rows["y"].to_numpy()

    def sums(batches):
        total = np.zeros(permutations)
        for batch in batches:
            at, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in range(0, len(at), 4096):
                to = keyed_permutation(at[s : s + 4096, None], ks[None, :], n, seed)
                total += v[s : s + 4096] @ held[to]
        yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(total)], ["k", "s"])

    def places(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                at, v = batch.column(0).to_numpy()[s : s + 1024], batch.column(1).to_numpy()[s : s + 1024]
                to = keyed_permutation(at[:, None], ks[None, :], n, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ks, len(at))), pa.array(to.ravel()), pa.array(np.repeat(v, permutations))], ["k", "at", "x"])

    if held is not None:
        part = base.select("at", "x").mapInArrow(sums, "k long, s double")
    else:
        part = base.select("at", "x").mapInArrow(places, "k long, at long, x double").join(base.select("at", "y").hint("merge"), "at").select("k", (F.col("x") * F.col("y")).alias("s"))
    null = part.groupBy("k").agg((F.sum("s") / F.lit((n - 1) * m["sx"] * m["sy"])).alias("rk"))
    # one row, so it is broadcast
    return null.crossJoin(F.broadcast(seen)).groupBy("n", "r").agg(F.avg((F.abs("rk") >= F.abs("r") - 1e-12).cast("double")).alias("p"))


def adjusted_slope(df: DataFrame, x: str, y: str, covariate: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope of y on x with the covariate held, from second moments of one pass."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(covariate).isNotNull())
    c = {f"{a}{b}": F.covar_samp(p, q).alias(f"_{a}{b}") for (a, p), (b, q) in [(("x", x), ("y", y)), (("x", x), ("z", covariate)), (("z", covariate), ("y", y)), (("x", x), ("x", x)), (("z", covariate), ("z", covariate))]}
    m = both.groupBy(*by).agg(F.count("*").alias("n"), *c.values())
    det = F.col("_xx") * F.col("_zz") - F.col("_xz") * F.col("_xz")
    top = F.col("_xy") * F.col("_zz") - F.col("_xz") * F.col("_zy")
    return m.select(*by, "n", F.when(det > 0, F.try_divide(top, det)).alias("slope"))


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal bins from minimum to maximum; the maximum is in the last bin.

    Bounds come from one aggregation (a row a group), which the values then meet.
    """
    v = df.filter(F.col(value).isNotNull())
    bounds = v.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    v = v.select(*by, F.col(value).alias("v"))
    v = v.join(bounds, list(by)) if by else v.crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return v.groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min((F.col("lo") + at * width)).alias("bin_lo"))


def profile(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum; NULLs in ``value`` do not count.

    Quartiles are the values at their places among the group's distinct values with
    counts, see ``cumulative``: no task holds the values of a group.
    """
    by = list(by)
    m = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    m = materialised(m)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    places = cumulative(counts, by, [F.col("_v").asc()], F.col("_c"), "_before")
    own = m.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("n").alias("_total"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    places = places.join(own.hint("merge"), same) if by else places.crossJoin(F.broadcast(own))  # one row
    parts = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = q * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            parts.append(F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), F.col("_v").cast("double"))).alias(f"_{name}{side}"))
    found = places.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(*parts)
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    out = m.join(found.hint("merge"), same, "left") if by else m.crossJoin(F.broadcast(found))  # one row each
    quartile = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        at = q * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}lo"), F.col(f"_{name}hi")
        quartile.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return out.select(*by, "n", "mean", "sd", "min", *quartile, "max")


def shares(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of each label, by a window over the small count table."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return c.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def contrast(df: DataFrame, is_core: Column, is_hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Fraction of hits among core and surface rows."""
    return df.groupBy(*by, is_core.alias("is_core")).agg(F.count("*").alias("n"), F.avg(is_hit.cast("double")).alias("fraction"))
