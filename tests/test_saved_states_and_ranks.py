"""States saved as deltas, and ranks and quartiles with values of many rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import geometry, stats
from lodestone.streaming import incremental


def test_killed_run_goes_on_to_the_same_table(spark, tmp_path):
    """A run that fails within a batch, an unfinished folder, a snapshot, lower replicates later."""
    d = spark.createDataFrame([(f"k{i % 3}", r, 1e8 + 1e-3 * ((7 * i + 13 * r) % 11)) for i in range(30) for r in range(9)], "k string, r int, energy double")
    calls = []

    def score(some, fail=()):
        calls.append(tuple(some))
        if set(some) & set(fail):
            return d.filter(F.col("r").isin(*some)).withColumn("energy", F.raise_error(F.lit("killed")).cast("double"))
        return d.filter(F.col("r").isin(*some))

    sink = f"{tmp_path}/saved"
    with pytest.raises(Exception, match="killed"):
        incremental.run_saved(spark, range(2, 9), lambda s: score(s, [6]), sink, ["k"], every=2)
    assert incremental.saved_replicates(spark, sink) == {2, 3, 4, 5}
    calls.clear()
    incremental.run_saved(spark, range(2, 8), score, sink, ["k"], every=2)
    assert calls == [(6, 7)]
    incremental.snapshot(spark, sink, ["k"])
    state = incremental.run_saved(spark, range(9), score, sink, ["k"], every=5)
    assert calls == [(6, 7), (0, 1, 8)]
    got = {r.k: r for r in incremental.from_moments(state).collect()}
    for k in ("k0", "k1", "k2"):
        v = np.array([r.energy for r in d.filter(F.col("k") == k).collect()]) - 1e8
        assert got[k].n == len(v) and math.isclose(got[k].mean - 1e8, v.mean(), rel_tol=1e-4) and math.isclose(got[k].sd, v.std(ddof=1), rel_tol=1e-6)


def test_stream_deltas_add_up(spark, tmp_path):
    d = spark.createDataFrame([(f"k{i % 3}", float(i)) for i in range(60)], "k string, energy double")
    for part in range(3):
        d.filter(F.col("energy") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental.stream_saved(s, f"{tmp_path}/out", f"{tmp_path}/cp", ["k"])
    got = {r.k: (r.n, round(r.mean, 9), round(r.sd, 9)) for r in incremental.from_moments(incremental.saved_state(spark, f"{tmp_path}/out", ["k"])).collect()}
    want = {r.k: (r.n, round(r.m, 9), round(r.s, 9)) for r in d.groupBy("k").agg(F.count("*").alias("n"), F.avg("energy").alias("m"), F.stddev_samp("energy").alias("s")).collect()}
    assert got == want


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_with_a_value_of_a_third_of_all_rows(spark, by):
    draw = np.random.default_rng(3)
    v = [7 if i % 3 == 0 else None if i % 50 == 1 else int(draw.integers(0, 400)) for i in range(3000)]
    g = [("a" if i % 4 else None) for i in range(3000)]
    d = spark.createDataFrame([(i, g[i], x) for i, x in enumerate(v)], "i int, g string, v int")
    groups = {}
    for i in range(3000):
        groups.setdefault(g[i] if by else 0, []).append(i)
    for nulls in ("last", "first", "omit"):
        for descending in (False, True):
            want = {}
            for ids in groups.values():
                real = sorted((v[i] for i in ids if v[i] is not None), reverse=descending)
                n_null = sum(v[i] is None for i in ids)
                first, last, moved = {}, {}, n_null if nulls == "first" else 0
                for k, x in enumerate(real):
                    first.setdefault(x, k + 1), last.update({x: k + 1})
                for i in ids:
                    if v[i] is not None:
                        want[i] = (first[v[i]] + moved, last[v[i]] + moved)
                    elif nulls != "omit":
                        start = 0 if nulls == "first" else len(real)
                        want[i] = (start + 1, start + n_null)
            for ties, shape in (("min", lambda a, b: a), ("max", lambda a, b: b), ("average", lambda a, b: (a + b) / 2)):
                if (descending or nulls == "first") and ties != "min":
                    continue
                got = {r.i: r["rank"] for r in stats.rank(d, "v", by, ties, descending, nulls).collect()}
                assert got == {i: shape(*w) for i, w in want.items()}
    order = {r.i: r["rank"] for r in stats.rank(d, "v", by, "first").collect()}
    for ids in groups.values():
        assert sorted(order[i] for i in ids) == list(range(1, len(ids) + 1))
        real = [i for i in ids if v[i] is not None]
        assert [v[i] for i in sorted(real, key=order.get)] == sorted(v[i] for i in real)


def test_quartiles_equal_numpy(spark):
    draw = np.random.default_rng(8)
    rows = [("a", float(x)) for x in draw.normal(0, 1, 1001)] + [("b", 5.0)] * 700 + [("b", float(k)) for k in range(8)] + [(None, 1.0), (None, 4.0), ("c", None), ("a", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.profile(d, "v", ["g"]).collect()}
    for k in ("a", "b", None):
        v = np.array([x for g, x in rows if g == k and x is not None])
        assert got[k].n == len(v) and np.allclose([got[k].q25, got[k].q50, got[k].q75], np.percentile(v, [25, 50, 75]))
    assert got["c"].n == 0 and got["c"].q50 is None
    v = np.array([x for _, x in rows if x is not None])
    assert np.allclose(tuple(stats.profile(d, "v").first()), (len(v), v.mean(), v.std(ddof=1), v.min(), *np.percentile(v, [25, 50, 75]), v.max()))


def test_contacts_meet_each_pair_once(spark):
    draw = np.random.default_rng(6)
    p = draw.uniform(-2, 2, (150, 3))
    p[:60] = draw.uniform(0, 0.3, (60, 3))  # one full cube
    d = spark.createDataFrame([("s", int(i), *map(float, x)) for i, x in zip(draw.permutation(150), p)], "structure_id string, resi long, x double, y double, z double")
    ids = {r.resi: (r.x, r.y, r.z) for r in d.collect()}
    want = sorted((i, j) for i in ids for j in ids if j - i >= 4 and math.dist(ids[i], ids[j]) <= 0.5)
    got = geometry.contacts(d, 0.5).collect()
    assert sorted((r.resi, r.resj) for r in got) == want and all(math.isclose(r.dist, math.dist(ids[r.resi], ids[r.resj])) for r in got)


def test_keyed_permutations_are_bijections():
    for n in (1, 2, 3, 5, 10, 97, 1000):
        i, k = np.arange(n)[:, None], np.arange(1, 9)[None, :]
        at = stats.keyed_permutation(i, k, n, 3)
        assert (np.sort(at, axis=0) == i).all()
    # any place is as likely: 2,000 draws over 10 places
    at = stats.keyed_permutation(np.zeros((1, 1), np.int64), np.arange(2000)[None, :], 10)
    assert (np.bincount(at.ravel(), minlength=10) > 140).all()


def test_permutation_test_equals_its_definition(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, 80)
    y = 0.25 * x + draw.normal(0, 1, 80)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(99, None, 1.0)], "id int, x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    null = [np.corrcoef(x, y[stats.keyed_permutation(np.arange(80), k, 80, 7)])[0, 1] for k in range(1, 51)]
    want = np.mean(np.abs(null) >= abs(r) - 1e-12)
    for most in (1 << 20, 10):  # shipped, and met by place
        monkeypatch.setattr(stats, "MOST_HELD", most)
        got = stats.permutation_test(d, "x", "y", "id", 50, 7).first()
        assert got.n == 80 and math.isclose(got.r, r, rel_tol=1e-9) and math.isclose(got.p, want)
    assert stats.permutation_test(d.withColumn("y", F.lit(1.0)), "x", "y", "id").first().p is None
