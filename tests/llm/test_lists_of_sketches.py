"""op12: rows of lists that may link, against all pairs one by one."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodestone.llm import bottom_k  # noqa: E402

SHARE = 80


def drawn(rows, seed, least, most, kinds):
    """(list, class, component, size, sketch, firsts): sets of ``kinds`` families, each changed in places."""
    draw = np.random.default_rng(seed)
    base = [draw.choice(1 << 31, draw.integers(least, most), replace=False) for _ in range(kinds)]
    out = []
    for c in range(rows):
        s = base[draw.integers(kinds)].copy()
        change = draw.random(len(s)) < draw.choice([0.02, 0.1, 0.2, 0.3])
        s[change] = draw.integers(0, 1 << 31, change.sum())
        s = np.unique(s)
        out.append((c, int(draw.integers(rows)), len(s), s[: bottom_k.SKETCH].tolist(), sorted(draw.integers(0, 40, draw.integers(0, 5)).tolist())))
    return out


def may_link(block, x, y):
    n, m = x[2], y[2]
    if x[1] == y[1] or 100 * min(n, m) < SHARE * max(n, m) or any(b < block for b in set(x[4]) & set(y[4])):
        return False
    both, union = set(x[3]) & set(y[3]), sorted({*x[3], *y[3]})
    if max(n, m) <= bottom_k.SKETCH:
        return (100 + SHARE) * len(both) >= SHARE * (n + m)
    among = sum(v <= union[: bottom_k.SKETCH][-1] for v in both)
    return among * bottom_k.SKETCH >= bottom_k.SURE * min(bottom_k.SKETCH, max(n, m))


def as_table(lists):
    rows = [(b, *r) for b, held in lists for r in held]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "cls", "component", "n", "values", "firsts"])


@pytest.mark.parametrize("few, step", [(16, 256), (2, 7)])
def test_live_rows_equal_all_pairs(monkeypatch, few, step):
    monkeypatch.setattr(bottom_k, "FEW", few)
    monkeypatch.setattr(bottom_k, "STEP", step)
    monkeypatch.setattr(bottom_k, "PAIRS", 50)
    draw = np.random.default_rng(5)
    lists = [(b, drawn(int(draw.integers(2, 30)), b, *[(3, 30, 3), (30, 110, 4), (60, 70, 3), (200, 400, 5)][b % 4])) for b in range(10, 50)]
    want = [any(may_link(b, x, y) for y in held if y is not x) for b, held in lists for x in held]
    assert 100 < sum(want) < len(want) - 100
    assert bottom_k.alive(as_table(lists), SHARE).tolist() == want


def test_a_long_list_estimates_few_of_its_pairs(monkeypatch):
    """1,500 classes that one list holds, 1.1 million pairs; formerly each was estimated."""
    draw = np.random.default_rng(3)
    held = [(c, c, 300, np.unique(draw.integers(0, 1 << 31, 300))[: bottom_k.SKETCH].tolist(), []) for c in range(1500)]
    held[700] = (700, 700, *held[20][2:])
    seen, real = [], bottom_k.estimate
    monkeypatch.setattr(bottom_k, "estimate", lambda n, *a: seen.append(len(n)) or real(n, *a))
    assert np.flatnonzero(bottom_k.alive(as_table([(100, held)]), SHARE)).tolist() == [20, 700]
    assert 0 < sum(seen) < 1500


def test_lists_across_batches_stay_whole():
    block = np.sort(np.random.default_rng(1).integers(0, 40, 300))
    for size in (1, 7, 300):
        got = [t.column("block").to_pylist() for t in bottom_k.whole_blocks(pa.table([pa.array(block), pa.array(block)], names=["block", "cls"]).to_batches(max_chunksize=size))]
        assert [b for t in got for b in t] == block.tolist()
        assert all(x[-1] < y[0] for x, y in zip(got, got[1:]))


def test_short_sets_hand_in_the_pairs_that_a_link_needs(spark):
    """Of 41 values 17 pairs, formerly 40; sets that link always share one of these."""
    draw = np.random.default_rng(2)
    sketch = [sorted(draw.choice(1 << 40, 41, replace=False).tolist())] * 2
    classes = spark.createDataFrame([(c, len(s), s) for c, s in enumerate(sketch)], "cls long, n long, sketch array<long>")
    assert bottom_k.inverted(classes, SHARE).count() == 2 * 17
    for share in (30, 60, 80, 95):
        for n in range(2, 60):
            need = (n * (100 - share) * max(2 * share, 100)) // (100 * share) + 1
            broken = max(2 * x + y for y in range(4 * n) for x in range(n) if (n - x) * 100 >= share * (n + y))
            assert broken < need


def test_distinct_values_in_order():
    from lodestone.llm.common import distinct

    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 500):
        h = draw.integers(0, 300, n).astype(np.uint64) << np.uint64(55)
        assert distinct(h).tolist() == sorted(set(h.tolist()))


def test_beyond_the_broadcast_only_wanted_texts_move(spark, monkeypatch):
    """Two near copies among 300 texts of their own: the same edge, and the text of no other document goes on."""
    from pyspark.sql import functions as F

    from lodestone.llm import ngram_join

    base = [f"v{k}" for k in range(80)]
    rows = [(n, " ".join(f"w{n}x{k}" for k in range(80))) for n in range(300)] + [(300, " ".join(base)), (301, " ".join([*base[:-1], "u"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = docs.filter("doc_id >= 300").select(F.col("doc_id").alias("cls"), F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("text_hash"))
    members = of.select("cls", F.col("cls").alias("component"), F.lit(7).cast("long").alias("block"))
    moved = []
    for few, hashes in ((100, 100), (1, 0), (1, 100)):
        monkeypatch.setattr(ngram_join, "FEW_HASHES", hashes)
        out = ngram_join.joined_blocks(docs, of, members, 2, SHARE, [], few, bottom_k.forest)
        assert [tuple(r) for r in out.collect()] == [(301, 300)]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        moved.append("LeftSemi" in plan)
    assert moved == [False, False, True]


def test_tasks_of_whole_sets_follow_members(spark, monkeypatch):
    """60 blocks of two short texts are a few kilobytes, which adaptive plans put into one or two tasks."""
    from pyspark.sql import functions as F

    from lodestone.llm import ngram_join

    docs = spark.createDataFrame([(n, f"a{n // 2} b c d e f g h i j k l" + " m" * (n % 2)) for n in range(120)], "doc_id long, text string")
    of = docs.select(F.col("doc_id").alias("cls"), F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("text_hash"))
    members = of.select("cls", F.col("cls").alias("component"), F.floor(F.col("cls") / 2).alias("block"))
    monkeypatch.setattr(ngram_join, "TASK_MEMBERS", 4)
    out = ngram_join.joined_blocks(docs, of, members, 2, SHARE, [], 1000, bottom_k.forest).withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert sorted((r.a, r.b) for r in rows) == [(n + 1, n) for n in range(0, 120, 2)]
    assert len({r.task for r in rows}) > 10
