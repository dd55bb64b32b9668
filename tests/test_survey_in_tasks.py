"""Draws by arrays, and contacts that are looked at where they are found, against plain code."""

import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions import digest
from lodestone.operators import geometry
from lodestone.plans import registry


def drawn(k, i, j):
    return int(hashlib.md5(f"{k}|{i}|{j}".encode()).hexdigest()[:8], 16) / 4294967296.0


@pytest.mark.parametrize("replicates, at_once", [(1, 4096), (21, 7), (112, 64)])
def test_draws_equal_md5(monkeypatch, replicates, at_once):
    monkeypatch.setattr(digest, "AT_ONCE", at_once)
    numbers = np.array([0, 7, -7, 10, 99, 100, 51281, 615384, 10**9, -(10**17), (1 << 63) - 1, -(1 << 63)])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(numbers)), np.arange(len(numbers))))
    got = digest.draws(replicates, i, j, *digest.decimals(numbers))
    assert got.tolist() == [[drawn(k, numbers[a], numbers[b]) for a, b in zip(i, j)] for k in range(replicates)]


def test_draws_cost_less_than_one_by_one():
    numbers = np.arange(100_000, 103_000)
    i, j = np.arange(20_000) % 3000, np.arange(20_000) * 7 % 3000
    texts = digest.decimals(numbers)
    digest.draws(21, i, j, *texts)
    start = time.perf_counter()
    digest.draws(21, i, j, *texts)
    at_once = time.perf_counter() - start
    start = time.perf_counter()
    for k in range(21):
        for a, b in zip(numbers[i].tolist(), numbers[j].tolist()):
            drawn(k, a, b)
    assert at_once < 0.6 * (time.perf_counter() - start)


def cloud(seed):
    """Points of two structures around 0: dense and lone ones, on faces of cubes, at one place, without a place."""
    draw = random.Random(seed)
    out = [(s, n, *(draw.gauss(0, 0.12) for _ in range(3))) for s in (3, 4) for n in range(220)]
    out += [(3, 300 + n, n * 0.1 - 0.5, 0.0, -0.1) for n in range(12)] + [(3, 400 + n, 0.05, 0.05, 0.05) for n in range(9)]
    return out + [(3, -5, 40.0, 40.0, 40.0), (3, -15, 40.05, 40.0, 40.0), (3, 500, math.nan, 0.0, 0.0), (3, 501, math.inf, 0.0, 0.0), (None, 502, 0.0, 0.0, 0.0), (None, 510, 0.0, 0.0, 0.0), (3, 503, None, 0.0, 0.0)]


@pytest.mark.parametrize("work, at_once", [(1 << 25, 1 << 18), (3000, 50)])
def test_contacts_in_tasks_equal_all_pairs(spark, monkeypatch, work, at_once):
    monkeypatch.setattr(geometry, "BLOCK_WORK", work)
    monkeypatch.setattr(geometry, "CANDIDATES", at_once)
    points = cloud(1)
    want = sorted((p[0], min(p[1], q[1]), max(p[1], q[1])) for n, p in enumerate(points) for q in points[:n] if p[0] is not None and p[0] == q[0] and None not in (p[2], q[2]) and abs(p[1] - q[1]) >= 4 and math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) <= 0.1)

    def run(table, pairs):
        key, i = table.column("structure_id").to_numpy(), table.column("i").to_numpy()
        for a, b, _ in pairs:
            assert (key[a] == key[b]).all()
            yield pa.table([key[a], i[a], i[b]], names=["structure_id", "resi", "resj"])

    df = spark.createDataFrame(points, "structure_id int, resi long, x double, y double, z double").repartition(3)
    got = geometry.at_contacts(df, run, "structure_id int, resi long, resj long", 0.1)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 1000


def test_survey_of_parts_equals_sql(compare, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK_WORK", 100)
    monkeypatch.setattr(geometry, "CANDIDATES", 64)
    assert compare(registry.QUERIES["ensemble_survey"], registry.ORACLE["ensemble_survey"])


def test_tasks_follow_pairs_and_not_bytes(spark, monkeypatch):
    """A few kilobytes of dense points go to as many tasks as their pairs ask for."""
    monkeypatch.setattr(geometry, "BLOCK_WORK", 5000)
    monkeypatch.setattr(geometry, "TASK_WORK", 5000)
    df = spark.createDataFrame([(1, n, n * 0.0001, 0.0, 0.0) for n in range(400)], "structure_id int, resi long, x double, y double, z double")
    count = lambda table, pairs: [pa.table([[sum(len(a) for a, _, _ in pairs)]], names=["n"])]
    found = [r.n for r in geometry.at_contacts(df, count, "n long", 0.1).collect()]
    assert sum(found) == sum(range(397)) and len(found) > 15
