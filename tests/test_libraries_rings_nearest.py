"""Large record files in byte ranges, rings of graphs, nearest targets: against whole reading, search and brute force."""

import math

import numpy as np
import pytest

from lodestone.operators import geometry, graph
from lodestone.sources import molecules, text

from test_queries import smallest_rings


def sdf(k, title, n, newline):
    rows = [title, "  made", "", f"{n:3d}{n - 1:3d}  0  0  0  0            999 V2000"]
    rows += [f"{k + j:10.4f}{j:10.4f}{0:10.4f} {'CNO'[j % 3]:<3} 0  0" for j in range(n)]
    rows += [f"{j + 1:3d}{j + 2:3d}{1 + j % 4:3d}  0" for j in range(n - 1)]
    return newline.join([*rows, f"M  CHG  1{1:4d}{-1 if k % 2 else 2:4d}", "M  END", "> <note>", "cost $$$$ here", "", "$$$$", ""])


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_library_in_ranges_equals_whole_reading(spark, tmp_path, small_ranges):
    """Blank titles, both line ends, an empty record, a missing last mark, two files."""
    for name, newline in (("unix", "\n"), ("dos", "\r\n")):
        one = [sdf(k, "" if k % 3 else f"T{k}", 2 + k % 5, newline) for k in range(60)]
        body = "".join(one[:30]) + "$$$$" + newline + "".join(one[30:])
        (tmp_path / f"{name}.sdf").write_bytes((body[: -len("$$$$" + newline)] if name == "dos" else body).encode())
    library = molecules.sdf_library(spark, str(tmp_path))
    assert library.rdd.getNumPartitions() > 10
    whole = text.lines(spark, str(tmp_path))
    assert rows(molecules.library_atoms(library).drop("title")) == rows(molecules.sdf_atoms(whole))
    assert rows(molecules.library_bonds(library).drop("title")) == rows(molecules.sdf_bonds(whole))
    assert rows(molecules.library_charges(library).drop("title")) == rows(molecules.formal_charges(whole))
    got = {(r.structure_id, r.mol_no): r.title for r in library.collect()}
    assert sorted(n for s, n in got if s == "unix") == [*range(1, 31), *range(32, 62)] and got["unix", 35] == "T33" and got["dos", 2] == ""


def test_mol2_library_in_ranges_equals_whole_reading(spark, tmp_path, small_ranges):
    one = lambda k: f"# made\n@<TRIPOS>MOLECULE\nM{k}\n 2 1\nSMALL\n\n@<TRIPOS>ATOM\n 1 C1 {k}.0 0 0 C.3 1 L 0.5\n# between\n 2 N1 0 {k}.5 0 N.ar 1 L -0.5\n@<TRIPOS>BOND\n 1 1 2 ar\n@<TRIPOS>ATOM\n 3 O1 1 1 1 O.2\n"
    (tmp_path / "a.mol2").write_text("".join(map(one, range(80))))
    (tmp_path / "b.mol2").write_text("# nothing\n")
    library = molecules.mol2_library(spark, str(tmp_path))
    assert library.rdd.getNumPartitions() > 5
    whole = text.lines(spark, str(tmp_path))
    assert rows(molecules.library_mol2_atoms(library).drop("title")) == rows(molecules.mol2_atoms(whole))
    assert rows(molecules.library_mol2_bonds(library).drop("title")) == rows(molecules.mol2_bonds(whole))


def test_fasta_entries_are_numbered_by_file(spark, tmp_path, small_ranges):
    (tmp_path / "a.fa").write_text("".join(f">h{k} x\nAC{'G' * k}\n TT \n" for k in range(100)))
    (tmp_path / "b.fa").write_text("; before\n>one\nAA\n>two\n")
    got = {(r.structure_id, r.entry): (r.header, r.sequence) for r in text.fasta_records(spark, str(tmp_path)).collect()}
    assert got == {("a", k + 1): (f"h{k} x", "AC" + "G" * k + "TT") for k in range(100)} | {("b", 1): ("one", "AA"), ("b", 2): ("two", "")}


def test_rings_of_random_graphs_equal_search(spark):
    """Dense blobs joined by bridges and long chains, tails, repeated and self bonds."""
    draw = np.random.default_rng(4)
    bonds = [(int(a), int(b)) for a, b in draw.integers(0, 40, (150, 2))] + [(int(a), int(b)) for a, b in draw.integers(100, 140, (60, 2))]
    bonds += [(3, 300), (300, 301), (301, 105), (7, 400), (400, 401)]
    bonds += [(500 + k, 500 + (k + 1) % 23) for k in range(23)] + [(500, 1), (600, 601)]
    df = spark.createDataFrame([("g", a, b) for a, b in bonds] + [("h", 1, 2), ("h", 2, 3), ("h", 3, 1)], "mol_id string, a1 int, a2 int")
    got = {(r.mol_id, r.a1, r.a2): r.ring_size for r in graph.ring_sizes(df).collect()}
    want = {("g", *k): v for k, v in smallest_rings([x for x in bonds if x[0] != x[1]]).items()} | {("h", a, b): 3 for a, b in [(1, 2), (2, 3), (1, 3)]} | {("g", a, a): None for a, b in bonds if a == b}
    assert got == want and {3, 4, 23, None} <= set(got.values())


def test_nearest_targets_equal_brute_force(spark, monkeypatch):
    """Far dense clusters, coincident points, points without coordinates, one key with most rows."""
    draw = np.random.default_rng(0)
    n = 900
    a, b = draw.normal(0, 1, (n, 3)), draw.normal(0, 1, (n, 3))
    a[:200], b[:400], b[400:450] = draw.normal(50, 0.1, (200, 3)), draw.normal(-30, 0.01, (400, 3)), 1.5
    key = lambda i: "s" if i % 5 else "t"
    p = spark.createDataFrame([(key(i), i // 2, *map(float, x)) for i, x in enumerate(a)] + [("s", 9999, None, 0.0, 0.0), ("u", 1, 0.0, 0.0, 0.0)], "structure_id string, copy long, x double, y double, z double")
    t = spark.createDataFrame([(key(i), i % 3, *map(float, x)) for i, x in enumerate(b)] + [("s", 7, 0.0, None, 0.0)], "structure_id string, target long, x double, y double, z double")
    want = {}
    for i, x in enumerate(a):
        for j in range(3):
            far = min(math.dist(x, y) for m, y in enumerate(b) if key(m) == key(i) and m % 3 == j)
            want[key(i), i // 2, j] = min(want.get((key(i), i // 2, j), math.inf), far)
    for leaf in (64, 2):
        monkeypatch.setattr(geometry, "LEAF", leaf)
        got = {(r.structure_id, r.copy, r.target): r.dist for r in geometry.min_distance(p, t).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_libraries_of_several_files_are_numbered_on(spark, compare, monkeypatch):
    """Files of a few molecules each, with numbers that go on over the files of a library: no task holds a library."""
    from conftest import SF
    from lodestone.plans import files, registry

    monkeypatch.setattr(files, "PART_ITEMS", 100, raising=False)
    for name in ("library_atoms", "library_mol2_bonds"):
        compare(registry.QUERIES[name], registry.ORACLE[name])
    path = files.written(spark, SF, files.sdf_arrays)
    assert spark.read.text(path).select("lib", "part").distinct().count() > 20


def test_closed_contacts_equal_brute_force(spark, monkeypatch):
    """Pairs, rings of three and what the forest joins, also where a cube is dealt in parts and looked at in stretches."""
    import itertools

    from pyspark.sql import functions as F

    from lodestone.operators import geometry

    pts = [(r.s, r.i, r.x, r.y, r.z) for r in spark.range(160).selectExpr("cast(id % 2 as string) as s", "id as i", "rand(1) * 0.6 as x", "rand(2) * 0.6 as y", "rand(3) * 0.6 as z").collect()]
    d = spark.createDataFrame(pts, "structure_id string, resi long, x double, y double, z double").withColumn("w", F.col("x"))
    near = {(a[1], b[1]) for a, b in itertools.combinations(pts, 2) if a[0] == b[0] and b[1] - a[1] >= 4 and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:])) ** 0.5 <= 0.2}
    beside = {k: {y if x == k else x for x, y in near if k in (x, y)} for _, k, *_ in pts}
    want = {(a, b): bool(beside[a] & beside[b]) for a, b in near}
    assert 0 < sum(want.values()) < len(want)

    def parts(edges):
        label = {p[1]: p[1] for p in pts}
        for a, b in edges:
            label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
        return label

    for part, pairs in ((2048, 1 << 21), (3, 50)):
        monkeypatch.setattr(geometry, "CUBE_PART", part)
        monkeypatch.setattr(geometry, "CUBE_PAIRS", pairs)
        got = geometry.closed_contacts(d, 0.2, keep=["w"]).collect()
        assert len(got) == len(want) and {(r.resi, r.resj): r.three for r in got} == want
        x = {p[1]: p[2] for p in pts}
        assert all((r.l_w, r.r_w) == (x[r.resi], x[r.resj]) for r in got)
        assert all(r.three for r in got if r.tree)
        assert parts((r.resi, r.resj) for r in got if r.tree) == parts(p for p, three in want.items() if three)


def test_open_rings_look_for_points_where_bonds_are_many(spark, monkeypatch):
    """Without a table of bonds: rings as by search over all bonds, and nothing as large as the bonds is moved."""
    from lodestone.operators import geometry, graph
    from lodestone.plans import graphs

    d = spark.range(80).selectExpr("0 as structure_id", "id as resi", "rand(4) * 0.5 as x", "rand(5) * 0.5 as y", "rand(6) * 0.5 as z")
    c = geometry.closed_contacts(d, 0.13).withColumnsRenamed({"structure_id": "mol_id", "resi": "a1", "resj": "a2"})
    want = {(r.a1, r.a2): r.ring_size for r in graph.ring_sizes(c.select("mol_id", "a1", "a2")).collect()}
    monkeypatch.setattr(graphs, "FEW_BONDS", 0)
    got = {(r.a1, r.a2): r.ring_size for r in graphs.open_rings(c, d, 0.13).collect()}
    assert {p for p, n in want.items() if n is None or n > 3} == set(got) and all(want[p] == n for p, n in got.items())
