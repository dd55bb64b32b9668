import pytest

from lodestone.plans import registry

from conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, compare):
    assert compare(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_ring_bonds_equal_search(spark):
    """Each bond's smallest ring, by breadth-first search in Python."""
    from collections import deque

    from lodestone.operators.graph import ring_sizes

    bonds = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (7, 8)]
    df = spark.createDataFrame([(9, a, b) for a, b in bonds], "mol_id int, a1 int, a2 int")
    got = {(r.a1, r.a2): r.ring_size for r in ring_sizes(df).collect()}
    near = {}
    for a, b in bonds:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in bonds:
        a, b = min(a, b), max(a, b)
        seen, queue = {a: 1}, deque([a])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if v not in seen and not (u == a and v == b):
                    seen[v] = seen[u] + 1
                    queue.append(v)
        assert got[(a, b)] == seen.get(b), (a, b)


def smallest_rings(bonds):
    """(a1, a2) -> atoms of the smallest ring through the bond, None if in none: breadth-first search in Python."""
    from collections import deque

    near, out = {}, {}
    for a, b in bonds:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in bonds:
        a, b = min(a, b), max(a, b)
        seen, queue = {a: 1}, deque([a])
        while queue and b not in seen:
            u = queue.popleft()
            for v in near[u]:
                if v not in seen and not (u == a and v == b):
                    seen[v] = seen[u] + 1
                    queue.append(v)
        out[a, b] = seen.get(b)
    return out


def test_ring_bonds_query_finds_large_rings(spark, monkeypatch):
    """A ring of 15 points beside each other in space, with a tail and a small ring."""
    import math

    from lodestone.plans import graphs

    far = 0.06  # of neighbours; numbers differ by 4 at least, as contacts need
    r = far / (2 * math.sin(math.pi / 15))
    pts = [("s", 10 * k, r * math.cos(2 * math.pi * k / 15), r * math.sin(2 * math.pi * k / 15), 0.0) for k in range(15)]
    pts += [("s", 200, r + 0.06, 0.0, 0.0), ("s", 210, r + 0.12, 0.0, 0.0), ("s", 220, r + 0.09, 0.05, 0.0)]
    d = spark.createDataFrame(pts, "structure_id string, resi long, x double, y double, z double")
    monkeypatch.setattr(graphs, "points", lambda *_: d)
    got = {(x.a1, x.a2): x.ring_size for x in registry.QUERIES["ring_bonds"](spark, "").collect()}
    assert sorted(got.values(), key=str) == [15] * 15 + [3] * 3 + [None]
    assert got == smallest_rings(list(got))


def test_ring_bonds_query_equals_search(spark):
    got = {(x.mol_id, x.a1, x.a2): x.ring_size for x in registry.QUERIES["ring_bonds"](spark, SF).collect()}
    want = smallest_rings([((m, a), (m, b)) for m, a, b in got])
    assert got == {(a[0], a[1], b[1]): n for (a, b), n in want.items()}


def test_rings_reach_types_rotors_and_rigid_groups(spark, monkeypatch):
    """A five-ring O1 C2=C3 C4=C5 with a tail C6 C7 C8 at C2: ring bonds do not rotate, its oxygen is Oaro."""
    from lodestone.plans import molecules

    atoms = spark.createDataFrame([("m", k, "O" if k == 1 else "C", float(k), 0.0, 0.0, None) for k in range(1, 9)], "mol_id string, atom_id long, elem string, x double, y double, z double, partial_charge double")
    bonds = spark.createDataFrame([("m", *b) for b in [(1, 2, 1), (2, 3, 2), (3, 4, 1), (4, 5, 2), (1, 5, 1), (2, 6, 1), (6, 7, 1), (7, 8, 1)]], "mol_id string, a1 long, a2 long, bond_order int")
    monkeypatch.setattr(molecules, "atoms_of", lambda *_: atoms)
    monkeypatch.setattr(molecules, "bonds_of", lambda *_: bonds)
    run = lambda name: registry.QUERIES[name](spark, "").collect()
    assert {(r.a1, r.a2) for r in run("rotatable_bonds_with_rings") if r.can_rotate} == {(2, 6), (6, 7)}
    assert {r.atom_type for r in run("atom_types_with_rings") if r.elem == "O"} == {"Oaro"}
    assert {r.atom_id: r.rigid_id for r in run("rigid_groups_with_rings")} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 3, 8: 3}


def test_rotors_with_rings_equal_search(spark):
    """Those of the query without rings that a search in Python finds in none."""
    got = {(r.mol_id, r.a1, r.a2): r for r in registry.QUERIES["rotatable_bonds_with_rings"](spark, SF).collect()}
    ring = smallest_rings([((m, a), (m, b)) for m, a, b in got])
    plain = registry.QUERIES["rotatable_bonds"](spark, SF).collect()
    assert len(plain) == len(got)
    for r in plain:
        n, x = ring[(r.mol_id, r.a1), (r.mol_id, r.a2)], got[r.mol_id, r.a1, r.a2]
        assert (x.ring_size, x.can_rotate, x.is_proton_rotor) == (n, r.can_rotate and n is None, r.is_proton_rotor and n is None)


def test_flagship(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_grid_plan_has_no_nested_loop(spark):
    plan = registry.QUERIES["contacts_grid"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def shuffled(spark, figure="shuffleWriteBytes"):
    """Bytes that all stages so far wrote to shuffles, or the sum of another figure."""
    jvm, arr = spark._jvm, spark._jvm.java.util.ArrayList
    stages = spark._jsc.sc().statusStore().stageList(arr(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), arr())
    return sum(getattr(stages.apply(k), figure)() for k in range(stages.size()))


def dense_points(spark, path, n):
    """``n`` points of one structure, within a cube of 0.4."""
    rows = spark.range(n).selectExpr("id AS vec_id", "0 AS label", "array(rand(1) * 0.4, rand(2) * 0.4, rand(3) * 0.4) AS embedding")
    rows.coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_survey_moves_points_and_not_contacts(spark, tmp_path):
    """Twice the density gives four times the contacts, but twice the rows to move."""
    moved = []
    for n in (600, 1200):
        path, before = dense_points(spark, str(tmp_path / str(n)), n), shuffled(spark)
        registry.QUERIES["ensemble_survey"](spark, path).collect()
        moved.append(shuffled(spark) - before)
    assert moved[1] < 2.8 * moved[0]


def test_areas_do_not_compare_dense_points(spark, tmp_path):
    """Four times the density gives sixteen times the neighbours, but not the work."""
    used = []
    for k, n in enumerate((1000, 1000, 4000)):  # the first run is for code that is compiled on the way
        path, before = dense_points(spark, str(tmp_path / str(k)), n), shuffled(spark, "executorCpuTime")
        registry.QUERIES["sasa_points"](spark, path).collect()
        used.append(shuffled(spark, "executorCpuTime") - before)
    assert used[2] < 6 * used[1]


def test_areas_of_several_radii(spark):
    """Shares of uncovered sphere points against brute force, with a lone atom and two at one place."""
    import math
    import random

    from lodestone.operators.geometry import accessible_area

    draw = random.Random(3)
    atoms = [(1, k, k % 5, draw.random() * 3, draw.random() * 3, draw.random() * 3, draw.choice([0.3, 0.6, 1.2])) for k in range(60)]
    atoms += [(1, 60, 5, *atoms[0][3:6], 0.6), (1, 61, 6, 50.0, 50.0, 50.0, 0.3), (2, 0, 0, 1.0, 1.0, 1.0, 0.6)]
    df = spark.createDataFrame(atoms, "structure_id int, atom_id int, resi int, x double, y double, z double, radius double")
    n, want = 24, {}
    for s, i, g, *at, radius in atoms:
        r, free = radius + 0.2, 0
        for k in range(n):
            z = 1 - (2 * k + 1) / n
            q, phi = math.sqrt(1 - z * z), k * 2.399963229728653
            p = (at[0] + r * q * math.cos(phi), at[1] + r * q * math.sin(phi), at[2] + r * z)
            free += not any(t == s and j != i and sum((u - v) ** 2 for u, v in zip(p, o)) < (other + 0.2) ** 2 for t, j, _, *o, other in atoms)
        want[s, g] = want.get((s, g), 0.0) + free / n * 4 * math.pi * r * r
    got = {(r.structure_id, r.resi): r.area for r in accessible_area(df, probe=0.2, n_points=n).collect()}
    assert got == pytest.approx(want)


def test_spearman_ties_do_not_depend_on_the_order_of_sums(spark, duck, tmp_path):
    """Six copies of each part's line items, each in another order: equal indices are ties, here and in the SQL."""
    import random

    import duckdb
    import numpy as np

    draw, items, parts = random.Random(5), [], []
    for part in range(40):
        own = [(line, draw.randrange(1000, 99999) / 100) for line in range(1, 5) for _ in range(7)]
        for copy in range(6):
            key = part + 1000 * copy
            parts.append((key, draw.randrange(1, 51)))
            items += [(key, *x) for x in draw.sample(own, len(own))]
    spark.createDataFrame(items, "l_partkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    index = {}
    for part in range(40):
        of = [[x[2] for x in items if x[0] == part and x[1] == line] for line in range(1, 5)]
        native, *rest = [np.mean(x) for x in of]
        index[part] = round((np.mean(rest) - native) / np.std(rest, ddof=1), 9)

    def ranks(v):
        v = np.array(v)
        return [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]

    want = np.corrcoef(ranks([index[k % 1000] for k, _ in parts]), ranks([y for _, y in parts]))[0, 1]
    assert registry.QUERIES["spearman"](spark, str(tmp_path)).first().rho == pytest.approx(want, abs=2e-6)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.execute(registry.ORACLE["spearman"]).fetchall()[0][1] == pytest.approx(want, abs=2e-6)
