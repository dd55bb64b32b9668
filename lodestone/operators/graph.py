"""Iterative operators on edge tables: components, rings, shortest paths, centres.

Rounds are joins over all graphs at once; each round's table is written to the
shared folder, so lineage stays short and lost executors cost one round.
"""

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.storage import drop_written, materialised


def both_ways(bonds: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    b = bonds.select(*keys, "a1", "a2", *keep)
    return b.unionByName(bonds.select(*keys, F.col("a2").alias("a1"), F.col("a1").alias("a2"), *keep))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), most_rounds: int = 100) -> DataFrame:
    """(keys, node, component): the smallest node of each connected component.

    Labels pass to neighbours and then jump to their label's label, so rounds grow
    with the logarithm of the longest path.
    """
    k = list(keys)
    # written once: else each round would make the edges again
    e = materialised(both_ways(edges, keys).distinct())
    now = materialised(nodes.select(*keys, "node", F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        near = e.join(now.withColumnRenamed("node", "a2").hint("merge"), [*k, "a2"]).groupBy(*keys, F.col("a1").alias("node")).agg(F.min("component").alias("m"))
        low = now.join(near.hint("merge"), [*k, "node"], "left").select(*keys, "node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        up = low.select(*keys, F.col("node").alias("component"), F.col("component").alias("top"))
        new = materialised(low.join(up.hint("merge"), [*k, "component"], "left").select(*keys, "node", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        moved = new.filter("component <> was").isEmpty()
        drop_written(now)
        now = new.drop("was")
        if moved:
            drop_written(e)
            return now
    raise RuntimeError("components did not settle")


def shortest_paths(edges: DataFrame, keys: Sequence[str] = (), sources: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """(keys, source, node, dist) of the least total weight: relaxation until nothing improves."""
    k = list(keys)
    e = both_ways(edges, keys, ["weight"]).groupBy(*keys, "a1", "a2").agg(F.min("weight").alias("weight"))
    e = materialised(e)
    start = (sources if sources is not None else e.select(*keys, F.col("a1").alias("source")).distinct()).select(*keys, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    best = materialised(start)
    front = best
    for _ in range(most_rounds):
        step = front.join(e.hint("merge"), [*[front[c] == e[c] for c in k], front["node"] == e["a1"]]).select(*[front[c] for c in k], "source", F.col("a2").alias("node"), (F.col("dist") + F.col("weight")).alias("new"))
        step = step.groupBy(*keys, "source", "node").agg(F.min("new").alias("new"))
        j = best.join(step.hint("merge"), [*k, "source", "node"], "full")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
        nxt = materialised(j.select(*keys, "source", "node", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")))
        front = nxt.filter("moved").drop("moved")
        drop_written(best)
        best = nxt.drop("moved")
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def triangles(open_: DataFrame, adjacent: DataFrame, keys: Sequence[str], first: int = 4) -> DataFrame:
    """Those of the bonds (keys, a1, a2) that are in a ring of three; written.

    The end with fewer neighbours offers them in batches that grow fourfold, and a bond
    that one closes leaves: in dense graphs most bonds need one small batch.
    ``adjacent`` has (keys, u, v, place, degree), ``place`` from 0 among u's neighbours.
    """
    k = list(keys)
    degree = adjacent.filter("place = 0").select(*k, "u", "degree")
    side = lambda c: degree.withColumnsRenamed({"u": c, "degree": f"d_{c}"}).hint("merge")
    o = open_.join(side("a1"), [*k, "a1"]).join(side("a2"), [*k, "a2"])
    low = F.col("d_a1") <= F.col("d_a2")
    o = materialised(o.select(*k, "a1", "a2", F.when(low, F.col("a1")).otherwise(F.col("a2")).alias("s"), F.when(low, F.col("a2")).otherwise(F.col("a1")).alias("t"), F.least("d_a1", "d_a2").alias("most")))
    closed, start = [], 0
    while not o.isEmpty():
        size = first if not start else 3 * start
        batch = adjacent.filter(F.col("place").between(start, start + size - 1)).select(*k, F.col("u").alias("s"), F.col("v").alias("c"))
        offer = o.join(batch.hint("merge"), [*k, "s"]).filter("c <> t").select(*k, "a1", "a2", "t", "c")
        pairs = adjacent.select(*k, F.col("u").alias("t"), F.col("v").alias("c"))
        hit = materialised(offer.join(pairs.hint("merge"), [*k, "t", "c"], "left_semi").select(*k, "a1", "a2").distinct())
        closed.append(hit)
        start += size
        rest = materialised(o.filter(F.col("most") > start).join(hit.hint("merge"), [*k, "a1", "a2"], "left_anti"))
        drop_written(o)
        o = rest
    drop_written(o)
    out = open_.select(*k, "a1", "a2").limit(0)
    for x in closed:
        out = out.unionByName(x)
    out = materialised(out)
    drop_written(*closed)
    return out


def ring_sizes(bonds: DataFrame, keys: Sequence[str] = ("mol_id",), most_rounds: int = 10_000) -> DataFrame:
    """(keys, a1, a2, ring_size): smallest ring through each bond, of any size; NULL if in none.

    Rings of three are found first, see ``triangles``, and each other bond is searched, see
    ``ring_search``.  Repeated bonds count once, and bonds of an atom to itself are in no ring.
    """
    k = list(keys)
    bond = [*k, "a1", "a2"]
    b = materialised(bonds.select(*keys, F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).distinct())
    real = b.filter("a1 <> a2")
    w = Window.partitionBy(*keys, "u")
    adjacent = both_ways(real, keys).withColumnsRenamed({"a1": "u", "a2": "v"})
    adjacent = materialised(adjacent.withColumns({"place": F.row_number().over(w.orderBy("v")) - 1, "degree": F.count("*").over(w)}))
    three = triangles(real, adjacent, keys)
    near = adjacent.select(*k, F.col("u").alias("node"), "v")
    more = ring_search(real.join(three.hint("merge"), bond, "left_anti"), lambda front: front.join(near.hint("merge"), [*k, "node"]), keys, most_rounds)
    rings = materialised(three.withColumn("ring_size", F.lit(3)).unionByName(more))
    out = materialised(b.join(rings.hint("merge"), bond, "left"))
    drop_written(b, adjacent, three, more, rings)
    return out


def ring_search(rest: DataFrame, near, keys: Sequence[str] = ("mol_id",), most_rounds: int = 10_000) -> DataFrame:
    """(keys, a1, a2, ring_size) of those of the distinct bonds ``rest`` that are in a ring; written.

    Each bond is searched from both of its ends at once, without the bond itself: in each
    round the end that has seen fewer nodes goes on by one bond, over all bonds at once.
    A ring is found where the two last frontiers meet; a bond of which an end finds nothing
    new is in no ring, after work of the smaller side only, so tails and bridges are cheap.
    Frontiers are distinct nodes, not paths; bonds go both ways, so a node that was seen
    is in the last two frontiers of its end.  ``near`` gives rows (keys, node, ...) with
    each partner of the node as ``v``, over all bonds.
    """
    k = list(keys)
    bond = [*k, "a1", "a2"]
    found = []
    ends = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a1").alias("node")), F.struct(F.lit(2).alias("side"), F.col("a2").alias("node"))))
    none = rest.select(*bond, F.lit(0).alias("ring_size")).limit(0)
    state = materialised(rest.withColumn("e", ends).select(*bond, "e.*", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("seen"), F.lit(True).alias("last")))
    for _ in range(most_rounds):
        if state.isEmpty():
            break
        now = state.filter("last")
        turn = now.groupBy(*bond).agg(F.min(F.struct("seen", "side")).alias("m"), F.max(F.when(F.col("side") == 1, F.col("depth"))).alias("d1"), F.max(F.when(F.col("side") == 2, F.col("depth"))).alias("d2"))
        turn = materialised(turn.select(*bond, F.col("m.side").alias("turn"), F.col("m.seen").alias("had"), "d1", "d2"))
        step = near(now.join(turn.hint("merge"), bond).filter("side = turn"))
        itself = ((F.col("node") == F.col("a1")) & (F.col("v") == F.col("a2"))) | ((F.col("node") == F.col("a2")) & (F.col("v") == F.col("a1")))
        step = step.filter(~itself).select(*bond, "side", F.col("v").alias("node")).distinct()
        step = materialised(step.join(state.select(*bond, "side", "node").hint("merge"), [*bond, "side", "node"], "left_anti"))
        met = step.withColumn("side", 3 - F.col("side")).join(now.select(*bond, "side", "node").hint("merge"), [*bond, "side", "node"], "left_semi").select(*bond).distinct()
        met = materialised(met.join(turn.hint("merge"), bond).select(*bond, (F.col("d1") + F.col("d2") + 2).alias("ring_size")))
        found.append(met)
        new = step.groupBy(*bond).agg(F.count("*").alias("n")).join(met.select(*bond).hint("merge"), bond, "left_anti")
        going = materialised(turn.join(new.hint("merge"), bond))
        fresh = step.join(going.hint("merge"), bond).select(*bond, "side", "node", (F.when(F.col("side") == 1, F.col("d1")).otherwise(F.col("d2")) + 1).alias("depth"), (F.col("had") + F.col("n")).alias("seen"), F.lit(True).alias("last"))
        # of the end whose turn it was the last frontier becomes the one before; of the other both stay
        kept = state.join(going.select(*bond, "turn").hint("merge"), bond).filter("side <> turn or last")
        kept = kept.select(*bond, "side", "node", "depth", "seen", (F.col("last") & (F.col("side") != F.col("turn"))).alias("last"))
        nxt = materialised(fresh.unionByName(kept))
        drop_written(state, step, turn, going)
        state = nxt
    else:
        raise RuntimeError("rings did not settle")
    rings = none
    for x in found:
        rings = rings.unionByName(x)
    rings = materialised(rings)
    drop_written(state, *found)
    return rings


PAIRS = 1 << 20  # distances that a task holds at once
GROUP_PARTS = 64  # parts of a rigid group whose nodes are reached on their own


def rigid_paths(across: DataFrame, nodes: DataFrame, sources: DataFrame, keys: Sequence[str] = ("mol_id",), most_rounds: int = 200) -> DataFrame:
    """As ``shortest_paths`` over the edges ``across`` groups and all pairs of a group, as long as their straight distance.

    ``nodes`` has (keys, node, group, x, y, z), each node once; edges are as long as their ends are
    apart.  Pairs are never made: in a round the nodes by which a source enters a group
    give distances to all of the group, and only nodes that came nearer go on over edges.
    """
    k = list(keys)
    e = materialised(both_ways(across, keys, ["weight"]).groupBy(*keys, "a1", "a2").agg(F.min("weight").alias("weight")))
    part = F.pmod(F.xxhash64("node"), F.lit(GROUP_PARTS)).cast("int")
    inside = materialised(nodes.select(*k, "group", part.alias("_part"), "node", "x", "y", "z"))
    at = nodes.select(*k, "node", "group", *[F.col(c).alias(f"e{c}") for c in "xyz"])
    enter = sources.select(*k, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"))
    best = None
    for _ in range(most_rounds):
        by = enter.join(at.hint("merge"), [*k, "node"]).drop("node").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GROUP_PARTS - 1))))
        apart = F.sqrt(sum(((F.col(c) - F.col(f"e{c}")) * (F.col(c) - F.col(f"e{c}")) for c in "xyz"), F.lit(0.0)))
        step = by.join(inside.hint("merge"), [*k, "group", "_part"]).groupBy(*k, "source", "node").agg(F.min(F.col("dist") + F.coalesce(apart, F.when(F.col("dist") == 0, 0.0))).alias("new"))
        if best is None:
            nxt = materialised(step.select(*k, "source", "node", F.col("new").alias("dist"), F.lit(True).alias("moved")))
        else:
            better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
            j = best.join(step.hint("merge"), [*k, "source", "node"], "full")
            nxt = materialised(j.select(*k, "source", "node", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")))
            drop_written(best, enter)
        best = nxt.drop("moved")
        out = nxt.filter("moved").join(e.withColumnRenamed("a1", "node").hint("merge"), [*k, "node"]).groupBy(*k, "source", F.col("a2").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        out = out.join(best.hint("merge"), [*k, "source", "node"], "left").filter(F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
        enter = materialised(out.select(*k, "source", "node", F.col("new").alias("dist")))
        if enter.isEmpty():
            drop_written(e, inside, enter)
            return best
    raise RuntimeError("paths did not settle")


def near_paths(points: DataFrame, cutoff: float, sources: DataFrame, separation: int = 4, keys: Sequence[str] = ("mol_id",), most_rounds: int = 1000) -> DataFrame:
    """As ``shortest_paths`` over all contacts of the points (keys, node, x, y, z), as long as their straight distance.

    Contacts are never made or moved, as they grow with the square of the density: nodes that
    came nearer in a round are sent to the cubes that their contacts may be in, and there give
    each point its least distance.  Cubes are twice the cutoff wide, which
    takes 8 copies on average, and are looked at in eighths.
    """
    k, cell = list(keys), ["_cx", "_cy", "_cz"]
    group, edge, reach = [*k, *cell], 2 * cutoff, cutoff * (1 + 1e-9)
    kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    p = materialised(points.select(*k, F.col("node").cast("long").alias("node"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna(subset=[*k, "x", "y", "z"]))
    spots = p.select(*k, *[F.floor(F.col(c) / edge).alias(f"_c{c}") for c in "xyz"], F.lit(None).cast("long").alias("source"), "node", F.lit(None).cast("double").alias("dist"), *"xyz")

    def offers(t: pa.Table) -> pa.Table:
        source, node, dist = (t.column(c).fill_null(0).to_numpy() for c in ("source", "node", "dist"))
        at = np.stack([t.column(c).to_numpy() for c in "xyz"])
        front = np.asarray(t.column("source").is_valid())
        spot, front = np.flatnonzero(~front), np.flatnonzero(front)
        front = front[np.argsort(source[front], kind="stable")]
        found = []
        eighth = (np.floor(at[:, spot] / cutoff).astype(np.int64) * [[1], [2], [4]]).sum(0) if len(spot) else spot
        for e in np.unique(eighth):
            to = spot[eighth == e]
            lo, hi = at[:, to].min(1, keepdims=True) - reach, at[:, to].max(1, keepdims=True) + reach
            near = front[((at[:, front] >= lo) & (at[:, front] <= hi)).all(0)]
            first = np.flatnonzero(np.r_[True, source[near][1:] != source[near][:-1]]) if len(near) else []
            for a, b in zip(first, [*first[1:], len(near)]):
                least = np.full(len(to), np.inf)
                step = max(1, PAIRS // len(to))
                for f in (near[c : min(c + step, b)] for c in range(a, b, step)):
                    x, y, z = at[:, f, None] - at[:, None, to]
                    apart = np.sqrt(x * x + y * y + z * z)
                    met = (apart <= cutoff) & (np.abs(node[f][:, None] - node[to]) >= separation)
                    least = np.minimum(least, np.where(met, apart + dist[f][:, None], np.inf).min(0))
                hit = np.isfinite(least)
                found.append((to[hit], np.full(hit.sum(), source[near[a]]), least[hit]))
        row, by, least = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([*[t.column(c).take(pa.array(row)) for c in k], pa.array(by.astype(np.int64)), pa.array(node[row]), pa.array(least)], names=[*k, "source", "node", "new"])

    names = ", ".join([*[f"`{c}` {kind[c]}" for c in k], "source long", "node long", "new double"])
    best = front = materialised(sources.select(*k, F.col("source").cast("long").alias("source"), F.col("source").cast("long").alias("node"), F.lit(0.0).alias("dist")))
    for _ in range(most_rounds):
        sent = front.join(p.hint("merge"), [*k, "node"])
        for c in "xyz":
            sent = sent.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge))))
        step = sent.select(*spots.columns).unionByName(spots).groupBy(*group).applyInArrow(offers, names)
        step = step.groupBy(*k, "source", "node").agg(F.min("new").alias("new"))
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
        j = best.join(step.hint("merge"), [*k, "source", "node"], "full")
        nxt = materialised(j.select(*k, "source", "node", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")))
        drop_written(best)
        best, front = nxt.drop("moved"), nxt.filter("moved").drop("moved")
        if front.isEmpty():
            drop_written(p)
            return best.withColumns({c: F.col(c).cast(kind["node"]) for c in ("source", "node")})
    raise RuntimeError("paths did not settle")


def straight_bounds(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """(keys, node, low): how far a node's farthest one is at least, where no edge is shorter than the straight distance.

    The nodes of its component that are outermost in 26 directions are no nearer than that.
    """
    k = list(keys)
    c = components(nodes, edges, keys).join(nodes.hint("merge"), [*k, "node"])
    spot, ways = F.struct("x", "y", "z"), [w for w in product((-1, 0, 1), repeat=3) if any(w)]
    outer = c.groupBy(*k, "component").agg(F.array(*[F.max_by(spot, w[0] * F.col("x") + w[1] * F.col("y") + w[2] * F.col("z")) for w in ways]).alias("_o"))
    far = F.array_max(F.transform("_o", lambda o: F.sqrt(sum(((F.col(d) - o[d]) * (F.col(d) - o[d]) for d in "xyz"), F.lit(0.0)))))
    return c.join(outer.hint("merge"), [*k, "component"]).select(*k, "node", F.coalesce(far, F.lit(0.0)).alias("low"))


def centre(edges: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("mol_id",), first: int = 2, paths=None, sweep: bool = False) -> DataFrame:
    """(keys, centre, radius): the candidate whose farthest node is nearest; the smallest id on ties.

    Paths start from a few candidates of each graph, twice as many in each round.  A
    candidate at distance d from one whose farthest node is at e has its own at
    ``max(d, e - d)`` at least; those that this puts beyond the best so far are
    never searched.  Nodes that cannot be reached do not count.  Candidates may have a bound
    of their own in ``low``; ``paths`` gives paths from sources in place of ``shortest_paths``,
    and ``edges`` may be None then.  With ``sweep`` each round also starts from the nodes that were
    farthest in the one before: their distances to candidates bound those from below closely,
    so few candidates near the centre of a dense graph are searched.
    """
    k = list(keys)
    edges = materialised(edges) if edges is not None else None
    low = F.col("low") if "low" in candidates.columns else F.lit(0.0)
    open_ = materialised(candidates.select(*k, "node", low.alias("low")).distinct())
    # sources that are no candidates count for bounds only
    some = materialised(open_.select(*k, F.col("node").alias("source"))) if sweep else None
    known, size, aims = [], first, None
    while not open_.isEmpty():
        w = Window.partitionBy(*k).orderBy("low", "node")
        picked = open_.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= size).select(*k, F.col("node").alias("source"))
        if aims is not None:
            picked = picked.unionByName(aims.join(open_.select(*k).distinct().hint("merge"), k, "left_semi")).distinct()
        picked = materialised(picked)
        far = paths(picked) if paths else shortest_paths(edges, keys, picked)
        out = far.groupBy(*k, "source").agg(F.max("dist").alias("far"))
        # a candidate without any edge is its own farthest node
        known.append(materialised(picked.join(out.hint("merge"), [*k, "source"], "left").select(*k, "source", F.coalesce("far", F.lit(0.0)).alias("far"))))
        every = known[0]
        for x in known[1:]:
            every = every.unionByName(x)
        if sweep:
            was = every.select(*k, "source").hint("merge")
            last, aims = aims, materialised(far.groupBy(*k, "source").agg(F.max_by("node", F.struct("dist", "node")).alias("node")).select(*k, F.col("node").alias("source")).distinct().join(was, [*k, "source"], "left_anti"))
            drop_written(*([last] if last is not None else []))
            every = every.join(some.hint("merge"), [*k, "source"], "left_semi")
        best = every.groupBy(*k).agg(F.min("far").alias("best"))
        bound = far.join(known[-1].hint("merge"), [*k, "source"]).groupBy(*k, "node").agg(F.max(F.greatest("dist", F.col("far") - F.col("dist"))).alias("_b"))
        rest = open_.join(picked.withColumnRenamed("source", "node").hint("merge"), [*k, "node"], "left_anti").join(bound.hint("merge"), [*k, "node"], "left").join(best.hint("merge"), k)
        rest = rest.withColumn("low", F.greatest("low", F.coalesce("_b", F.lit(0.0)))).filter(F.col("low") <= F.col("best") + 2e-9)
        nxt = materialised(rest.select(*k, "node", "low"))
        drop_written(open_, picked, far)
        open_, size = nxt, 2 * size
    drop_written(open_, *[x for x in (edges, aims) if x is not None])
    if not known:
        return candidates.select(*k, F.col("node").alias("centre"), F.lit(0.0).alias("radius"))
    every = known[0]
    for x in known[1:]:
        every = every.unionByName(x)
    every = every.join(some.hint("merge"), [*k, "source"], "left_semi") if sweep else every
    return every.groupBy(*k).agg(F.min_by("source", F.struct(F.round("far", 9), "source")).alias("centre"), F.min("far").alias("radius"))
