"""Near duplicates by bottom-k sketches: inverted lists, union-sketch estimates, exact check.

A set's sketch holds its SKETCH smallest values under one hash function.

1. Equal sets become one class; all later work is on classes.
2. Retained values are inverted to lists, each with the value that follows it, so that
   frequent shingles, which two words alone make common in any large corpus, do not
   fill lists.  Lists of one class go.
3. The lists of the KEYS smallest shared pairs of each class, and then all lists in
   which classes of different components are left, generate overlaps: within a list the
   bottom of the union of two sketches estimates their similarity.  Classes that
   may link to one of another component go on, a row a class.
   In long lists products of matrices bound what two sketches have in common, and
   only pairs that may pass are estimated.
4. Their whole sets are compared exactly, a list at a time, to a spanning forest.

What is lost.  Sets A and B of sizes n and m that link differ so little that one of the
first ``2 (n - |A & B|) + (m - |A & B|) <= 0.4 n`` (for a share of 80) pairs of
neighbours of A stands in B too, at most as far behind for its size; so no more of them
are retained, and sets of up to 150 shingles lose nothing.  Of larger sets none of 64 pairs is common with a chance of
about 0.51^64 = 1e-19 where the similarity is just 0.8; that fewer than SURE of the 64
smallest values of the union are common has one of about 1e-13.

In a list of over BLOCK classes, parts of the component that most are of meet all the
others, if those are BLOCK at most; with more others each part of the list meets each
other one.  So all classes of a list meet, at c^2 / BLOCK rows for c classes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, mix, shingle_sets, text_slices
from lodestone.llm.components import components
from lodestone.llm.ngram_join import BLOCK, FEW_ROWS, MEMBERS, N_KEYS, blocks, joined_blocks, representatives

SKETCH = 64  # smallest values that are kept
SURE = 26  # of the SKETCH smallest values of a union that two sets which link have in common
FIRSTS = 16  # lists of a class by which two classes are told to meet elsewhere
FEW = 16  # rows of a list of which all pairs are estimated
BUCKETS = 512  # of a sketch's values in a longer list
STEP = 256  # rows of a longer list that meet the others at once
PAIRS = 1 << 13  # that a task estimates at once
EMPTY = (1 << 32) - 1  # above all values of a sketch


def retained(n, share: int):
    """How many smallest values of a set of ``n`` hold one that is in any set it links to."""
    return n - -(-share * n // 100) + 1


def smallest_linked(share: int) -> int:
    """The least size of a set that links to one that is not equal: 100 n >= share (n + 1)."""
    return next(n for n in range(1, 101) if 100 * n >= share * (n + 1)) if share < 100 else 1 << 62


def sketches(docs: DataFrame, size: int, share: int) -> DataFrame:
    """One row a document: text hash, set size, class, and the sketch, smallest values first."""
    least, most = smallest_linked(share), SKETCH + 1

    def run(batches):
        for part in text_slices(batches):
            sets = shingle_sets(part.column(1), size)
            n = np.array([len(s) for s in sets], np.int64)
            value = [np.sort(np.partition(h, most)[:most] if len(h) > most else h) if len(h) >= least else h[:0] for h in (mix(s) >> np.uint64(1) for s in sets)]
            at = np.r_[0, np.cumsum(n)]
            every = mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            sums = np.r_[np.uint64(0), np.cumsum(every, dtype=np.uint64)]
            cls = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).astype(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in value])], pa.int32()), pa.array(np.concatenate(value).astype(np.int64) if value else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(np.where(n > 0, cls, 0)), sketch], ["doc_id", "text_hash", "n", "cls", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, cls long, sketch array<long>")


def pairs_needed(share: int) -> Column:
    """How many of a set's first pairs of neighbours hold one that is in any set it links to, as far as its own end.

    A value that the other set lacks breaks two pairs, one that only the other has breaks one: ``2 x + y`` with
    ``100 (x + y) <= (100 - share) (n + y)``, which is largest where ``x`` or ``y`` is 0.
    """
    return F.floor(F.col("n") * ((100 - share) * max(2 * share, 100)) / F.lit(100 * share)) + 1


def inverted(classes: DataFrame, share: int) -> DataFrame:
    """(value, cls) of pairs of neighbours that several classes retain; ``value`` is the hash of the pair."""
    most = F.least(F.size("sketch") - 1, F.lit(SKETCH), pairs_needed(share)).cast("int")
    pairs = F.transform(F.slice("sketch", F.lit(1), F.greatest(most, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("sketch", i + 1)))
    rows = classes.select("cls", F.explode(pairs).alias("value"))
    # counts are written first: then both sides of the join are plain shuffles, and a hot list can be split
    count = materialised(rows.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1").select("value"))
    out = materialised(rows.join(count.hint("merge"), "value"))
    drop_written(count)
    return out


def known_parts(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, values, keys) of classes in lists: the sketch by upper halves, and the KEYS smallest of its shared pairs."""
    keys = lists.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("value")), 1, N_KEYS).alias("keys"))  # of one sketch
    values = F.transform(F.slice("sketch", 1, SKETCH), lambda x: F.shiftright(x, 32).cast("int"))
    return classes.select("cls", "n", values.alias("values")).join(keys.hint("merge"), "cls")


def whole_blocks(batches):
    """Record batches of rows in order of ``block`` as tables that hold all rows of their blocks."""
    held: list = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        change = np.flatnonzero(block[1:] != block[:-1]) + 1
        last = change[-1] if len(change) else 0
        if held and len(block) and held[-1].column(0)[-1].as_py() != block[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        if len(block):
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def rows_of(lists: pa.ListArray, width: int, empty: int, kind) -> np.ndarray:
    """A matrix with a row a list, filled up with ``empty``."""
    out = np.full((len(lists), width), empty, kind)
    n = lists.value_lengths().to_numpy()
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = lists.flatten().to_numpy()
    return out


def met_in_list(n: np.ndarray, value: np.ndarray, share: int):
    """Pairs (i, j) of a long list's rows that may pass ``estimate``; the others cannot.

    A sketch is counted into BUCKETS, so that products of matrices bound how many values two of them have in common.
    """
    m, limit = len(n), SURE
    order = np.argsort(n, kind="stable")
    n, value = n[order], value[order]
    at = np.repeat(np.arange(m), SKETCH)[(own := value != EMPTY).ravel()] * BUCKETS + value[own] % BUCKETS
    counts = np.bincount(at, minlength=m * BUCKETS).reshape(m, BUCKETS).astype(np.float32)
    small = int(np.searchsorted(n, SKETCH, side="right"))
    for x in sorted({*range(0, m, STEP), small} - {m}):
        end = min(x - x % STEP + STEP, small if x < small else m)
        upto = int(np.searchsorted(n, n[end - 1] * 100 // share, side="right"))
        both = counts[x:end] @ counts[x:upto].T
        least = limit
        if x < small:  # two whole sets
            least = np.where(np.arange(x, upto) < small, share * (n[x:end, None] + n[x:upto]) / (100 + share) - 0.01, limit)
        i, j = np.nonzero(both >= least)
        i, j = i[i < j] + x, j[i < j] + x
        ok = 100 * n[i] >= share * n[j]
        yield order[i[ok]], order[j[ok]]


def estimate(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Which pairs of sets of sizes n, m and sketches a, b may link, by the bottom of the union of both."""
    every = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = (every[:, 1:] == every[:, :-1]) & (every[:, 1:] != EMPTY)
    common = np.cumsum(twice, axis=1, dtype=np.int16)
    place = np.arange(2, every.shape[1] + 1, dtype=np.int16) - common  # in the union
    among = (twice & (place <= SKETCH)).sum(axis=1)
    most = np.maximum(n, m)
    return np.where(most <= SKETCH, (100 + share) * common[:, -1].astype(np.int64) >= share * (n + m), among * SKETCH >= SURE * np.minimum(SKETCH, most))


def alive(table: pa.Table, share: int) -> np.ndarray:
    """The rows of whole lists that may link to one of another component, by the bottom of the union of their sketches.

    Rows are (list, class, component, size, sketch, firsts).  Two classes are compared in the
    first of their lists only, as far as ``firsts`` tells.
    """
    never = np.iinfo(np.int64).max
    block, _, group, n = (table.column(k).to_numpy() for k in range(4))
    value, firsts = (rows_of(table.column(k).combine_chunks() if table.column(k).num_chunks != 1 else table.column(k).chunk(0), *kind) for k, kind in ((4, (SKETCH, EMPTY, np.uint32)), (5, (FIRSTS, never, np.int64))))
    firsts = np.where(firsts < block[:, None], firsts, never)
    live = np.zeros(len(n), bool)

    def compare(i, j):
        ok = (group[i] != group[j]) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            new = ~(live[x] & live[y])
            x, y = x[new], y[new]
            may = estimate(n[x], n[y], value[x], value[y], share)
            x, y = x[may], y[may]
            f = firsts[x]
            before = ((f[:, :, None] == firsts[y][:, None, :]) & (f != never)[:, :, None]).any((1, 2))
            live[x[~before]] = live[y[~before]] = True

    starts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    size = np.diff(starts)
    for m in range(2, FEW + 1):
        i, j = np.triu_indices(m, 1)
        some = starts[:-1][size == m]
        for at in range(0, len(some), PAIRS):
            s = some[at : at + PAIRS, None]
            compare((s + i).ravel(), (s + j).ravel())
    for s, m in zip(starts[:-1][size > FEW], size[size > FEW]):
        if (group[s : s + m] != group[s]).any():
            for i, j in met_in_list(n[s : s + m], value[s : s + m], share):
                compare(s + i, s + j)
    return live


def forest(sets: list[np.ndarray], share: int, n_bytes: int, group: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among whole sets of different groups: bottom-k by the plain hash, then exact counts."""
    m, out = len(sets), []
    n = np.array([len(s) for s in sets], np.int64)
    label = group.copy()
    k = retained(n, share)
    bottom = [s[:p] for s, p in zip(sets, k)]  # sets are in order of the hash
    start = np.r_[0, np.cumsum(k)]
    known, ids = np.unique(np.concatenate(bottom), return_inverse=True)
    owner = np.repeat(np.arange(m), k)
    place = owner * (len(known) + 1) + ids
    post = np.argsort(ids, kind="stable")
    holders, first = owner[post], np.searchsorted(ids[post], np.arange(len(known) + 1))
    last = ids[start[1:] - 1]
    whole = None
    for x in range(1, m):
        own = ids[start[x] : start[x + 1]]
        both = np.bincount(np.concatenate([holders[first[v] : first[v + 1]] for v in own]), minlength=m)[:x]
        y = np.flatnonzero((both > 0) & (label[:x] != label[x]) & (100 * np.minimum(n[:x], n[x]) >= share * np.maximum(n[:x], n[x])))
        limit = np.minimum(last[y], last[x])
        seen = [np.searchsorted(place, z * (len(known) + 1) + limit, side="right") - start[z] for z in (np.full(len(y), x), y)]
        apart = seen[0] + seen[1] - 2 * both[y]
        y = y[(100 + share) * apart <= (100 - share) * (n[x] + n[y])]
        y = y[np.argsort(-both[y], kind="stable")]
        counts = None
        while len(y):
            if counts is None and len(y) > 3:
                if whole is None:
                    _, all_ids = np.unique(np.concatenate(sets), return_inverse=True)
                    order = np.argsort(all_ids, kind="stable")
                    whole = all_ids, np.r_[0, np.cumsum(n)], np.repeat(np.arange(m), n)[order], np.searchsorted(all_ids[order], np.arange(all_ids.max() + 2))
                all_ids, at, by, begin = whole
                mine = all_ids[at[x] : at[x + 1]]
                counts = np.bincount(np.concatenate([by[begin[v] : begin[v + 1]] for v in mine]), minlength=m)
            z = y[0]
            common = counts[z] if counts is not None else len(np.intersect1d(sets[x], sets[z], assume_unique=True))
            if (100 + share) * common >= share * (n[x] + n[z]):
                out.append((x, int(z)))
                label[label == label[z]] = label[x]
            y = y[1:]
            y = y[label[y] != label[x]]
    return out


def mixed(lists: DataFrame, once: bool) -> tuple[DataFrame, DataFrame]:
    """The lists in which components differ, and how many rows each has; both written.

    ``once``: of lists that hold the same classes one.
    """
    count = lists.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("cls")).alias("h"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("i")).filter("lo < hi")
    if once:
        count = count.groupBy("c", "h", "i").agg(F.min("block").alias("block"))
    count = materialised(count.select("block", "c"))
    return materialised(lists.join(count.hint("merge"), "block")), count


def late_blocks(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """(cls, component, block) of all lists with different components; large ones in parts that meet."""
    rows = lists.join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").select(F.col("value").alias("block"), "cls", F.coalesce("component", "cls").alias("component"))
    rows = materialised(rows)
    written = [rows]
    rows, count = mixed(rows, once=True)
    written += [rows, count]
    blocked = rows.filter(F.col("c") <= BLOCK).select("cls", "component", "block")
    large = rows.filter(F.col("c") > BLOCK)
    if not large.isEmpty():
        n = large.groupBy("block", "component").agg(F.count("*").alias("n"))
        main = materialised(n.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main")))
        large = materialised(large.join(main.hint("merge"), "block"))
        written += [main, large]
        # few classes outside the main component: each part of that meets all of them
        parts = F.ceil(F.col("n_main") / BLOCK).cast("int")
        own = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("cls"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
        apart = F.col("c") - F.col("n_main") <= BLOCK
        blocked = blocked.unionByName(large.filter(apart).withColumn("part", F.explode(own)).select("cls", "component", F.xxhash64("block", F.lit("part"), "part").alias("block")))
        # many: each part meets each other one, so that no two classes of the list miss each other
        parts = F.ceil(F.col("c") / BLOCK).cast("int")
        p = large.filter(~apart).withColumn("p", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
        blocked = blocked.unionByName(p.select("cls", "component", F.xxhash64("block", F.least("p", "q"), F.greatest("p", "q")).alias("block")))
    blocked = materialised(blocked)
    drop_written(*written)
    return blocked


def live(members: DataFrame, known: DataFrame, share: int) -> DataFrame:
    firsts = members.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("block")), 1, FIRSTS).alias("firsts"))  # of one sketch
    rows = members.join(known.drop("keys").hint("merge"), "cls").join(firsts.hint("merge"), "cls")
    ordered = rows.repartition("block").sortWithinPartitions("block").select("block", "cls", "component", "n", "values", "firsts")

    def run(batches):
        for table in whole_blocks(batches):
            picked = pa.array(np.flatnonzero(alive(table, share)))
            yield from table.select(["cls", "component", "block"]).take(picked).to_batches()

    return ordered.mapInArrow(run, MEMBERS)


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, size: int = 2, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept of every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  Texts
    with fewer than ``size`` words are one shingle.  Null texts and texts without a
    word have no shingle, link with nothing, and are their own components.  Rows
    with equal sets link; rows that repeat an id with other texts each count, and null
    ids are ignored as component ids where there is another.  A row is kept if its id
    is its component's, so rows that repeat such an id are kept each, and a row
    without an id is kept if no row of its component has one.  An empty table gives no rows.
    Other columns are not read.  The result is written to the shared folder, and what
    led to it is deleted there.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    written: list = []
    profile = materialised(sketches(d, size, share))
    classes = materialised(representatives(profile, "sketch"))
    lists = inverted(classes, share)
    known = materialised(known_parts(lists, classes))
    members = materialised(blocks(known, BLOCK))
    early = materialised(live(members, known, share))
    comp = materialised(components(joined_blocks(d, classes, early, size, share, written, FEW_ROWS, forest)))
    drop_written(members, early)
    members = late_blocks(lists, comp)
    late = materialised(live(members, known, share))
    drop_written(lists, members, known)
    of = classes.select("cls", "rep").join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    found = []
    if not late.isEmpty():
        more = joined_blocks(d, classes, late, size, share, written, FEW_ROWS, forest)
        side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")).hint("merge")
        more = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        found.append(materialised(components(more)))
        of = of.join(found[0].select(F.col("node").alias("component"), F.col("component").alias("late")).hint("merge"), "component", "left").withColumn("component", F.coalesce("late", "component"))
    first = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(first.hint("merge"), "component").select("cls", "component_id")
    out = profile.select("doc_id", "n", "cls").join(of.hint("merge"), "cls", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    out = materialised(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    drop_written(profile, classes, comp, late, *written, *found)
    return out
