"""N-gram Jaccard join with signature trees.

Sets of word shingles link when their Jaccard similarity reaches a share.  The
join returns connected components and misses no link:

1. Equal sets become one class; all later work is on classes.
2. Blocks of classes that share a minimum hash are joined exactly, each by a
   signature tree over the whole sets.  Blocks that are too large are divided by
   a second minimum hash, then by slots that share a pivot.  This links nearly all.
3. For the rest, each class lists the first ``n - ceil(share n) + 1`` of its
   tokens in one global order (frequent ones last).  Sets that link have one of
   them in common.  For each token that classes of different components list, a
   tree over fixed-size bitmaps finds the classes that may link to one of another
   component which they have not met yet, one row a class and token; a second tree
   over bitmaps as wide as their sets leaves those that go on, and their whole sets
   are joined exactly as in step 2.

No step hands on pairs: a block gives rows of its members, or edges of a spanning
forest, so a family of n near copies gives rows in proportion to n.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, mix, shingle_sets, text_slices
from lodestone.llm.components import components
from lodestone.llm.signature_tree import FANOUT, Tree, bitmap, folded, linked, may_link

N_KEYS = 4
BITMAP = 64  # bytes of a class's fixed bitmap
WIDEST = 4096  # bytes of its wide one, at most
BLOCK = 1024  # classes in one tree
HEAVY = 1 << 18  # tokens whose frequency is kept
SEEN_TOKENS = 1 << 21  # tokens that a task counts together
FIRSTS = 16  # of the tokens that a class shares, those by which pairs are told to have met
FEW_ROWS = 100_000  # that may be broadcast
FEW_HASHES = 1 << 20  # alone, without the rows
TASK_MEMBERS = 512  # of blocks that make one task more
MOST_TASKS = 8192


def token_levels(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The HEAVY most frequent tokens, sorted, and how frequent each is, in quarters of an octave.

    Tasks count their tokens in stretches and hand on those that come at least three
    times, so counts are too low by rare uses only.  They order tokens, so results do
    not depend on them.  They come to the driver by whole levels of frequency from the
    top, told apart by a count of each level first: HEAVY rows, 4 MB, at most.
    """

    def count(batches):
        held, n = [], 0

        def frequent():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(u[many].astype(np.int64)), pa.array(c[many].astype(np.int64))], ["token", "n"])

        for part in text_slices(batches):
            held += shingle_sets(part.column(0), size)
            n += sum(map(len, held[-part.num_rows :]))
            if n >= SEEN_TOKENS:
                yield frequent()
                held, n = [], 0
        if held:
            yield frequent()

    level = F.least(F.floor(4 * F.log2("n")), F.lit(255)).cast("int")
    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).select("token", level.alias("level"))
    top = materialised(top)
    sizes = sorted(((r["level"], r["count"]) for r in top.groupBy("level").count().collect()), reverse=True)
    kept = [x for (x, _), total in zip(sizes, np.cumsum([c for _, c in sizes])) if total <= HEAVY]
    rows = top.filter(F.col("level") >= (min(kept) if kept else 256)).toPandas()
    drop_written(top)
    token = rows["token"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy(np.uint8)[order]


def levels_of(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for tokens that are not frequent."""
    keys, level = heavy
    if not len(keys):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, level[at], 0)


def profiles(docs: DataFrame, size: int, share: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One short row a document: set size, class, minimum hashes, listed tokens, bitmaps, hash of the text.

    Listed tokens that are frequent are kept apart as ``hot``: only they can be in a
    large part of all documents.
    """

    def run(batches):
        for part in text_slices(batches):
            sets = shingle_sets(part.column(1), size)
            n = np.array([len(s) for s in sets])
            cls, keys, listed, hot, bits, wide = [], [], [], [], [], []
            for s in sets:
                if not len(s):
                    cls.append(0), keys.append([]), listed.append([]), hot.append([]), bits.append(b""), wide.append(b"")
                    continue
                cls.append(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))
                keys.append([mix((s ^ mix(np.array([k + 1], np.uint64))) * np.uint64(2 * k + 3)).min().astype(np.int64) for k in range(N_KEYS)])
                p = len(s) - -(-share * len(s) // 100) + 1
                level = levels_of(s, heavy)
                at = np.argsort(level, kind="stable")[:p]
                listed.append(s[at][level[at] == 0].astype(np.int64))
                hot.append(s[at][level[at] > 0].astype(np.int64))
                bits.append(bitmap(s, BITMAP).tobytes())
                wide.append(bitmap(s, min(max(BITMAP, 1 << (len(s) // 4).bit_length()), WIDEST)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "text_hash", "n", "cls", "keys", "listed", "hot", "bits", "wide"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, cls long, keys array<long>, listed array<long>, hot array<long>, bits binary, wide binary")


def blocks(classes: DataFrame, size: int) -> DataFrame:
    """(cls, component, block) for blocks of two classes at least: by minimum hash, divided where larger than ``size``."""
    m = classes.select("cls", "keys", F.posexplode("keys").alias("k", "key"))
    m = m.withColumn("other", F.get("keys", (F.col("k") + 1) % N_KEYS)).drop("keys")
    # counts are written first: then both sides of the join are plain shuffles, and a hot key can be split
    count = materialised(m.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    m = m.join(count.hint("merge"), "key")
    small = m.filter(F.col("c") <= size).select("cls", F.col("key").alias("block"))
    deep = m.filter(F.col("c") > size).select("cls", F.xxhash64("key", "other").alias("key"))
    count = materialised(deep.groupBy("key").agg(F.count("*").alias("c"), F.min("cls").alias("pivot")).filter("c > 1"))
    slots = F.ceil(F.col("c") / size).cast("long")
    slot = deep.join(count.hint("merge"), "key").select("cls", F.xxhash64("key", F.pmod(F.xxhash64("cls"), slots)).alias("block"))
    # each slot of a block also gets the block's pivot
    pivot = count.filter(F.col("c") > size).select(F.col("pivot").alias("cls"), "key", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("s")).select("cls", F.xxhash64("key", "s").alias("block"))
    return small.unionByName(slot.unionByName(pivot).distinct()).select("cls", F.col("cls").alias("component"), "block")


def representatives(profile: DataFrame, *columns: str) -> DataFrame:
    """Classes with ``rep``, the smallest id, and ``text_id`` and ``text_hash``, which name a text of the class.

    An id alone does not: rows may share one, or have none.
    """
    one = F.min(F.struct(F.col("doc_id").alias("text_id"), "text_hash"))
    return profile.filter("n > 0").groupBy("cls", "n", *columns).agg(F.min("doc_id").alias("rep"), one.alias("one")).select("cls", "n", *columns, "rep", "one.*")


def joined_blocks(docs: DataFrame, classes: DataFrame, members: DataFrame, size: int, share: int, written: list, few: int = 0, forest=linked) -> DataFrame:
    """Edges (a, b) between components: a spanning forest of each block, from the whole texts of its classes.

    Up to ``few`` members are broadcast, so that only their texts move.  With more, texts are
    dealt by id and hash, those alone whose hash is wanted where ``few`` says that most are not
    and the hashes are FEW_HASHES at most.  ``written`` gets a table that is to be dropped later.
    ``forest`` is what links a block's whole sets.
    """
    wanted = members.join(classes.select("cls", "text_id", "text_hash").hint("merge"), "cls")
    wanted = materialised(wanted)
    written.append(wanted)
    n = wanted.count() if few else 0
    small = bool(few) and n <= few
    side = F.broadcast(wanted) if small else wanted.hint("merge")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("own_hash"))
    if few and not small:
        hashes = materialised(wanted.select(F.col("text_hash").alias("own_hash")).distinct())
        written.append(hashes)
        if hashes.count() <= FEW_HASHES:
            d = d.join(F.broadcast(hashes), "own_hash", "left_semi")
    texts = d.join(side, d["doc_id"].eqNullSafe(wanted["text_id"]) & (d["own_hash"] == wanted["text_hash"])).select("cls", "block", "text", "component")
    # few bytes can be many pairs: tasks follow the members
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(n // TASK_MEMBERS, MOST_TASKS))
    ordered = (texts.repartition(tasks, "block") if few else texts.repartition("block")).sortWithinPartitions("block", "cls")

    def run(batches):
        block, cls, group, sets = None, [], [], []

        def done():
            pairs = forest(sets, share, 4 * BITMAP, np.unique(group, return_inverse=True)[1])
            a, b = ([cls[p[k]] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for part in text_slices(batches):
            for c, at, s, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2), size), part.column(3).to_pylist()):
                if at != block:
                    if len(sets) > 1:
                        yield done()
                    block, cls, group, sets = at, [], [], []
                if c not in cls[-1:]:  # a repeated row adds nothing
                    cls.append(c), group.append(g), sets.append(s)
        if len(sets) > 1:
            yield done()

    return ordered.mapInArrow(run, "a long, b long")


def shared_tokens(profile: DataFrame, comp: DataFrame) -> DataFrame:
    """(token, cls, component, c) for listed tokens that classes of different components share; c: how many classes."""
    listed = profile.filter("n > 0").select("cls", F.explode("listed").alias("token"))
    w = Window.partitionBy("token")
    shared = listed.select("token", "cls", (F.min("cls").over(w) < F.max("cls").over(w)).alias("many")).filter("many").select("token", "cls").distinct()
    # hot tokens are summed up before the shuffle, and their rows are joined, so that a skewed join can be split
    hot = profile.filter("n > 0").select("cls", F.explode("hot").alias("token")).distinct()
    many = materialised(hot.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("token"))
    shared = shared.unionByName(hot.join(many.hint("merge"), "token").select("token", "cls"))
    shared = shared.join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    shared = materialised(shared)
    mixed = materialised(shared.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("token", "c"))
    out = materialised(shared.join(mixed.hint("merge"), "token"))
    drop_written(many, shared, mixed)
    return out


def met(blocks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows have a number in common; zeros do not count."""
    a, b = blocks[i][:, :, None], blocks[j][:, None, :]
    return ((a == b) & (a != 0)).any((1, 2))


def matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for k, x in enumerate(lists):
        x = x or ()
        out[k, : len(x)] = x
    return out


def candidates(shared: DataFrame, classes: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """(cls, component, block) of classes that may link to one of another component in a token's block.

    Pairs that met in a block of ``members``, or that meet by a smaller token, do not
    count.  A token's classes are in parts of BLOCK, and each pair of parts is a block.
    """
    before = members.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("block")), 1, 2 * N_KEYS).alias("met"))
    firsts = shared.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("token")), 1, FIRSTS).alias("firsts"))
    info = classes.select("cls", "n", "bits").join(before.hint("merge"), "cls", "left").join(firsts.hint("merge"), "cls")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("cls"), parts).cast("int")
    rows = shared.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cls", "component").join(info.hint("merge"), "cls")
    rows = rows.withColumn("block", F.xxhash64("token", "p", "q"))
    ordered = rows.repartition("block").sortWithinPartitions("block").select("block", "cls", "component", "n", "bits", "token", "p", "q", "part", "met", "firsts")

    def alive(held):
        _, _, _, _, _, token, p, q, _, _, _ = held[0]
        if len(held) <= FANOUT:  # a single node of leaves
            live = set()
            for k, y in enumerate(held):
                for j, x in enumerate(held[:k]):
                    # of two parts only the pairs across; within a part it is a block of its own
                    if x[2] != y[2] and (x[8] != y[8] or p == q) and may_link(x[3], x[4], y[3], y[4], share) and not set(x[9] or ()).intersection(y[9] or ()) and not any(t < token for t in set(x[10]).intersection(y[10])):
                        live |= {j, k}
            return sorted(live)
        group, n, part = (np.array([x[k] for x in held], np.int64) for k in (2, 3, 8))
        tree = Tree(np.frombuffer(b"".join(x[4] for x in held), np.uint8).reshape(-1, BITMAP), n, np.unique(group, return_inverse=True)[1])
        live, blocks, firsts = np.zeros(len(held), bool), None, None
        for i, j in tree.pairs(share):
            ok = (group[i] != group[j]) & ((part[i] != part[j]) | (p == q))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if blocks is None:
                blocks = matrix([x[9] for x in held], 2 * N_KEYS)
                firsts = matrix([[t for t in x[10] if t < token] for x in held], FIRSTS)
            for at in range(0, len(i), 1 << 14):
                x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                new = ~met(blocks, x, y)
                x, y = x[new], y[new]
                new = ~met(firsts, x, y)
                live[x[new]] = live[y[new]] = True
        return np.flatnonzero(live).tolist()

    return ordered.mapInArrow(lambda batches: by_block(batches, alive), MEMBERS)


#: Rows of a class in a block.
MEMBERS = "cls long, component long, block long"


def by_block(batches, alive):
    """Those rows (block, cls, component, ...) of each block that ``alive`` picks from its list of them."""
    held, last, out = [], None, []

    def done():
        if len(held) > 1:
            out.extend((held[k][1], held[k][2], last) for k in alive(held))

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != last:
                done()
                held, last = [], row[0]
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["cls", "component", "block"])
            out = []
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["cls", "component", "block"])


def filtered(late: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """The rows of ``late`` that may link to another of their block by bitmaps as wide as their sets.

    Sets that link have equally wide bitmaps, or ones of neighbouring widths, of which
    the wider is folded.
    """
    rows = late.join(classes.select("cls", "n", "wide").hint("merge"), "cls")
    ordered = rows.repartition("block").sortWithinPartitions("block").select("block", "cls", "component", "n", "wide")

    def alive(held):
        group, n = (np.array([x[k] for x in held], np.int64) for k in (2, 3))
        size = np.array([len(x[4]) for x in held])
        live = np.zeros(len(held), bool)
        for w in np.unique(size):
            own = np.flatnonzero((size == w) | (size == 2 * w))
            if len(own) < 2:
                continue
            tree = Tree(np.stack([folded(held[k][4], int(w)) for k in own]), n[own], np.unique(group[own], return_inverse=True)[1])
            for i, j in tree.pairs(share):
                i, j = own[i], own[j]
                ok = ((size[i] == w) | (size[j] == w)) & (group[i] != group[j])
                live[i[ok]] = live[j[ok]] = True
        return np.flatnonzero(live).tolist()

    return ordered.mapInArrow(lambda batches: by_block(batches, alive), MEMBERS)


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, size: int = 5, share: int = 80) -> DataFrame:
    """As ``join``, with ``text_hash`` (xxhash64 of the text) and ``component``, a number for each group; null without words.

    The result is written to the shared folder, and what led to it is deleted there.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    written: list = []
    heavy = token_levels(d, size)
    profile = materialised(profiles(d, size, share, heavy))
    # classes: columns other than the id are equal within one
    classes = materialised(representatives(profile, "keys", "bits", "wide"))
    members = materialised(blocks(classes, BLOCK))
    comp = materialised(components(joined_blocks(d, classes, members, size, share, written)))
    shared = shared_tokens(profile, comp)
    first = materialised(candidates(shared, classes, members, share))
    late = materialised(filtered(first, classes, share))
    drop_written(shared, members, first)
    of = classes.select("cls", "rep").join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    found = None
    if not late.isEmpty():  # most often nothing is left
        # edges between components
        more = joined_blocks(d, classes, late, size, share, written, FEW_ROWS)
        side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")).hint("merge")
        more = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        found = materialised(components(more))
        of = of.join(found.select(F.col("node").alias("component"), F.col("component").alias("late")).hint("merge"), "component", "left").withColumn("component", F.coalesce("late", "component"))
    first = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(first.hint("merge"), "component").select("cls", "component_id", "component")
    out = profile.select("doc_id", "text_hash", "n", "cls").join(of.hint("merge"), "cls", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = materialised(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_hash", F.when(F.col("n") > 0, F.col("component")).alias("component")))
    drop_written(profile, classes, comp, late, *written, *([found] if found is not None else []))
    return out


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, size: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  Texts
    with fewer than ``size`` words are one shingle.  Null texts and texts without a
    word have no shingle, link with nothing, and are their own components.  Rows
    with equal sets link; rows that repeat an id with other texts each count, and
    null ids are ignored as component ids where there is another.
    An empty table gives no rows.  Other columns are not read.
    """
    return grouped(docs, text, doc_id, size=size, share=share).select("doc_id", "n_shingles", "component_id")
