"""Hard negatives by exact inner products in residue arithmetic.

Components are whole numbers.  Their inner products are taken modulo several small
primes by float32 matrix products, which are exact below 2^24, and put together by
Chinese remaindering; there are as many primes as the longest vectors need.

The anchors are a stated query set against all rows, in blocks: anchors are dealt
into groups of bounded size, rows into groups, and each pair of groups is one tile.
A task holds a tile's anchors and reads its rows as they come, so a tile's rows need
no memory.  A tile hands on the first few rows of each anchor, never all pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised

#: Primes for which 64 products of two centred residues stay below 2^24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
WIDTH = 64  # components in one float32 product
MOST_SCORE = 1 << 56  # so that a hundredfold score is still a long
ANCHORS = 1 << 15  # in a tile, about
ROW_GROUPS = 32  # at least; more where a group would have over ROWS rows
ROWS = 1 << 21
BATCH = 1024  # rows scored at once
BLOCK = 1024  # anchors scored at once
NO_ID = np.iinfo(np.int64).max


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product is over four times ``bound``."""
    product = 1
    for k, p in enumerate(PRIMES):
        product *= p
        if product > 4 * bound:
            return PRIMES[: k + 1]
    raise ValueError(f"scores of up to {bound} need more than {len(PRIMES)} primes")


def residues(values: np.ndarray, p: int, factor: int = 1) -> np.ndarray:
    """Centred residues of whole numbers times a factor, as float32."""
    r = np.mod(values, p) * factor % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


class Anchors:
    """Anchor components, ready to be multiplied: their residues hold the factors of the Chinese remainder."""

    def __init__(self, values: np.ndarray, primes: tuple[int, ...]):
        self.primes, self.product = primes, int(np.prod(np.array(primes, np.int64)))
        self.parts = [self.product // p for p in primes]
        self.sides = [residues(values, p, pow(m, -1, p)) for p, m in zip(primes, self.parts)]

    def scores(self, rows: np.ndarray, at: slice) -> np.ndarray:
        """Exact inner products of the anchors in ``at`` with rows of whole numbers."""
        total = None
        for p, m, side in zip(self.primes, self.parts, self.sides):
            other, r = residues(rows, p).T, None
            for k in range(0, side.shape[1], WIDTH):
                g = side[at, k : k + WIDTH] @ other[k : k + WIDTH]
                g -= np.float32(p) * np.rint(g / np.float32(p))
                r = g if r is None else r + g
            r -= np.float32(p) * np.rint(r / np.float32(p))
            term = r.astype(np.int64) * m
            total = term if total is None else total + term
        return total - self.product * np.rint(total / self.product).astype(np.int64)


class Firsts:
    """For each anchor and each of its windows (floor, ceiling] the first ``most`` rows by (score descending, arrival)."""

    def __init__(self, floors: np.ndarray, ceilings: np.ndarray, most: int):
        self.floor, self.ceiling, self.most = floors.copy(), ceilings, most
        self.score = np.zeros((*floors.shape, most), np.int64)
        self.id, self.hash = np.zeros_like(self.score), np.zeros_like(self.score)
        self.n = np.zeros(floors.shape, np.int64)

    def take(self, at: slice, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        """Rows in their order; a row that ties with all of a full window comes too late for it."""
        low, high = self.floor[at], self.ceiling[at]
        open_ = allowed & (score > low.min(1)[:, None]) & (score <= high.max(1)[:, None])
        a, r = np.nonzero(open_)
        if not len(a):
            return
        s = score[a, r]
        for w in range(low.shape[1]):
            ok = (s > low[a, w]) & (s <= high[a, w])
            if ok.any():
                self.merge(at.start, w, a[ok], s[ok], ids[r[ok]], hashes[r[ok]])

    def merge(self, start: int, w: int, a: np.ndarray, s: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        touched = np.unique(a)
        n = self.n[start + touched, w]
        k = np.arange(self.most)[None, :] < n[:, None]
        old = np.repeat(start + touched, n)
        a = np.r_[old, start + a]
        s = np.r_[self.score[start + touched, w][k], s]
        ids, hashes = np.r_[self.id[start + touched, w][k], ids], np.r_[self.hash[start + touched, w][k], hashes]
        order = np.lexsort((-s, a))  # stable: what came first stays first
        a = a[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kept = place < self.most
        order, a, place = order[kept], a[kept], place[kept]
        self.score[a, w, place], self.id[a, w, place], self.hash[a, w, place] = s[order], ids[order], hashes[order]
        touched = start + touched
        self.n[touched, w] = np.bincount(a, minlength=touched[-1] + 1)[touched]
        full = touched[self.n[touched, w] == self.most]
        self.floor[full, w] = self.score[full, w, -1]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; what a shorter one lacks is 0."""
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def prepared(rows: DataFrame, vector: str, row_id: str, label: str, scale: float) -> DataFrame:
    """(id, label, v, hash): whole components; rows that lack a label, a vector or a finite component are out."""
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    r = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda c: c.cast("double")).alias("x"))
    r = r.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    v = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c))
    return r.select("id", "label", v.alias("v")).withColumn("hash", F.xxhash64("label", "v"))


def tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Anchors (kind 0) and rows (kind 1) of each tile together, rows in order of id and hash."""
    a_groups, r_groups = -(-n_anchors // ANCHORS), max(ROW_GROUPS, -(-n_rows // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("ag", F.pmod("hash", F.lit(a_groups)).cast("int")).withColumn("rg", every(r_groups)).withColumn("kind", F.lit(0))
    # rows are read from a written table, so their numbers are the same whenever a task runs again
    r = rows.withColumn("rg", F.pmod(F.monotonically_increasing_id(), F.lit(r_groups)).cast("int")).withColumn("ag", every(a_groups)).withColumn("kind", F.lit(1))
    both = a.unionByName(r, allowMissingColumns=True)
    order = ["ag", "rg", "kind", F.coalesce("id", F.lit(NO_ID)), F.col("id").isNull(), "hash"]
    return both.repartition("ag", "rg").sortWithinPartitions(*order)


FOUND = "anchor long, anchor_hash long, w int, score long, id long, hash long"


def firsts(tiled: DataFrame, width: int, primes: tuple[int, ...], most: int, same: bool, share: tuple[int, int]) -> DataFrame:
    """(anchor, anchor_hash, w, score, id, hash): candidates of each tile.

    ``same``: of the anchor's label, other than it, one window without limits.  Else
    of other labels, a window for each of the anchor's ``marks``.
    """
    columns = ["ag", "rg", "kind", "id", "label", "hash", "v"] + ([] if same else ["marks"])

    def flush(held):
        if held is None:
            return
        f = held["firsts"]
        a, w, k = np.nonzero(np.arange(f.most)[None, None, :] < f.n[:, :, None])
        ids = f.id[a, w, k]
        null = held["null"][a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held["id"][a], pa.int64(), mask=null), pa.array(held["hash"][a]), pa.array(w, pa.int32()), pa.array(f.score[a, w, k]), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(f.hash[a, w, k])],
            ["anchor", "anchor_hash", "w", "score", "id", "hash"],
        )

    def opened(parts):
        """The state of a tile from its anchors' batches."""
        values = np.concatenate([matrix(p.column(6), width) for p in parts])
        get = lambda k: np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])
        ids = np.concatenate([p.column(3).fill_null(NO_ID).to_numpy() for p in parts])
        null = np.concatenate([np.asarray(p.column(3).is_null()) for p in parts])
        n, big = len(ids), np.iinfo(np.int64).max
        if same:
            floors, ceilings = np.full((n, 1), -big), np.full((n, 1), big)
        else:
            marks = [m for p in parts for m in p.column(7).to_pylist()]
            windows = max(map(len, marks))
            floors, ceilings = np.full((n, windows), big), np.full((n, windows), -big)
            for k, m in enumerate(marks):
                ceilings[k, : len(m)] = m
                # the smallest score with share * mark <= 100 * score is above the floor
                floors[k, : len(m)] = [-(-share[0] * x // share[1]) - 1 for x in m]
        return {"anchors": Anchors(values, primes), "id": ids, "null": null, "hash": get(5), "label": get(4), "firsts": Firsts(floors, ceilings, most), "last": (None, None)}

    def score(held, part):
        ids, hashes, labels = part.column(3).fill_null(NO_ID).to_numpy(), part.column(5).to_numpy(), part.column(4).to_numpy()
        # repeats of a row follow it
        fresh = np.r_[(ids[0], hashes[0]) != held["last"], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]
        held["last"] = (ids[-1], hashes[-1])
        ids, hashes, labels = ids[fresh], hashes[fresh], labels[fresh]
        values = matrix(part.column(6), width)[fresh]
        for at in range(0, len(held["id"]), BLOCK):
            to = slice(at, min(at + BLOCK, len(held["id"])))
            s = held["anchors"].scores(values, to)
            equal = held["label"][to][:, None] == labels[None, :]
            if same:
                equal &= (held["hash"][to][:, None] != hashes[None, :]) | (held["id"][to][:, None] != ids[None, :])
            held["firsts"].take(to, s, equal if same else ~equal, ids, hashes)

    def run(batches):
        tile, waiting, held = None, [], None
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            change = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])])
            for s, e in zip(change, np.r_[change[1:], batch.num_rows]):
                if (keys[0][s], keys[1][s]) != tile:
                    yield from flush(held)
                    tile, waiting, held = (keys[0][s], keys[1][s]), [], None
                if keys[2][s] == 0:
                    waiting.append(batch.slice(s, e - s))
                    continue
                if waiting:
                    held, waiting = opened(waiting), []
                for k in range(s, e if held else s, BATCH):
                    score(held, batch.slice(k, min(BATCH, e - k)))
        yield from flush(held)

    return tiled.select(*columns).mapInArrow(run, FOUND)


def best(found: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first rows of all tiles by (score descending, id, hash), with their ``rank``; a repeated row counts once."""
    w = Window.partitionBy("anchor", "anchor_hash", *keys).orderBy(F.desc("score"), F.col("id").isNull(), "id", "hash")
    return found.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= most).dropDuplicates(["anchor", "anchor_hash", *keys, "rank"])


def mine(rows: DataFrame, anchor: Column, vector: str = "embedding", row_id: str = "vec_id", label: str | Column = "label", *, scale: float = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component counts as ``floor(scale * x)`` and a score is the inner product of
    those.  ``anchor`` says which rows are anchors, from the id (``id``) and ``label``.  An anchor's
    positives are its first other rows of its label; a positive's negatives are the
    first rows of other labels with ``share[0] * positive <= share[1] * negative <=
    share[1] * positive``, which no negative of a positive below 0 meets.  Higher
    scores come first, ties by smaller id, null ids last.

    Rows without label or vector, or with a null or non-finite component, take no
    part.  Rows that repeat id, label and vector count once; rows that share only an
    id are told apart.  A shorter vector counts as if filled up with zeros.  Anchors without
    positives, positives without negatives and empty tables give no rows.  Components
    so large that a score might pass 2^56 are an error.  Other columns are not read.
    """
    kept = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("x"), (label if isinstance(label, Column) else F.col(label)).alias("label"))
    all_rows = materialised(prepared(kept, "x", "id", "label", scale))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    size = all_rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("v")).alias("width"), F.count_if(anchor).alias("anchors")).first()
    bound = int((size["norm"] or 0.0) * (1 + 1e-9)) + 1
    if bound > MOST_SCORE:
        raise ValueError(f"scores of up to {bound} do not fit")
    primes, width = primes_for(bound), max(size["width"] or 0, 1)
    anchors = materialised(all_rows.filter(anchor).dropDuplicates(["id", "hash"]))
    near = best(firsts(tiles(anchors, all_rows, max(size["anchors"], 1), size["n"]), width, primes, positives, True, share), positives)
    near = materialised(near.select("anchor", "anchor_hash", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    marks = near.groupBy("anchor", "anchor_hash").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("marks"))
    marked = anchors.join(marks.hint("merge"), anchors["id"].eqNullSafe(marks["anchor"]) & (anchors["hash"] == marks["anchor_hash"])).drop("anchor", "anchor_hash")
    hits = best(firsts(tiles(marked, all_rows, max(size["anchors"], 1), size["n"]), width, primes, negatives, False, share), negatives, "w")
    hits = hits.select("anchor", "anchor_hash", (F.col("w") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    left, right = near.alias("p"), hits.alias("n")
    same = F.col("p.anchor").eqNullSafe(F.col("n.anchor")) & (F.col("p.anchor_hash") == F.col("n.anchor_hash")) & (F.col("p.place") == F.col("n.place"))
    out = materialised(left.join(right.hint("merge"), same).select(F.col("p.anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    drop_written(all_rows, anchors, near)
    return out
