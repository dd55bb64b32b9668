"""Quality scores by Bradley-Terry pairwise ranking."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, refuse_clash, text_bytes, text_lengths, text_slices, word_hashes
from lodestone.operators.stats import cumulative

FEATURES = ["log_words", "word_len", "upper", "digit", "other_ascii", "pipe", "marks", "stops", "wide", "distinct", "next_same", "lines", "dup_lines", "short_lines", "symbol_words"]


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts are all zero."""
    data, offsets = text_bytes(col)
    n = np.maximum(text_lengths(col), 1).astype(float)

    def count(mask):
        total = np.r_[0, np.cumsum(mask)]
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def among(chars):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    words, starts = word_hashes(data)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at).astype(float)
    some = np.maximum(n_words, 1)
    same = np.r_[words[1:] == words[:-1], False] if len(words) else np.zeros(0, bool)
    same = np.r_[0, np.cumsum(same)]
    last = np.maximum(at[1:] - 1, at[:-1])  # a text's last word is not held against the next text's first
    chars = count((data != 32) & (data != 10))
    distinct = np.array([len(np.unique(words[s:e])) for s, e in zip(at[:-1], at[1:])], float)
    breaks = np.flatnonzero(data == 10)
    lines, dups, short = np.zeros((3, len(n)))
    sums = np.r_[0, np.cumsum(words, dtype=np.uint64)]
    by_line = np.searchsorted(starts, breaks)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(n) + 1))
    for i in np.flatnonzero(np.diff(first)):
        edge = np.r_[at[i], by_line[first[i] : first[i + 1]], at[i + 1]]
        size = np.diff(edge)
        keys = (sums[edge[1:]] - sums[edge[:-1]])[size > 0]
        lines[i], dups[i], short[i] = len(keys), len(keys) - len(np.unique(keys)), np.count_nonzero(size == 1)
    lines = np.maximum(lines, 1)
    upper, symbols = count((data >= 65) & (data <= 90)), among(b"#*$%&|<>~^_=+\\{}[]@")
    marked = symbols & np.r_[symbols[1:], False]
    out = np.stack([
        np.log1p(n_words), chars / some / 10, upper / n, count((data >= 48) & (data <= 57)) / n, count(among(b"\"'()/:;-")) / n, count(data == 124) / some,
        count(marked) / some, count(among(b".,!?")) / some, count(data >= 128) / n, distinct / some, (same[last] - same[at[:-1]]) / some,
        np.log1p(lines) / np.log(np.e + n_words), dups / lines, short / lines, count(symbols) / some,
    ], axis=1)
    return out * (n_words > 0)[:, None]


PAIRS = 16_384  # preference pairs at least, if the classes have as many


def partners(larger: int, smaller: int) -> tuple[int, int]:
    """How many of the smaller class each document of the larger one is held against, and how far apart those are.

    Number i of the larger class is held against ``i``, ``i + step``, ... of the smaller one,
    counted in a circle, so each document of both is in a pair at least.
    """
    each = min(smaller, max(1, -(-PAIRS // larger)))
    return each, smaller // each


def pair_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of preference pairs, rows ``x_good - x_bad``: count, loss, gradient and second derivatives, one after another.

    The loss of a pair is ``log(1 + exp(-(x_good - x_bad) . w))``.
    """
    z = x @ w
    p = 1 / (1 + np.exp(np.clip(z, -30, 30)))
    return np.r_[len(x), np.logaddexp(0, -z).sum(), -(x * p[:, None]).sum(0), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]


def bradley_terry(sums, width: int, *, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights of least mean loss and ``ridge / 2`` times their squares, by Newton's steps; ``sums(w)`` gives ``pair_sums`` of all pairs.

    A step that would raise the loss is halved.  Weights are rounded to 9 places, so
    they do not depend on the order of sums.
    """

    def at(w):
        s = sums(w)
        return s[1] / s[0] + ridge / 2 * w @ w, s[2 : 2 + width] / s[0] + ridge * w, s[2 + width :].reshape(width, width) / s[0] + ridge * np.eye(width)

    w = np.zeros(width)
    loss, g, h = at(w)
    for _ in range(steps):
        step = np.linalg.solve(h, g)
        if np.abs(step).max() < 1e-10:
            break
        new = at(w - step)
        while new[0] > loss + 1e-12 and np.abs(step).max() >= 1e-10:
            step = step / 2
            new = at(w - step)
        w, (loss, g, h) = w - step, new
    return np.round(w, 9)


def rank(good: np.ndarray, bad: np.ndarray, *, ridge: float = 1e-3):
    """Mean, deviation and weights by which good documents outrank bad ones, of features at hand; ``fit`` does the same in tasks."""
    both = np.r_[good, bad]
    mean, sd = both.mean(0), both.std(0) + 1e-6
    each, step = partners(max(len(good), len(bad)), min(len(good), len(bad)))
    i = np.repeat(np.arange(max(len(good), len(bad))), each)
    j = (i + np.tile(np.arange(each) * step, len(i) // each)) % min(len(good), len(bad))
    x = (good[i] - bad[j] if len(good) >= len(bad) else good[j] - bad[i]) / sd
    return mean, sd, bradley_terry(lambda w: pair_sums(x, w), x.shape[1], ridge=ridge)


def first_by_hash(ids: DataFrame, most: int, total: int) -> DataFrame:
    """At most ``most`` of about ``total`` ids ``_id``, in order of their hashes.

    Hashes beyond twice the expected share are left out before the sort, so no more
    than a few times ``most`` rows are sorted, however many there are.
    """
    h = ids.withColumn("h", F.xxhash64("_id"))
    share = min(1.0, 2.0 * most / max(total, 1))
    if share < 1:
        h = h.filter(F.col("h") < int((share - 0.5) * 2.0**64))
    return h.orderBy("h", "_id").limit(most).drop("h")


def labelled(docs: DataFrame, labels: DataFrame, train: Column, text: str, doc_id: str, label: str) -> DataFrame:
    """(_id, x, y, h): features of every document with a label that ``train`` takes in.

    Features are made before the join, so texts do not move.
    """
    y = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & train)
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(F.col("_id").isNotNull() & train)

    def run(batches):
        for part in text_slices(batches):
            x = features(part.column(part.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "x"])

    rows = d.mapInArrow(run, f"_id {d.schema['_id'].dataType.simpleString()}, x array<double>")
    return rows.join(y.hint("merge"), "_id").withColumn("h", F.xxhash64("_id"))


def pairs_of(rows: DataFrame, n: dict) -> DataFrame:
    """(x): for each preference pair the good document's features less the bad one's.

    Documents of a class are numbered in order of hashed ids, by sums over ranges.
    """
    numbered = materialised(cumulative(rows, ["y"], [F.col("h"), F.col("_id"), F.col("x")], out="at"))
    big = int(n[1] >= n[0])
    each, step = partners(n[big], n[1 - big])
    k = F.explode(F.sequence(F.lit(0), F.lit(each - 1)))
    larger = numbered.filter(F.col("y") == big).select(F.col("x").alias("x1"), "at", k.alias("k")).select("x1", ((F.col("at") + F.col("k") * step) % n[1 - big]).alias("at"))
    smaller = numbered.filter(F.col("y") == 1 - big).select("at", F.col("x").alias("x2"))
    apart = F.zip_with("x1", "x2", (lambda a, b: a - b) if big else (lambda a, b: b - a))
    out = materialised(larger.join(smaller.hint("merge"), "at").select(apart.alias("x")))
    drop_written(numbered)
    return out


def best_cut(scores: DataFrame) -> tuple[float, float]:
    """The cut of (s, y) that errs least, the lowest of several, and the share of scores below it.

    It lies half-way between two scores.  Errors are running sums over the distinct scores, made by ranges.
    """
    each = scores.groupBy("s").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(-1)).alias("up"), F.count("*").alias("c"))
    each = materialised(cumulative(each, [], [F.col("s")], F.col("up"), "below"))
    # a cut just below a score turns down what is before it; one beyond the last turns down all
    best = each.agg(F.min(F.struct("below", "s")).alias("b"), F.sum("up").alias("every"), F.max("s").alias("top")).first()
    hi = best["b"]["s"] if best["b"]["below"] <= best["every"] else None
    under = each if hi is None else each.filter(F.col("s") < hi)
    below = under.agg(F.max("s").alias("lo"), F.sum("c").alias("n")).first()
    total = each.agg(F.sum("c")).first()[0]
    drop_written(each)
    if hi is None:
        return best["top"] + 1e-6, 1.0
    return (hi + (below["lo"] if below["lo"] is not None else hi)) / 2, (below["n"] or 0) / total


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> dict:
    """A model from all labelled documents.

    ``train`` is a condition on the id, here called ``_id``; labels that it does not
    take in are not looked at.  Without both classes every text scores 0.5.
    Only sums over tasks reach the driver.  Every document is in a preference pair at
    least, and where the classes are small in many or all, see ``partners``.  The threshold
    lies between those scores where the labelled documents err least; the sigmoid is
    centred there.
    """
    rows = materialised(labelled(docs, labels, train, text, doc_id, label))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    width = len(FEATURES)
    if len(n) < 2:
        drop_written(rows)
        return {"mean": np.zeros(width), "sd": np.ones(width), "w": np.zeros(width), "cut": 0.0, "scale": 1.0}
    at = rows.agg(*[f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(width)]).first()
    mean, sd = np.round(np.array(at[:width]), 12), np.round(np.array(at[width:]), 12) + 1e-6
    pairs = pairs_of(rows, n)

    def sums(w):
        def run(batches):
            s = np.zeros(2 + width + width * width)
            for part in batches:
                if part.num_rows:
                    s = s + pair_sums(np.asarray(part.column(0).flatten()).reshape(-1, width) / sd, w)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.list_(pa.float64()))], ["s"])

        # one row a task
        return np.sum([r["s"] for r in pairs.mapInArrow(run, "s array<double>").collect()], axis=0)

    w = bradley_terry(sums, width)

    def scored(batches):
        for part in batches:
            if part.num_rows:
                x = np.asarray(part.column(0).flatten()).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(((x - mean) / sd) @ w, 12)), part.column(1)], ["s", "y"])

    scores = materialised(rows.select("x", "y").mapInArrow(scored, "s double, y int"))
    cut, quantile = best_cut(scores)
    spread = round(scores.agg(F.stddev_pop("s")).first()[0], 9)
    drop_written(rows, pairs, scores)
    return {"mean": mean, "sd": sd, "w": w, "cut": float(cut), "scale": float(4 / (spread + 1e-9)), "quantile": quantile}


def score(docs: DataFrame, model: dict, text: str = "text", keep=()) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` of every whole text, in one pass without a shuffle.

    Null and empty texts have the score of all-zero features; repeated rows get
    equal scores; an empty table gives no rows.  Columns of ``keep`` must not have one
    of the result's names.
    """
    d = docs.select(F.col(text).alias("_text"), *keep)
    refuse_clash(d.columns[1:], "_text", "score", "predicted")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:]]

    def run(batches):
        for part in text_slices(batches, "_text"):
            s = ((features(part.column(0)) - model["mean"]) / model["sd"]) @ model["w"]
            p = 1 / (1 + np.exp(-np.clip((s - model["cut"]) * model["scale"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*part.schema.names[1:], "score", "predicted"])

    return d.mapInArrow(run, ", ".join([*kinds, "score double, predicted int"]))
