"""Language identification by interpolated Kneser-Ney character models.

Words are runs of letters (with their combining marks), lower-cased.  Each symbol of
a word and the boundary behind it are predicted from up to three before it.  Counts
of four-symbol grams, and from them the numbers of different symbols before and
behind each shorter gram, are Spark aggregates over all training rows.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import lookup
from lodestone.llm.common import ODD, drop_written, materialised, mix, refuse_clash, span_hashes, text_slices

ORDER = 4
SLICE = 2 << 20  # bytes of text that are scored together
HELD = 1 << 20  # grams of a language that a task counts together
CELLS = 1 << 22  # values of grams, one a language, that are shipped to tasks
SYMBOLS = [f"s{k}" for k in range(ORDER)]  # s0 is predicted, s1 stands before it, and so on

_tables: list[np.ndarray] = []


def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (0: no part of a word), and whether it is a letter; built once in a process."""
    if not _tables:
        code, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                code[c], letter[c] = ord(x.lower()[0]), True
            elif c > 0x2FF and unicodedata.category(x)[0] == "M":
                code[c] = c
        _tables.extend((code, letter))
    return _tables[0], _tables[1]


class Words:
    """The words of some texts: which are distinct, and the symbols of those."""

    def __init__(self, col: pa.Array):
        texts = [x or "" for x in col.to_pylist()]
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        code, letter = symbol_table()
        s = code[points]
        word = s > 0
        start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        end = np.flatnonzero(~word & np.r_[False, word[:-1]])
        total = np.r_[0, np.cumsum(letter[points])]
        edges = np.r_[0, ends]
        #: letters of each text, and where its words begin in ``index`` (and the end)
        self.letters = total[edges[1:]] - total[edges[:-1]]
        self.at = np.searchsorted(start, edges)
        _, first, self.index = np.unique(span_hashes(s, start, end), return_index=True, return_inverse=True)
        start, size = start[first], (end - start)[first] + 1
        #: of the distinct words: how many symbols each has with its boundary, and where they begin in ``gram``
        self.size, self.begin = size, np.r_[0, np.cumsum(size)]
        place = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], size)
        here = np.repeat(start, size) + place
        symbols = [np.where(place >= k, s[np.maximum(here - k, 0)], 0) for k in range(ORDER)]
        #: the distinct grams, and which one stands at each symbol
        _, first, self.gram = np.unique(gram_hash(symbols), return_index=True, return_inverse=True)
        self.grams = [x[first] for x in symbols]


def gram_hash(symbols: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each gram, given as arrays from its last symbol backwards."""
    h = np.zeros(len(symbols[0]), np.uint64)
    for s in symbols:
        h = mix(h * ODD + s.astype(np.uint64) + np.uint64(1))
    return h


def compact(parts: list) -> tuple[list[np.ndarray], np.ndarray]:
    symbols, n = [np.concatenate([p[0][k] for p in parts]) for k in range(ORDER)], np.concatenate([p[1] for p in parts])
    _, at, index = np.unique(gram_hash(symbols), return_index=True, return_inverse=True)
    return [s[at] for s in symbols], np.bincount(index, weights=n, minlength=len(at)).astype(np.int64)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, s0 to s3, n): counts of grams over all rows with text and language."""
    d = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def run(batches):
        held: dict[str, list] = {}
        for part in text_slices(batches, most=SLICE):
            langs = np.array(part.column(1).to_pylist())
            w = Words(part.column(0))
            owner = np.repeat(langs, np.diff(w.at))
            for x in np.unique(langs):
                uses = np.bincount(w.index[owner == x], minlength=len(w.size))
                n = np.bincount(w.gram, weights=np.repeat(uses, w.size), minlength=len(w.grams[0])).astype(np.int64)
                own = held.setdefault(str(x), [])
                own.append(([s[n > 0] for s in w.grams], n[n > 0]))
                if sum(len(p[1]) for p in own) > HELD:
                    held[str(x)] = [compact(own)]
                    # a table that stays large leaves the task as it is
                    if len(held[str(x)][0][1]) > HELD // 2:
                        yield batch(str(x), held.pop(str(x)))
        for x, own in held.items():
            yield batch(x, own)

    def batch(x, own):
        symbols, n = compact(own)
        return pa.RecordBatch.from_arrays([pa.array([x] * len(n), pa.string()), *[pa.array(s.astype(np.int32)) for s in symbols], pa.array(n)], ["lang", *SYMBOLS, "n"])

    rows = d.mapInArrow(run, "lang string, s0 int, s1 int, s2 int, s3 int, n long")
    return rows.groupBy("lang", *SYMBOLS).agg(F.sum("n").alias("n"))


def budgets(sizes: dict[str, int], most: int) -> dict[str, int]:
    """``most`` shared out: what a language does not need goes to the others in equal parts."""
    out, left = {}, most
    for k, x in enumerate(sorted(sizes, key=sizes.get)):
        out[x] = min(sizes[x], left // (len(sizes) - k))
        left -= out[x]
    return out


def frequent(rows: DataFrame, n: str, most: int) -> DataFrame:
    """The rows, or if they are over ``most``, of each language those with its largest ``n`` within its budget."""
    level = F.floor(4 * F.log2(F.col(n))).cast("int")
    sizes: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", level.alias("level")).count().collect():  # some hundred rows a language at most
        sizes.setdefault(r["lang"], {})[r["level"]] = r["count"]
    if sum(sum(x.values()) for x in sizes.values()) <= most:
        return rows
    share = budgets({x: sum(s.values()) for x, s in sizes.items()}, most)
    lowest = {}
    for x, s in sizes.items():
        levels = sorted(s, reverse=True)
        kept = [v for v, t in zip(levels, np.cumsum([s[v] for v in levels])) if t <= share[x]]
        lowest[x] = min(kept, default=1 << 20)
    return rows.filter(level >= lookup(F.col("lang"), lowest, 1 << 20))


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in a sorted array; its length where there is none."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, len(keys))


def log_probabilities(model: dict, symbols: list[np.ndarray], order: int = ORDER) -> np.ndarray:
    """Of each gram's last symbol after those before it: a row a gram, a column a language.

    A gram that a language has not seen gets its context's share for unseen symbols
    times the probability after the shorter context.
    """
    out = np.full((len(symbols[0]), len(model["langs"])), model["uniform"])
    for k in range(1, order + 1):
        keys, seen = model["grams"][k - 1]
        value = seen[find(keys, gram_hash(symbols[:k]))]
        if k > 1:
            keys, rest = model["contexts"][k - 1]
            rest = rest[find(keys, gram_hash(symbols[1:k]))]
        else:
            rest = model["contexts"][0][1]
        out = np.where(np.isnan(value), rest + out, value)
    return out


def table(h: np.ndarray, j: np.ndarray, value: np.ndarray, n_langs: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and a row of values for each with a column a language; the last row is for other hashes."""
    keys, at = np.unique(h, return_inverse=True)
    out = np.full((len(keys) + 1, n_langs), missing, np.float32)
    out[at, j] = value
    return keys, out


def drawn(share: np.ndarray, symbols: np.ndarray, words: int = 4000, seed: int = 11) -> list[np.ndarray]:
    """Grams of words whose symbols are drawn one by one from a language's own letters, in whatever order those come."""
    draw, order = np.random.default_rng(seed), np.argsort(symbols)
    s = draw.choice(symbols[order], size=words * 6, p=share[order]).reshape(words, 6)
    s = np.c_[s, np.zeros(words, s.dtype)]
    return [np.c_[np.zeros((words, k), s.dtype), s[:, : s.shape[1] - k]].ravel() for k in range(ORDER)]


def noise(model: dict, share: np.ndarray, symbols: np.ndarray, j: int) -> float:
    """Cross-entropy of such words under the language's model."""
    return float(-log_probabilities(model, drawn(share, symbols))[:, j].mean())


def by_language(values: dict) -> Column:
    return lookup(F.col("lang"), values)


def spread(orders: list, langs: list[str], most: int) -> dict:
    """The model of all grams as tables, of which none is shipped: of each order (gram, ``seen``) and (context, ``rest``).

    ``seen`` and ``rest`` are maps from a language's number to a log-probability and to the log
    of the share for unseen symbols, of the languages that have the gram or the context.
    """
    number = by_language({x: j for j, x in enumerate(langs)})
    model: dict = {"langs": langs, "most": most, "tables": []}
    logs = lambda key, x: F.map_from_entries(F.collect_list(F.struct(number.alias("j"), F.log(x).alias("x"))))
    for k, rows in reversed(orders):
        few = {r["lang"]: (r["n1"], r["n2"]) for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discount = by_language({x: n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for x, (n1, n2) in few.items()})
        context = ["lang", *SYMBOLS[1:k]]
        behind = rows.groupBy(*context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        behind = materialised(behind.withColumn("share", discount * F.col("kinds") / F.greatest("total", F.lit(1))))
        g = rows.join(behind.hint("merge"), context)
        if k == 1:
            model["uniform"] = -float(np.log(rows.select("s0").distinct().count() + 1))
            shares = {r["lang"]: r["share"] for r in behind.collect()}  # one row a language
            model["first"] = [float(np.log(shares[x])) + model["uniform"] for x in langs]
            g = g.withColumn("lower", F.lit(float(np.exp(model["uniform"]))))
        else:
            # a gram without its first symbol is one of the shorter ones
            g = g.join(lower.hint("merge"), ["lang", *SYMBOLS[: k - 1]])
        less = F.col("share") * F.col("lower")
        g = materialised(g.select("lang", *SYMBOLS[:k], "n", "total", less.alias("less"), (F.greatest(F.col("n") - discount, F.lit(0)) / F.col("total") + less).alias("p")))
        seen = materialised(g.groupBy(*SYMBOLS[:k]).agg(logs("seen", F.col("p")).alias("seen")))
        rest = materialised(behind.groupBy(*SYMBOLS[1:k]).agg(logs("rest", F.col("share")).alias("rest"))) if k > 1 else None
        drop_written(behind, *([last] if k > 1 else []))
        model["tables"].append((seen, rest))
        last, lower = g, g.select("lang", *SYMBOLS[:k], F.col("p").alias("lower"))
        if k == 1:
            letters = materialised(g.filter("s0 > 0").select("lang", "s0", "n"))
    once = F.greatest(F.col("n") - 1 - discount, F.lit(0)) / F.greatest(F.col("total") - 1, F.lit(1)) + F.col("less")
    lp = F.log(F.greatest(once, F.lit(1e-300)))
    own = {r["lang"]: r for r in last.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(-F.col("n") * lp).alias("h"), F.sum(F.col("n") * lp * lp).alias("h2")).collect()}
    drop_written(last)

    def draw(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy().astype(float)
        grams, times = np.unique(np.stack(drawn(n / n.sum(), t.column("s0").to_numpy())), axis=1, return_counts=True)
        return pa.table([pa.array([t.column("lang")[0].as_py()] * len(times)), *[pa.array(s.astype(np.int32)) for s in grams], pa.array(times)], names=["lang", *SYMBOLS, "n"])

    random = materialised(letters.groupBy("lang").applyInArrow(draw, "lang string, s0 int, s1 int, s2 int, s3 int, n long"))
    at = F.col("n") * F.get("v", number)
    apart = {r["lang"]: r["h"] for r in random.join(values(model, random).hint("merge"), SYMBOLS).groupBy("lang").agg((-F.sum(at) / F.sum("n")).alias("h")).collect()}
    drop_written(random, letters)
    mean = np.array([own[x]["h"] / own[x]["n"] for x in langs])
    model["sd"] = np.sqrt(np.maximum(np.array([own[x]["h2"] / own[x]["n"] for x in langs]) - mean**2, 0))
    model["limit"] = np.array([(m + apart[x]) / 2 if x in apart else np.inf for m, x in zip(mean, langs)])
    return model


def values(model: dict, grams: DataFrame) -> DataFrame:
    """(s0 to s3, v): of distinct grams the log-probability of the last symbol in each language, by the tables of all grams."""
    v = None
    for k, (seen, rest) in enumerate(model["tables"], 1):
        g = grams.select(*SYMBOLS[:k]).distinct().join(seen.hint("merge"), SYMBOLS[:k], "left")
        if k == 1:
            shorter = F.array(*[F.lit(x) for x in model["first"]])
        else:
            g = g.join(v.hint("merge"), SYMBOLS[: k - 1]).join(rest.hint("merge"), SYMBOLS[1:k], "left")
            shorter = F.transform("v", lambda x, j: x + F.coalesce(F.try_element_at("rest", j), F.lit(0.0)))
        v = g.select(*SYMBOLS[:k], F.transform(shorter, lambda x, j: F.coalesce(F.try_element_at("seen", j), x)).alias("v"))
    return v


def with_rest(d: DataFrame, model: dict) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Hashes and values of the most frequent grams of ``_text``, and ``_rest``: for each text the sums of all others.

    Each gram has its value by all grams of the model.  Those that are not shipped are
    joined, one short row a text and gram; rows with equal texts share their sums.
    """
    grams = materialised(counts(d.withColumn("_any", F.lit("")), "_text", "_any"))
    v = materialised(values(model, grams).join(grams.hint("merge"), SYMBOLS))
    width = len(model["langs"])
    kept = frequent(v, "n", min(model["most"], CELLS // width)).select(*SYMBOLS, "v").toArrow()
    h = gram_hash([kept.column(s).to_numpy().astype(np.int64) for s in SYMBOLS])
    order = np.argsort(h)
    keys = h[order]
    seen = kept.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order].astype(np.float32) if len(h) else np.zeros((0, width), np.float32)
    if len(keys) == v.count():
        drop_written(grams, v)
        return d.withColumn("_rest", F.lit(None).cast("array<double>")), keys, seen
    key = ["_h1", "_h2"]
    d = d.withColumns({c: F.xxhash64(F.lit(c), "_text") for c in key})

    def run(batches):
        for part in text_slices(batches, "_text", SLICE):
            w = Words(part.column(0))
            if not len(w.size):
                continue
            new = find(keys, gram_hash(w.grams)) == len(keys)
            has = np.logical_or.reduceat(new[w.gram], w.begin[:-1])[w.index]
            doc, word = np.repeat(np.arange(len(w.letters)), np.diff(w.at))[has], w.index[has]
            size = w.size[word]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            doc, gram = np.repeat(doc, size), w.gram[np.repeat(w.begin[word], size) + place]
            pair, n = np.unique((doc * len(new) + gram)[new[gram]], return_counts=True)
            doc, gram = pair // len(new), pair % len(new)
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(doc)) for c in (1, 2)], *[pa.array(s[gram].astype(np.int32)) for s in w.grams], pa.array(n)], [*key, *SYMBOLS, "n"])

    rest = d.select("_text", *key).mapInArrow(run, "_h1 long, _h2 long, s0 int, s1 int, s2 int, s3 int, n long")
    rest = rest.repartition(*SYMBOLS).dropDuplicates([*key, *SYMBOLS])
    sums = rest.join(v.select(*SYMBOLS, "v").hint("merge"), SYMBOLS).select(*key, "n", F.posexplode("v").alias("j", "x")).groupBy(*key, "j").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    sums = materialised(sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("_rest")))
    drop_written(grams, v)
    return d.join(sums.hint("merge"), key, "left").drop(*key), keys, seen


def drop_tables(model: dict) -> None:
    """Deletes the tables of a model that no longer predicts."""
    drop_written(*[t for pair in model.get("tables", []) for t in pair if t is not None])


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", *, most_languages: int = 500, most_grams: int = 1 << 20, whole: bool = False) -> dict:
    """One model a language from the counts of all training rows.

    Interpolated Kneser-Ney: the longest grams have their counts, shorter ones the
    number of different symbols before them; each order is discounted by
    ``n1 / (n1 + 2 n2)`` and mixed with the next shorter one, and the shortest with a
    uniform distribution.  The model is, for each order, a sorted array of hashes and
    a row of log-probabilities (or shares for unseen symbols) for each.

    Statistics are over all rows.  What is shipped to tasks is bounded: ``most_grams`` of
    each order, shared out among languages so that a small one keeps all of its
    grams, and more languages than ``most_languages`` are an error.  Of a language
    that has more, the most frequent are kept, with their probabilities; what the others
    had goes to their context's share for shorter grams, so probabilities still
    add up to one.

    With ``whole`` no gram is left out: where there are more than ``most_grams``, the model is
    tables in the shared folder (see ``spread``), and texts are scored by joins.

    A text is rejected from half-way between a language's own entropy and that of
    its letters drawn one by one.  The own entropy is of grams left out one at a time:
    each use is predicted from all others, so that what is seen in training only
    does not make a small language look surer than it is.
    """
    top = materialised(counts(docs.filter(train), text, lang))
    langs = [r["lang"] for r in top.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    where = {x: j for j, x in enumerate(langs)}
    orders, rows = [], top
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            rows = rows.groupBy("lang", *SYMBOLS[:k]).agg(F.count("*").alias("n"))
        orders.append((k, rows))
    if whole and top.count() > most_grams:
        model = spread(orders, langs, most_grams)
        drop_written(top)
        return model
    model: dict = {"langs": langs, "grams": [], "contexts": [], "uniform": 0.0}
    own = np.zeros((3, len(langs)))
    for k, rows in reversed(orders):
        behind = rows.groupBy("lang", *SYMBOLS[1:k]).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        grams = frequent(rows, "n", most_grams).toPandas()
        behind = frequent(behind, "total", most_grams).toPandas()
        few = {r["lang"]: (r["n1"], r["n2"]) for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discount = np.array([n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for n1, n2 in (few[x] for x in langs)])
        j, at = grams["lang"].map(where).to_numpy(np.int64), behind["lang"].map(where).to_numpy(np.int64)
        symbols = [grams[s].to_numpy(np.int64) for s in SYMBOLS[:k]]
        rest = discount[at] * behind["kinds"].to_numpy(float) / np.maximum(behind["total"].to_numpy(float), 1)
        total = np.zeros((1 if k == 1 else 0, len(langs)))
        if k == 1:
            model["uniform"] = -float(np.log(len(np.unique(symbols[0])) + 1))
            model["contexts"].append((None, np.log(np.bincount(at, weights=rest, minlength=len(langs)))))
            total = np.bincount(at, weights=behind["total"], minlength=len(langs))[j]
            share = np.exp(model["contexts"][0][1])[j]
        else:
            h = gram_hash([behind[s].to_numpy(np.int64) for s in SYMBOLS[1:k]])
            model["contexts"].append(table(h, at, np.log(rest), len(langs), 0.0))
            keys, sums = table(h, at, behind["total"].to_numpy(float), len(langs), np.nan)
            here = find(keys, gram_hash(symbols[1:]))
            total = sums[here, j]
            share = np.exp(model["contexts"][-1][1][here, j])
        lower = np.exp(log_probabilities(model, symbols, k - 1)[np.arange(len(j)), j])
        n = grams["n"].to_numpy(float)
        p = np.maximum(n - discount[j], 0) / total + share * lower
        known = ~np.isnan(total)
        # what is left for shorter grams: all that the kept ones do not have
        at_context = np.zeros(len(j), np.int64) if k == 1 else here
        left = np.ones((2, 1 if k == 1 else len(keys) + 1, len(langs)))
        np.subtract.at(left[0], (at_context[known], j[known]), p[known])
        np.subtract.at(left[1], (at_context[known], j[known]), lower[known])
        old = model["contexts"][-1][1]
        new = np.log(np.maximum(left[0], 1e-12) / np.maximum(left[1], 1e-12)).reshape(old.shape)
        touched = np.zeros(left[0].shape, bool)
        touched[at_context[known], j[known]] = True
        # a context of which no gram is kept leaves all to shorter ones
        new = np.where(touched.reshape(old.shape), np.where(left[1].reshape(old.shape) > 1e-6, np.maximum(new, old), old), 0.0 if k > 1 else old)
        model["contexts"][-1] = (model["contexts"][-1][0], new.astype(old.dtype))
        model["grams"].append(table(gram_hash(symbols)[known], j[known], np.log(p[known]), len(langs), np.nan))
        if k == 1:
            letters = symbols[0], j, grams["n"].to_numpy(float)
        if k == ORDER:
            # each use left out once: its gram has a use less
            once = np.where(known, np.maximum(n - 1 - discount[j], 0) / np.maximum(total - 1, 1) + share * lower, lower)
            lp = np.log(np.maximum(once, 1e-300))
            own = np.stack([np.bincount(j, weights=x, minlength=len(langs)) for x in (n, -n * lp, n * lp * lp)])
            # uses of grams that are not kept cost about what the rarest kept ones cost by shorter grams
            every = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
            by_shorter = np.log(np.maximum(lower, 1e-300)) + (np.where(known, new[at_context, j], 0.0) if len(j) else 0.0)
            for x in range(len(langs)):
                mine, w = j == x, every[langs[x]] - own[0, x]
                if w > 0 and mine.any():
                    rare = mine & (n <= 2 * n[mine].min())
                    own[:, x] += w * np.array([1.0, -by_shorter[rare].mean(), (by_shorter[rare] ** 2).mean()])
    drop_written(top)
    mean = own[1] / np.maximum(own[0], 1)
    model["sd"] = np.sqrt(np.maximum(own[2] / np.maximum(own[0], 1) - mean**2, 0))
    model["limit"] = np.zeros(len(langs))
    for x in range(len(langs)):
        s, at, n = letters
        mine = (at == x) & (s > 0)
        model["limit"][x] = (mean[x] + noise(model, n[mine] / n[mine].sum(), s[mine], x)) / 2 if mine.any() else np.inf
    return model


def predict(docs: DataFrame, model: dict, text: str = "text", keep=(), *, z: float = 4.0) -> DataFrame:
    """Language of every whole text: ``lang_pred``, ``score``, ``cross_entropy``, ``rejected``, and ``keep``.

    The language of lowest cross-entropy per symbol wins; ties go to the first by
    name.  ``score`` is its share by ``exp(-n * entropy)`` with n at most 50, times
    how well it fits.  A text is rejected if it has no letter or its entropy is over
    the winner's limit by ``z`` deviations of a mean of its n symbols.

    ``und`` (score 0, rejected) for null texts, texts without a letter, or no training
    rows.  Rows that repeat get equal results; an empty table gives none.  Columns of
    ``keep`` must not have one of the result's names.
    """
    d = docs.select(F.col(text).alias("_text"), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:]]
    refuse_clash(d.columns[1:], "_text", "lang_pred", "score", "cross_entropy", "rejected")
    langs = np.array([*model["langs"], "und"], object)
    width = len(model["langs"])
    tables = "tables" in model
    if tables:
        d, keys, seen = with_rest(d, model)
        model = {"limit": model["limit"], "sd": model["sd"]}

    def sums(w):
        """Log-probability of each distinct word in each language, some grams at a time; what ``_rest`` has counts nothing."""
        step = max(1, (1 << 20) // max(width, 1))
        value = (lambda g: np.r_[seen, np.zeros((1, width), np.float32)][find(keys, gram_hash(g))]) if tables else (lambda g: log_probabilities(model, g))
        each = np.concatenate([value([s[a : a + step] for s in w.grams]) for a in range(0, len(w.grams[0]), step)] or [np.zeros((0, width))])
        out = np.zeros((len(w.size), width))
        if len(w.size):
            for j in range(width):
                out[:, j] = np.add.reduceat(each[:, j][w.gram], w.begin[:-1])
        return out

    def run(batches):
        for part in text_slices(batches, "_text", SLICE):
            w = Words(part.column(0))
            rest = np.array([x or [0.0] * width for x in part.column("_rest").to_pylist()]) if tables else None
            if tables:
                part = part.select(part.schema.names[:-1])
            n = np.r_[0, np.cumsum(w.size[w.index])]
            n = n[w.at[1:]] - n[w.at[:-1]]
            some = np.maximum(n, 1)
            known = (w.letters > 0) & (width > 0)
            best, score, low, reject = np.full(len(n), width), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
            if width:
                h, each = np.empty((len(n), width)), sums(w)
                for j in range(width):
                    total = np.r_[0.0, np.cumsum(each[:, j][w.index])]
                    h[:, j] = -(total[w.at[1:]] - total[w.at[:-1]] + (rest[:, j] if tables else 0)) / some
                best = np.where(known, h.argmin(1), width)
                low = np.where(known, h.min(1), 0)
                share = 1 / np.exp(-np.minimum(some, 50)[:, None] * (h - h.min(1, keepdims=True))).sum(1)
                over = low - np.r_[model["limit"], 0][best] - z * np.r_[model["sd"], 0][best] / np.sqrt(some)
                score = np.where(known, share * np.exp(-np.maximum(over, 0)), 0)
                reject = (over > 0) | ~known
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs[best], pa.string()), pa.array(score), pa.array(low), pa.array(reject)], [*part.schema.names[1:], "lang_pred", "score", "cross_entropy", "rejected"])

    return d.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, cross_entropy double, rejected boolean"]))
