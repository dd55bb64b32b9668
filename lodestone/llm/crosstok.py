"""Alignment of two tokenizers' tokens by their common byte offsets.

Both token lists of a text spell the same bytes.  The shorter list of end offsets
drives a galloping search (steps that double, then halving) into the longer one;
offsets at which tokens of both end cut the lists into groups, and differences of
their ranks say which tokens overlap.

Words are encoded once a task: at a single space between a visible ASCII character
and an ASCII letter no token of either kind goes on, so what stands between such
spaces is looked up in a bounded table (vocabularies where this does not hold are
refused, see ``Tokenizers``).
"""

import base64
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, text_slices
from lodestone.llm.packing import PATTERN

#: Between the parts of a text that are encoded apart.
CUT = re.compile("(?<=[!-~]) (?=[A-Za-z])")
MOST_PARTS = 1 << 17  # that a task remembers
MOST_IDS = 1 << 21  # of the parts that it remembers
SLICE = 1 << 19  # bytes of text aligned at once
LINKS = 1 << 18  # scored at once
MOST_PAIRS = 1 << 20  # counts of id pairs that are shipped to tasks
SPACE = "▁"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, then from start[1]."""
    total = int(size.sum())
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total) if total else np.zeros(0, np.int64)


class Tokenizers:
    """Encodes a space and a text by the rank file of a byte-level BPE (A), and the text by a piece model (B)."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.whole, self.json = None, os.path.splitext(ranks)[0] + ".json"
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError("pieces that go on after a space cannot be looked up word by word")
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_a[rank] = token
        self.bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace(SPACE, " ").encode() for n in names]
        self.sizes = [np.array([len(t) for t in b], np.int64) for b in (self.bytes_a, self.bytes_b)]
        self.forget()

    def forget(self) -> None:
        self.part: dict[str, int] = {}
        self.equal = np.zeros(0, bool)  # whether both spell the part
        #: of A and of B: ids of all parts, how many each has and where its first is
        self.flat = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # some versions panic on very long white space, which is no Exception
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def look_up(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts in this task's table, where new ones are entered."""
        new = [p for p in dict.fromkeys(parts) if p not in self.part]
        if new:
            spelt = [" " + p for p in new]
            wanted = [p.encode() for p in spelt]
            size = np.fromiter(map(len, wanted), np.int64, len(new))
            both, equal = ([self.encode_a(p) for p in spelt], self.model.encode(new, num_threads=1)), np.ones(len(new), bool)
            for k, (lists, table, sizes) in enumerate(zip(both, (self.bytes_a, self.bytes_b), self.sizes)):
                n = np.fromiter(map(len, lists), np.int64, len(new))
                ids = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
                total = np.r_[0, np.cumsum(sizes[ids])][np.cumsum(n)]
                # parts of right lengths that make the right whole are each right
                if not (total == np.cumsum(size)).all() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(wanted):
                    equal &= np.array([b"".join(map(table.__getitem__, x)) == w for x, w in zip(lists, wanted)])
                old, m, first = self.flat[k]
                self.flat[k] = np.r_[old, ids], np.r_[m, n], np.r_[first, len(old) + np.cumsum(n) - n]
            self.part.update(zip(new, range(len(self.equal), len(self.equal) + len(new))))
            self.equal = np.r_[self.equal, equal]
        return np.fromiter(map(self.part.__getitem__, parts), np.int64, len(parts))


def gallop(short: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in ``long[low:high]`` that is not below it, searched from ``guess`` on.

    All searches go on together: brackets double until they hold the place, then halve.
    """
    guess = np.minimum(guess, high - 1)
    up = long[guess] < short
    left, right = np.where(up, guess + 1, low), np.where(up, high, guess)
    step, todo = 1, np.arange(len(short))
    while len(todo):
        rising = up[todo]
        probe = np.where(rising, np.minimum(left[todo] + step, high[todo]) - 1, np.maximum(right[todo] - step, low[todo]))
        below = long[np.maximum(probe, 0)] < short[todo]
        inside = (left[todo] < high[todo]) & rising | (right[todo] > low[todo]) & ~rising
        going = inside & (below == rising)
        left[todo[inside & below]] = probe[inside & below] + 1
        right[todo[inside & ~below]] = probe[inside & ~below]
        todo, step = todo[going], 2 * step
    todo = np.flatnonzero(left < right)
    while len(todo):
        middle = (left[todo] + right[todo]) // 2
        below = long[middle] < short[todo]
        left[todo[below]] = middle[below] + 1
        right[todo[~below]] = middle[~below]
        todo = todo[left[todo] < right[todo]]
    return left


class Alignment:
    """Tokens of many texts and where they end together.

    ``ids``: of A and of B, one text after the other; ``at``: where each text's start
    (and the end); ``ends``: byte offsets, counted on over all texts; ``common``: for A
    and for B, which tokens end where one of the other does; ``groups``: where each text's start in
    ``common``.
    """

    def __init__(self, texts: list[str | None], tokenizers: Tokenizers):
        t = tokenizers
        if len(t.equal) > MOST_PARTS or len(t.flat[0][0]) + len(t.flat[1][0]) > MOST_IDS:
            t.forget()
        parts = [CUT.split(x) if x else [] for x in texts]
        number = t.look_up([p for x in parts for p in x])
        n_parts = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(texts)), n_parts)
        good = t.equal[number]
        spelt = (n_parts > 0) & (np.bincount(owner[~good], minlength=len(texts)) == 0)
        for k in np.flatnonzero((n_parts > 0) & ~spelt):
            own = number[owner == k]
            ids = [flat[spread(start[own], size[own])] for flat, size, start in t.flat]
            spelt[k] = all(b"".join([b[i] for i in x]) == (" " + texts[k]).encode() for b, x in zip((t.bytes_a, t.bytes_b), ids))
        number, owner = number[spelt[owner]], owner[spelt[owner]]
        self.ids, self.at, self.ends = [], [], []
        for (flat, size, start), sizes in zip(t.flat, t.sizes):
            ids = flat[spread(start[number], size[number])].astype(np.int64)
            n = np.bincount(owner, weights=size[number], minlength=len(texts)).astype(np.int64)
            self.ids.append(ids)
            self.at.append(np.r_[0, np.cumsum(n)])
            self.ends.append(np.cumsum(sizes[ids]))
        n_a, n_b = np.diff(self.at[0]), np.diff(self.at[1])
        found = [[], []]
        for s, lead in ((0, n_a <= n_b), (1, n_a > n_b)):
            d = np.flatnonzero(lead & (n_a > 0))  # texts whose shorter list this is
            o, n = 1 - s, (n_a, n_b)
            driver = spread(self.at[s][d], n[s][d])
            rank = driver - np.repeat(self.at[s][d], n[s][d])
            low, high = np.repeat(self.at[o][d], n[s][d]), np.repeat(self.at[o][d + 1], n[s][d])
            guess = low + rank * np.repeat(n[o][d], n[s][d]) // np.maximum(np.repeat(n[s][d], n[s][d]), 1)
            place = gallop(self.ends[s][driver], self.ends[o], low, high, guess)
            same = (place < high) & (self.ends[o][np.minimum(place, max(len(self.ends[o]) - 1, 0))] == self.ends[s][driver])
            found[s].append(driver[same]), found[o].append(place[same])
        self.common = [np.sort(np.concatenate(x)) for x in found]
        self.groups = np.searchsorted(self.common[0], self.at[0])

    def sizes(self) -> list[np.ndarray]:
        """Tokens of A and of B in each group: differences of the ranks at which both end together."""
        return [np.diff(np.r_[-1, c]) for c in self.common]

    def texts(self, words: list[list[np.ndarray]]) -> list[str]:
        """Ids of each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        sizes = self.sizes()
        out = np.empty(sum(map(len, self.ids)), object)
        start = [np.r_[0, np.cumsum(s)] for s in sizes]
        for k in (0, 1):
            token = words[k][0][self.ids[k]]
            token[self.common[k]] = words[k][1][self.ids[k][self.common[k]]]
            # before a token of A stand all of B's earlier groups; before one of B its group of A as well
            before = start[1][:-1] if k == 0 else start[0][1:]
            out[np.arange(len(token)) + np.repeat(before, sizes[k])] = token
        at = self.at[0] + self.at[1]
        out = out.tolist()
        return ["".join(out[s:e])[:-1] for s, e in zip(at[:-1], at[1:])]


def id_words(n_a: int, n_b: int) -> list[list[np.ndarray]]:
    """The decimal texts of ids followed by what comes after them within a group and at its end."""
    return [[np.array([f"{k}{c}" for k in range(n)], object) for c in (",", last)] for n, last in ((n_a, "|"), (n_b, ";"))]


_loaded: dict = {}


def loaded(vocabularies: tuple[str, str]) -> tuple[Tokenizers, list]:
    if vocabularies not in _loaded:
        t = Tokenizers(*vocabularies)
        _loaded[vocabularies] = t, id_words(len(t.bytes_a), len(t.bytes_b))
    return _loaded[vocabularies]


def source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """One row a group: doc_id, its number from 0, its tokens of A and of B as ranges from 0 (stops excluded), and its bytes.

    Bytes count from the space that goes before the text.  Texts without tokens, see
    ``align``, have no rows.
    """
    vocabularies = vocabularies or default_vocabularies()

    def run(batches):
        tokenizers, _ = loaded(vocabularies)
        for part in text_slices(batches, most=SLICE):
            x = Alignment(part.column(1).to_pylist(), tokenizers)
            n = np.diff(x.groups)
            owner = np.repeat(np.arange(part.num_rows), n)
            rank = np.arange(len(owner)) - np.repeat(x.groups[:-1], n)
            columns = [part.column(0).take(pa.array(owner)), pa.array(rank)]
            for k in (0, 1):
                stop = x.common[k] + 1
                columns += [pa.array(np.r_[0, stop[:-1]][: len(stop)] - x.at[k][owner]), pa.array(stop - x.at[k][owner])]
            ends = x.ends[0][x.common[0]]
            base = np.r_[0, x.ends[0]][x.at[0][owner]]
            columns += [pa.array(np.r_[0, ends[:-1]][: len(ends)] - base), pa.array(ends - base)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "group", "a_start", "a_stop", "b_start", "b_stop", "byte_start", "byte_stop"])

    return source(docs, text, doc_id).mapInArrow(run, "doc_id long, group long, a_start long, a_stop long, b_start long, b_stop long, byte_start long, byte_stop long")


def linked(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """One row a document: a number of its own, its counts, the hash of its groups and its links.

    A link is the number ``a * (size of B) + b`` of its id pair, an int where all fit.
    """
    here = loaded(vocabularies)[0]
    n_b = len(here.bytes_b)
    small = len(here.bytes_a) * n_b < 1 << 31

    def run(batches):
        tokenizers, words = loaded(vocabularies)
        row = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, most=SLICE):
            x = Alignment(part.column(1).to_pylist(), tokenizers)
            spelt = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.texts(words)]
            links = (x.ids[0][x.common[0]] * n_b + x.ids[1][x.common[1]]).astype(np.int32 if small else np.int64)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), part.column(0), *[pa.array(np.diff(a)) for a in (*x.at, x.groups)], pa.array(spelt, pa.string()), pa.ListArray.from_arrays(pa.array(x.groups, pa.int32()), pa.array(links))],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )
            row += n
        tokenizers.forget()

    return docs.mapInArrow(run, f"row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<{'int' if small else 'long'}>")


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no pair of its id of B has more."""
    n = materialised(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair") % n_b))
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    out = materialised(n.join(top.hint("merge"), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    drop_written(n)
    return out


def most_frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` of the pairs, sorted, with counts and best: whole levels of frequency from the top, told apart by a count of each level first."""
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in pairs.groupBy(level.alias("level")).count().collect()), reverse=True)
    kept = [x for (x, _), t in zip(sizes, np.cumsum([c for _, c in sizes])) if t <= most]
    rows = pairs.filter(level >= min(kept)).toPandas().sort_values("pair") if kept else pairs.limit(0).toPandas()
    return rows["pair"].to_numpy(), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, vocabularies: tuple[str, str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is the text after a space by a byte-level BPE, B the text by a piece model that adds
    the space; strings of special tokens in a text are plain text.  Texts that are null
    or empty, or that either does not spell to the byte, have no tokens: zeros and ''.
    Tokens have a byte at least, so a group holds one link: the pair of its last ones.  A
    pair's count is over the links of all rows, repeated rows and rows of equal or null
    id included; ``n_best`` counts links whose pair is as frequent as any of its id
    of B, ties included.  An empty table gives no rows.  Other columns are not read.

    Counts of the ``most_pairs`` most frequent pairs are shipped to tasks, those of the
    rest are joined, so nothing is left out.
    """
    vocabularies = vocabularies or default_vocabularies()
    rows = materialised(linked(source(docs, text, doc_id), vocabularies))
    pairs = pair_counts(rows, len(loaded(vocabularies)[0].bytes_b))
    keys, counts, best = most_frequent(pairs, most_pairs)

    def scored(batch):
        links = batch.column(6)
        flat, size = links.flatten().to_numpy(), links.value_lengths().to_numpy()
        ends = np.r_[0, np.cumsum(size)]
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        sums = [np.r_[0, np.cumsum(np.where(known, x[at] if len(keys) else 0, 0), dtype=np.int64)][ends] for x in (best, counts)]
        rest = np.r_[0, np.cumsum(~known)][ends]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(6)], *[pa.array(np.diff(x)) for x in sums], pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(flat[~known]))], [*batch.schema.names[:6], "n_best", "count_sum", "rest"])

    def run(batches):
        for batch in batches:
            part = np.cumsum(batch.column(4).to_numpy()) // LINKS
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield scored(batch.slice(s, e - s))

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    out = materialised(rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long, rest {rows.schema['links'].dataType.simpleString()}"))
    written = [rows, pairs]
    rare = out.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("pair"))
    if len(keys) and rare.isEmpty():
        done = out
    else:
        written.append(out)
        more = rare.join(pairs.hint("merge"), "pair").groupBy("row").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more_sum"))
        done = out.join(more.hint("merge"), "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
        done = materialised(done.drop("more_best", "more_sum"))
    drop_written(*written)
    return done.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
