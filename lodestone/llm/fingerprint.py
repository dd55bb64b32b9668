"""Document fingerprints from Lempel-Ziv phrases and minimum hashes."""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodestone.llm.common import span_hashes, text_slices

SIGNATURE = 64  # smallest hashes that are kept


def phrase_ends(text: str, seen: dict, out: list, at: int) -> None:
    """Continues an LZ78 parse of ``text`` from ``at``: each phrase is the shortest not in ``seen``."""
    push, phrase = out.append, ""
    for c in text[at:] if at else text:
        at += 1
        phrase += c
        if phrase not in seen:
            seen[phrase] = None
            push(at)
            phrase = ""
    if phrase:
        push(at)


def phrase_hashes(text: str, ends: list, start: int = 0) -> np.ndarray:
    """Hashes of the phrases of a text from ``start`` on, cut at ``ends``."""
    if not ends:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text[start:].encode("utf-32-le", "surrogatepass"), np.uint32)
    e = np.array(ends, np.int64) - start
    return span_hashes(data, np.r_[0, e[:-1]], e)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The signature: the SIGNATURE smallest distinct hashes, sorted."""
    if len(hashes) > 8 * SIGNATURE:
        # beyond the k-th smallest of all there may be repeats, so more are taken until enough differ
        k = 2 * SIGNATURE
        while k < len(hashes):
            few = np.unique(np.partition(hashes, k)[:k])
            if len(few) >= SIGNATURE:
                return few[:SIGNATURE]
            k *= 4
    return np.unique(hashes)[:SIGNATURE]


def parsed_twice(text: str, follower: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of a text; the text with its last third replaced by ``follower``'s first code points; its signature.

    The parse of the edited text goes on from the phrases that both share: those
    made after the cut are taken back, so it costs only its last third.
    """
    seen: dict = {}
    ends: list = []
    cut = len(text) - len(text) // 3
    phrase_ends(text, seen, ends, 0)
    hashes = phrase_hashes(text, ends)
    edited = text[:cut] + follower[: len(text) // 3]
    k = int(np.searchsorted(ends, cut, side="right"))
    # phrases in ``seen`` stand in the order in which they were made; the text's last one may repeat another
    while len(seen) > k:
        seen.popitem()
    at = ends[k - 1] if k else 0
    own: list = []
    phrase_ends(edited, seen, own, at)
    return smallest(hashes), edited, smallest(np.r_[hashes[:k], phrase_hashes(edited, own, at)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIGNATURE]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def text_of(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u8").tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text, without a shuffle; null: as empty."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for part in text_slices(batches):
            out = []
            for x in part.column(1).to_pylist():
                ends: list = []
                phrase_ends(x or "", {}, ends, 0)
                out.append(text_of(smallest(phrase_hashes(x or "", ends))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, fingerprint string")


def cut_points(ids: DataFrame, rows_a_bucket: int, most_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (key, hash) between buckets of about ``rows_a_bucket`` rows, from a sample of 8 rows a bucket."""
    n = ids.count()
    k = int(min(max(n // rows_a_bucket, 1), most_buckets))
    if k < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, 8 * k / n)
    picked = ids.filter(F.abs(F.xxhash64("key", "h", F.lit("cut")) % 1_000_000) < int(share * 1_000_000)) if share < 1 else ids
    # 8 * most_buckets pairs of numbers, about
    rows = picked.toPandas().sort_values(["key", "h"])[["key", "h"]].to_numpy(np.int64).reshape(-1, 2)
    at = np.unique((np.arange(1, k) * len(rows)) // k)
    cuts = np.unique(rows[at[at < len(rows)]], axis=0) if len(rows) else rows
    return cuts[:, 0].copy(), cuts[:, 1].copy()


def bucket_of(cuts: tuple[np.ndarray, np.ndarray], key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bucket of each row: how many cuts are not below its (key, hash), so bucket 0 has the largest."""
    keys, hashes = cuts
    at, end = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
    # rows whose id is a cut's are told apart by their hash
    for i in np.flatnonzero(end > at):
        at[i] += np.searchsorted(hashes[at[i] : end[i]], h[i], side="left")
    return (len(keys) - at).astype(np.int32)


def with_next(docs: DataFrame, rows_a_bucket: int = 500, most_buckets: int = 1 << 17) -> DataFrame:
    """Rows (bucket, edge, key, h, doc_id, packed): a bucket in descending order of (key, h) has each row before its successor.

    Buckets are ranges of (id, text hash) between sampled cuts, so no task gets the
    whole order, nor all rows of an id that repeats with other texts.  The last row
    of a bucket finds its successor in a copy of the next bucket's first row
    (``edge``, sorted last); the last bucket gets the first row of all.  Texts move
    once, compressed by Zstandard.
    """
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("h"))
    ids = docs.select("key", "h")
    cuts = cut_points(ids, rows_a_bucket, most_buckets)

    @F.pandas_udf(IntegerType())
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(cuts, key.to_numpy(), h.to_numpy()))

    heads = ids.withColumn("bucket", bucket("key", "h")).groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("head")).orderBy("bucket").collect()
    moves = [(heads[i - 1]["bucket"], *r["head"]) for i, r in enumerate(heads)]
    # as many rows as buckets: a proven bound
    to = docs.sparkSession.createDataFrame(moves, "bucket int, key long, h long")

    def packed(texts):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.array([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())

    def pack(batches):
        for b in batches:
            at = bucket_of(cuts, b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(2), b.column(3), b.column(0), packed(b.column(1))], ["bucket", "key", "h", "doc_id", "packed"])

    def pack_edge(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), b.column(1), packed(b.column(3))], ["bucket", "key", "h", "packed"])

    rows = docs.mapInArrow(pack, "bucket int, key long, h long, doc_id long, packed binary")
    first = docs.join(F.broadcast(to), ["key", "h"]).select("key", "h", "bucket", "text")
    first = first.mapInArrow(pack_edge, "bucket int, key long, h long, packed binary")
    edges = first.groupBy("bucket", "key", "h").agg(F.min("packed").alias("packed"))
    edges = edges.select("bucket", F.lit(True).alias("edge"), "key", "h", F.lit(None).cast("long").alias("doc_id"), "packed")
    return rows.select("bucket", F.lit(False).alias("edge"), "key", "h", "doc_id", "packed").unionByName(edges)


def compare_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many of
    the next document's first ones, in order of descending ids (ties in a fixed order;
    null ids last; after the last comes the first).  Null texts are as empty; two empty
    ones have likeness 1; an empty table gives none.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(d)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "edge", F.col("key").desc(), F.col("h").desc(), "packed").select("bucket", "edge", "doc_id", "packed")

    def run(batches):
        held, waits = None, None  # (bucket, edge, doc_id, text); the result of the row before, without near_next
        expand = zstandard.ZstdDecompressor().decompress
        for part in batches:
            out = []
            for bucket, edge, i, packed in zip(*[c.to_pylist() for c in part.columns]):
                now = (bucket, edge, i, expand(packed).decode("utf-8", "surrogatepass"))
                if held is not None and held[0] == bucket:
                    sig, edited, new = parsed_twice(held[3], now[3])
                    if waits:
                        out.append((*waits[:-1], likeness(waits[-1], sig)))
                    waits = (held[2], len(held[3]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(sig), text_of(new), likeness(sig, new), sig)
                    if edge:
                        out.append((*waits[:-1], likeness(sig, parsed_twice(now[3], "")[0])))
                        waits = now = None
                held = now
            yield result(out)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(out):
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
