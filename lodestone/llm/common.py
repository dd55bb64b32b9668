"""Helpers that several operators share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.storage import drop_written, materialised, tidy, work_dir  # noqa: F401

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def refuse_clash(kept: list[str], *names: str) -> None:
    """An error for columns to keep that a result has too (names count without case)."""
    if clash := {c.lower() for c in kept} & {n.lower() for n in names}:
        raise ValueError(f"columns to keep that the result has too: {sorted(clash)}")


# ---- text inside tasks: numpy over the bytes of many documents at a time ----


def text_slices(batches, column: str = "text", most: int = 1 << 20):
    """Record batches cut into slices of about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.fromiter((len(x) if x is not None else 0 for x in col.to_pylist()), np.int64, batch.num_rows) if not pa.types.is_string(col.type) else text_lengths(col)
        cut = np.cumsum(size) // most
        starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(s, e - s)


def text_lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each text; null: 0."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    size = np.diff(off).astype(np.int64)
    return np.where(np.asarray(col.is_valid()), size, 0) if col.null_count else size


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8, each followed by a space, and where each starts (and the end)."""
    raw = b" ".join([x.encode() if x is not None else b"" for x in col.to_pylist()] + [b""])
    ends = np.cumsum(text_lengths(col) + 1)
    return np.frombuffer(raw, np.uint8), np.r_[0, ends]


ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, 0 to n."""
    if len(_powers[0]) <= n:
        m = max(n + 1, 1 << 21)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for k, base in enumerate((ODD, inverse)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in bytes that end with white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.r_[True, space[:-1]]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return span_hashes(data, starts, ends), starts


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in order.  For short arrays this takes a small part of the time of ``np.unique``, which hashes first."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_sets(col: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    A text with fewer words is one shingle; null and empty texts have none.
    """
    data, offsets = text_bytes(col)
    words, starts = word_hashes(data)
    first = np.searchsorted(starts, offsets)
    h = np.zeros(len(words), np.uint64)
    for j in range(min(size, len(words))):
        h[: len(words) - j] += words[j:] * powers(size)[0][j]
    h = mix(h)
    out = []
    for s, e in zip(first[:-1], first[1:]):
        n = e - s
        if n >= size:
            out.append(distinct(h[s : e - size + 1]))
        elif n:
            short = (words[s:e] * powers(size)[0][:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
