"""Harmonic packing of tokenised documents into fixed-capacity sequences."""

import base64
import json
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import text_slices

#: Pre-tokenizer pattern of the 50k byte-level vocabulary, as its library states it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict = {}


def encoder(path: str):
    """text -> ids of the byte-level BPE of a rank file: those of the tokenizers file of the same name beside it.

    That file's added tokens in a text are their own ids, as ``add_special_tokens=False``
    leaves them.  A text that the rank file's library refuses (its pattern gives up on
    white space of about a million characters) is encoded by the tokenizers file.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    same = os.path.splitext(path)[0] + ".json"
    with open(same, encoding="utf-8") as f:
        tokens = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=tokens)
    whole: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except BaseException as e:  # some versions panic, which is no Exception
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(same))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    _encoders[path] = encode
    return encode


class Bins:
    """The open bins of one task.

    Class k has the remainders longer than ``capacity / (k + 1)`` and at most
    ``capacity / k``: ``k`` of them to a bin, whatever their lengths.  What they leave
    free is topped up with the first ids of the documents that come next, so a
    document is cut only where a bin ends.  At most about ``2 sqrt(capacity)`` classes
    have a bin open, and a bin that waits for a top-up is served by the next document.

    A piece is (doc_id, start, ids, doc_tokens); a placed one has the sequence id and
    the offset instead of the ids, after their length and crc32.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}
        self.waiting: deque = deque()  # [pieces, ids in them]

    def placed(self, held: list) -> list:
        """The pieces as one sequence."""
        out, at = [], 0
        for doc, start, ids, total in held:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> list:
        """Takes a document; returns the pieces of sequences that are full."""
        at, total, rows = 0, len(ids), []
        while self.waiting and at < total:
            held, used = self.waiting[0]
            n = min(self.capacity - used, total - at)
            held.append((doc, at, ids[at : at + n].copy(), total))
            at += n
            self.waiting[0][1] += n
            if used + n == self.capacity:
                rows += self.placed(self.waiting.popleft()[0])
        while total - at >= self.capacity:
            rows += self.placed([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            k = self.capacity // (total - at)
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at:].copy(), total))
            if len(held) == k:
                used = sum(len(p[2]) for p in held)
                if used == self.capacity:
                    rows += self.placed(held)
                else:
                    self.waiting.append([held, used])
                del self.open[k]
        return rows

    def finish(self) -> list:
        """What is open, as full sequences and then as ones whose sizes are powers of two, the largest first."""
        rest = deque(p for held, _ in self.waiting for p in held)
        rest += [p for k in sorted(self.open) for p in self.open[k]]
        left, rows = sum(len(p[2]) for p in rest), []
        while left:
            room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            held = []
            while room:
                doc, start, ids, total = rest.popleft()
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.appendleft((doc, start + room, ids[room:], total))
                room -= len(held[-1][2])
            rows += self.placed(held)
            left -= size
        self.open, self.waiting = {}, deque()
        return rows


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, capacity: int = 1024, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Places each document's ids, then ``end_id``, into sequences of ``capacity`` ids by harmonic packing.

    A document first tops up the bins that wait, then gives whole sequences, and its
    remainder goes to the class of its length (see ``Bins``).  All bins are full but a
    task's last ones, whose sizes are powers of two.  Each task packs its own part of
    the input as a stream: no shuffle, no state beyond the open bins, and a lost task
    gives the same rows again.  ``sequence_id`` has the partition in its upper bits.

    Null and empty texts are one ``end_id``; repeated rows are packed each; ids may be
    null; an empty table gives no rows.  Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 at least")
    path = vocabulary or default_vocabulary()
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches):
        encode, bins = encoder(path), Bins(capacity, TaskContext.get().partitionId() << 40)
        for part in text_slices(batches):
            rows: list = []
            for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += bins.add(i, np.append(encode(x or ""), end_id).astype("<u4"))
            yield batch(rows)
        yield batch(bins.finish())

    def batch(rows):
        cols = zip(*rows) if rows else [[]] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return d.mapInArrow(run, SCHEMA)
