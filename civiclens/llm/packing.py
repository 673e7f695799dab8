"""Packing tokenized documents into windows by best-fit decreasing.

A document's ids are cut into full windows first; the rest of each document is
one piece.  Pieces are dealt out by a hash; each partition takes its pieces
longest first and puts each into the open window with the least room that
still holds it.  A segment tree over the possible remaining capacities finds
that window in log2(window) steps.  A partition keeps only the numbers of its
open windows in memory; the ids stream through.

Defined cases: a null text is empty, and an empty document is its end mark
alone; repeated rows are packed as many documents; an empty table has no
windows; very long texts become many full windows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window and the id that ends a document (fixed values).
WINDOW = 2048
END = 1
PIECE = "doc_id long, doc_tokens long, start long, length long, ids binary"


#: How the byte-level pre-tokenizer splits a text, and the bytes that stand for
#: themselves in its vocabulary (fixed values); the others take the characters
#: from 256 on, in order.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


class FileTokenizer:
    """Ids of texts by a byte-level tokenizer file.

    The file is read by ``tokenizers``.  Its vocabulary, as merge ranks, feeds
    ``tiktoken``, which applies the same merges about four times as fast;
    ``check`` holds the one against the other.  ``ids`` takes the strings of
    special tokens as ordinary text; ``encode`` is the file's plain call, which
    gives such a string its special id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        special = {t.content for t in self.exact.get_added_tokens_decoder().values() if t.special}
        self.special = sorted(t for t in special if t)
        others = iter(range(256, 512))
        byte_of = {chr(b if b in PRINTED else next(others)): b for b in range(256)}
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in self.exact.get_vocab().items() if token not in special}
        self.ranks = ranks
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = re.compile(r"\s{1000}").search

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; special tokens have none."""
        out = [b""] * self.exact.get_vocab_size()
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def slow_ids(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """Long runs of white space would exhaust the other library's matcher."""
        return self.slow_ids(text) if self.blank(text) else self.fast.encode_ordinary(text)

    def check(self, text: str) -> None:
        if self.ids(text) != self.slow_ids(text):
            raise ValueError("the tokenizer file is not byte-level BPE with ids in merge order")

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        marked = any(s in text for s in self.special)
        ids = self.marked.encode(text, add_special_tokens=False).ids if marked else self.ids(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> FileTokenizer:
    """One tokenizer for all tasks of a worker."""
    return FileTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized documents cut into full windows and a rest: doc_id,
    doc_tokens (with the end mark), start, length, ids (little-endian uint32)."""
    mark = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                coder.check(texts[0])
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = coder.encode(text) + mark
                    n = len(ids) // 4
                    rows += [(doc, n, s, min(window, n - s), ids[4 * s:4 * (s + window)])
                             for s in range(0, n, window)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)],
                    names=["doc_id", "doc_tokens", "start", "length", "ids"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text")).mapInArrow(cut, PIECE)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1 - 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, room: int, number: int) -> None:
        if room:
            self.open[room].append(number)
            self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``length``."""
        tree, at = self.tree, length + self.leaves
        if not tree[at]:
            while True:  # up to the first subtree on the right that is not empty
                if at & (at + 1) == 0:
                    return None
                if not at & 1 and tree[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._count(room, -1)
        return room, self.open[room].pop()


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with sequence_id and offset.  Any number of partitions packs
    right; fewer leave fewer half-empty windows at their ends."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        windows = OpenWindows(window)
        for batch in batches:
            seq, offset = [], []
            for length in batch.column("length").to_pylist():
                found = windows.tightest(length)
                if found is None:
                    number += 1
                    found = window, number
                room, at = found
                seq.append(at)
                offset.append(window - room)
                windows.add(room - length, at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = (cut.repartition(F.xxhash64("doc_id", "start", "length"))
             .sortWithinPartitions(F.desc("length"), "doc_id", "start", F.xxhash64("ids")))
    return dealt.mapInArrow(fill, PIECE + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves: sequence_id, n_tokens, ids (one binary)."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("whole"), F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return (packed.groupBy("sequence_id").agg(whole.alias("whole"), F.sum("length").alias("n_tokens"))
            .select("sequence_id", "n_tokens", joined.alias("ids")))
