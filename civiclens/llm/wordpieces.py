"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model crosses a white-space marker, a text's ids are those
of its marked words (a run of markers with the word behind it), one after the
other.  So three jobs do the work:

1. ``numbered`` cuts the texts at the markers.  A slice is a run of texts with
   about ``CHUNKS`` different marked words; it leaves its texts as the numbers
   of their words and its words in blocks by hash.  The two are made apart,
   from the same rows in the same order: texts that are not read from files are
   written out first, and a slice carries a check sum of its words.
2. ``segmented`` gathers the blocks by hash and segments every distinct word of
   the corpus once.
3. ``encode`` brings a slice's texts and the ids of its words together and
   joins the ids back by position.

Texts themselves are never shuffled, and a frequent word is one entry a slice.
A model with a piece across a marker, or without the leading marker, takes each
whole normalised text as its one chunk.

Defined cases: a null text is empty, and an empty text has no ids; repeated
rows are encoded each; an empty table gives none; very long texts are slices of
their own; other columns, whatever their names, pass through beside ``ids`` and
``decoded``, which replace columns so named.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm.common import carried, flat_lists, packed, restored, unpacked, written

#: The white-space marker (fixed value).
MARK = "▁"
#: Distinct words of a slice, bytes of text whose words share a block hash, and
#: words or texts handed to the library at once.
CHUNKS = 1 << 18
BLOCK_BYTES = 16 << 20
CALL = 1 << 13


class Pieces:
    """A SentencePiece model, whole and without its normaliser."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.whole = spm.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.whole.serialized_model_proto())
        spec = proto.normalizer_spec
        inner = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        prefixed = spec.add_dummy_prefix and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        #: Whether words can be taken alone, and whether normalising only marks.
        self.by_word = prefixed and not inner and any(p.piece == MARK for p in proto.pieces)
        self.plain = prefixed and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        spec.precompiled_charsmap = b""
        self.bare = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.marked = re.compile(" *[^ ]+| +").findall

    def chunks(self, text: str) -> list[str]:
        """Marked words, each without its first marker and with the others as
        blanks; for other models the normalised text."""
        if not text:
            return []
        if not self.by_word:
            whole = self.whole.normalize(text)
            return [whole] if whole else []
        if not self.plain:
            text = self.whole.normalize(text)[1:]
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.marked(" " + text)]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> list[list[int]]:
        first = MARK if self.by_word else ""
        return self.bare.encode([first + c for c in chunks], num_threads=1)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """Texts of the ids between one end and the next."""
        for at in range(0, len(ends) - 1, CALL // 32):
            here = ends[at:at + CALL // 32 + 1]
            flat = ids[here[0]:here[-1]].tolist()
            spans = (here - here[0]).tolist()
            yield from self.whole.decode([flat[a:z] for a, z in zip(spans, spans[1:], strict=False)], num_threads=1)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One model for all tasks of a worker."""
    return Pieces(path)


class Numbering(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _bucket(key: bytes, buckets: int) -> int:
    return zlib.crc32(key) % buckets


def _texts(rows: pa.Array, parts: list[np.ndarray], place: np.ndarray) -> dict[str, pa.Array]:
    return {"row": rows, "numbers": pa.array([packed(place[p]) for p in parts], pa.binary())}


def _blocks(keys: list[bytes], block: np.ndarray, order: np.ndarray) -> dict[str, pa.Array]:
    cuts, out = np.flatnonzero(np.diff(block[order], prepend=-1)), []
    for at, to in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        mine = [keys[i] for i in order[at:to]]
        sizes = np.fromiter(map(len, mine), np.int64, len(mine))
        out.append((int(block[order[at]]), zstandard.compress(b"".join(mine), 1), packed(sizes)))
    bucket, joined, lengths = zip(*out, strict=True) if out else ((), (), ())
    return {"bucket": pa.array(bucket, pa.int32()), "keys": pa.array(joined, pa.binary()),
            "lengths": pa.array(lengths, pa.binary())}


def _slice(number: int, seen: dict[str, int], buckets: int, rows: pa.Array | None,
           parts: list[np.ndarray]) -> pa.RecordBatch:
    """A slice's texts as numbers, or its words in blocks.  Words are numbered
    by block, so that the blocks one after the other list them in order."""
    keys = [k.encode() for k in seen]
    block = np.fromiter((_bucket(k, buckets) for k in keys), np.int64, len(keys))
    order = np.argsort(block, kind="stable")
    if rows is None:
        columns = _blocks(keys, block, order)
    else:
        place = np.empty(len(keys), "<u4")
        place[order] = np.arange(len(keys), dtype="<u4")
        columns = _texts(rows, parts, place)
    n = len(next(iter(columns.values())))
    head = {"slice": pa.array(np.full(n, number)), "check": pa.array(np.full(n, zlib.crc32(b" ".join(keys))))}
    return pa.RecordBatch.from_pydict(head | columns)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def numbered(docs: DataFrame, model: str, text: str, buckets: int, chunks: int, blocks: bool) -> DataFrame:
    """Texts as word numbers (slice, check, row, numbers), or the words of the
    same slices in blocks (slice, check, bucket, keys, lengths)."""
    row = F.lit(0).alias("row") if blocks else carried(docs, [text])[0]
    packed_docs = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType().add("slice", "long").add("check", "long")
    if blocks:
        schema = schema.add("bucket", "integer").add("keys", "binary").add("lengths", "binary")
    else:
        schema = schema.add("row", packed_docs.schema["row"].dataType).add("numbers", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder, number = pieces_of(model), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            seen, parts, start = Numbering(), [], 0
            for i, t in enumerate(texts):
                words = coder.chunks(t or "")
                if blocks:
                    seen.update(dict.fromkeys(words))
                else:
                    parts.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                if len(seen) >= chunks or i == len(texts) - 1:
                    number += 1
                    yield _slice(number, seen, buckets, None if blocks else rows.slice(start, len(parts)), parts)
                    seen, parts, start = Numbering(), [], i + 1

    return packed_docs.mapInArrow(cut, schema)


def segmented(blocks: DataFrame, model: str) -> DataFrame:
    """Blocks of words as blocks of ids: (slice, bucket, lengths, ids)."""
    def segment(group: pa.Table) -> pa.Table:
        data = b"".join([zstandard.decompress(b) for b in group.column("keys").to_pylist()])
        sizes = [unpacked(b) for b in group.column("lengths").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        coded = words.dictionary_encode()
        lengths, flats = [], []
        for at in range(0, len(coded.dictionary), CALL):
            ids = pieces_of(model).segment(coded.dictionary.slice(at, CALL).to_pylist())
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), "<u4", int(lengths[-1].sum())))
        length, flat = np.concatenate(lengths), np.concatenate(flats)
        taken, n = flat_lists(flat, length, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(n)])
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({
            "slice": group.column("slice"), "check": group.column("check"), "bucket": group.column("bucket"),
            "lengths": pa.array([packed(n[a:b]) for a, b in spans], pa.binary()),
            "ids": pa.array([packed(taken[upto[a]:upto[b]]) for a, b in spans], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(
        segment, "slice long, check long, bucket int, lengths binary, ids binary")


def encode(docs: DataFrame, model: str, text: str = "text", chunks: int = CHUNKS,
           block_bytes: int = BLOCK_BYTES, stable: bool = False, decoded: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with ``ids`` (array of int) and, if
    asked, ``decoded``, the text that these ids give.
    ``stable``: a scan of files, whose rows come in one order however often
    they are read; other frames are written out first."""
    docs = docs if stable else written(docs)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    buckets = max(8, -(-size // block_bytes))
    ids = segmented(numbered(docs, model, text, buckets, chunks, blocks=True), model)
    texts = numbered(docs, model, text, buckets, chunks, blocks=False)
    row = texts.schema["row"].dataType

    def join(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        if len({*rows.column("check").to_pylist(), *found.column("check").to_pylist()}) > 1:
            raise ValueError("the texts came in another order when read again: write them out first")
        length = _joined([unpacked(b) for b in found.column("lengths").to_pylist()]).astype(np.int64)
        flat = _joined([unpacked(b) for b in found.column("ids").to_pylist()]).astype(np.int32)
        numbers = [unpacked(b) for b in rows.column("numbers").to_pylist()]
        code = _joined(numbers)
        values, n = flat_lists(flat, length, code)
        upto = np.concatenate([[0], np.cumsum(n)])
        offsets = upto[np.concatenate([[0], np.cumsum([len(p) for p in numbers])]).astype(np.int64)]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        said = {"decoded": pa.array(pieces_of(model).decode(values, offsets), pa.string())} if decoded else {}
        return pa.table({"row": rows.column("row"), "ids": lists, **said})

    both = texts.groupBy("slice").cogroup(ids.groupBy("slice"))
    schema, more = T.StructType().add("row", row).add("ids", T.ArrayType(T.IntegerType())), ["ids"]
    if decoded:
        schema, more = schema.add("decoded", "string"), ["ids", "decoded"]
    return restored(both.applyInArrow(join, schema), carried(docs, [text])[1], *more)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (none: null)."""
    row, kept = carried(encoded, ["decoded"])
    packed = encoded.select(row, F.col("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for b in batches:
            texts = list(coder.decode(b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()))
            out = pa.array(texts, pa.string(), mask=b.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["row", "decoded"])

    text = packed.mapInArrow(read, T.StructType().add("row", packed.schema["row"].dataType).add("decoded", "string"))
    return restored(text, kept, "decoded")
