"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked pairs.

Both tokenizers cut the same bytes.  Offsets where tokens of both end close a
group; tokens whose bytes overlap are linked.  A pair of ids counts the
documents that hold it linked.

1. ``read`` encodes the texts once and writes the ids.  Each task also sums up
   which pairs its documents hold.
2. ``counted`` gathers the pairs by a hash of the first id.  Distinct pairs are
   united in a tree of tasks and get a minimal perfect hash function; every
   task's sums become dense vectors indexed by it, summed in a tree again.  The
   pairs themselves are kept by number, so each look-up is verified.
3. ``align`` aligns the documents a second time, from their ids, and looks the
   counts up.  The table goes to the tasks in blocks of at most
   ``LOOKUP_BYTES``, one pass each (a bucket of more is a block of its own; the
   vocabularies bound it).

Defined cases: null, empty and unequal texts (those whose tokens do not spell
them) have no tokens, groups '' and zeros; repeated rows are documents each; an
empty table gives none; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm import mphf
from civiclens.llm.common import carried, packed, restored, unpacked, written
from civiclens.llm.packing import tokenizer_of
from civiclens.llm.wordpieces import MARK, pieces_of

#: Buckets of pairs, branches of the trees, bytes of a look-up block, bytes of
#: text aligned at once, and pairs a task holds before it passes them on.
BUCKETS = 64
FAN = 64
LOOKUP_BYTES = 96 << 20
TEXT_BYTES = 2 << 20
HELD = 1 << 21


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        self.first, self.second = tokenizer_of(byte_file), pieces_of(piece_file)
        sp = self.second.whole
        self.bytes_a = self.first.token_bytes()
        self.bytes_b = [self._piece(sp, i) for i in range(sp.get_piece_size())]
        self.size_a = np.array([len(b) for b in self.bytes_a], np.int32)
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int32)
        self.wide = len(self.bytes_b)

    @staticmethod
    def _piece(sp, i: int) -> bytes:
        if sp.is_control(i) or sp.is_unknown(i):
            return b""
        piece = sp.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if sp.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where either does not spell blank and text."""
        self.first.check(" " + (texts[0] or ""))
        b = self.second.whole.encode([t or "" for t in texts], num_threads=1)
        a = []
        for i, t in enumerate(texts):
            ids = self.first.ids(" " + t) if t else []
            plain = (" " + t).encode() if t else b""
            if not t or not (b"".join(map(self.bytes_a.__getitem__, ids)) == plain
                             == b"".join(map(self.bytes_b.__getitem__, b[i]))):
                ids, b[i] = [], []
            a.append(ids)
        return a, b

    @lru_cache(maxsize=1)
    def shown(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids as text, each with a comma or with the mark that ends its side."""
        return tuple(np.array([f"{i}{mark}" for i in range(len(x)) for mark in marks], object)
                     for x, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))


@lru_cache(maxsize=2)
def pair_of(byte_file: str, piece_file: str) -> Pair:
    return Pair(byte_file, piece_file)


class Alignment:
    """Documents one after the other: where tokens end, groups close and which
    tokens are linked.  ``na`` and ``nb``: tokens of each document."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
        self.pair, self.a, self.b, self.na, self.nb = pair, a, b, na, nb
        self.end_a = np.cumsum(pair.size_a[a], dtype=np.int64)
        self.end_b = np.cumsum(pair.size_b[b], dtype=np.int64)
        size = int(self.end_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
        is_a[self.end_a - 1] = True
        is_b[self.end_b - 1] = True
        self.closes = is_a & is_b
        at = np.flatnonzero(is_a | is_b)
        self.upto_a, self.upto_b = np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
        # A stretch between two ends lies in one token of each: one link.
        self.link_a = a[self.upto_a[at] - is_a[at]]
        self.link_b = b[self.upto_b[at] - is_b[at]]
        ends = self.end_a[np.cumsum(na) - 1] if len(a) else np.zeros(len(na), np.int64)
        ends = np.where(np.cumsum(na) > 0, ends, 0)
        self.links = np.searchsorted(at, ends)  # per document, up to its end
        self.groups = np.concatenate([[0], np.cumsum(self.closes)])[ends]

    def keys(self) -> np.ndarray:
        return self.link_a.astype(np.int64) * self.pair.wide + self.link_b

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and the documents that hold each."""
        keys, span = self.keys(), len(self.pair.bytes_a) * self.pair.wide
        doc = np.repeat(np.arange(len(self.na)), np.diff(self.links, prepend=0))
        # Documents in turns, so that document and key fit one number.
        step, out = (1 << 62) // span, []
        for at in range(0, len(self.na), step):
            mine = (doc >= at) & (doc < at + step) if len(self.na) > step else slice(None)
            out.append(np.unique((doc[mine] - at) * span + keys[mine]) % span)
        return np.unique(np.concatenate([np.zeros(0, np.int64), *out]), return_counts=True)

    def text(self) -> Iterator[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        shown_a, shown_b = self.pair.shown()
        close = np.flatnonzero(self.closes)
        b_before = np.concatenate([[0], self.upto_b[close]])
        a_through = self.upto_a[close]
        group = np.cumsum(self.closes, dtype=np.int32) - self.closes
        out = np.empty(len(self.a) + len(self.b), object)
        at_a, at_b = self.end_a - 1, self.end_b - 1
        out[np.arange(len(self.a)) + b_before[group[at_a]]] = shown_a[2 * self.a + self.closes[at_a]]
        out[np.arange(len(self.b)) + a_through[group[at_b]]] = shown_b[2 * self.b + self.closes[at_b]]
        ends = np.cumsum(self.na + self.nb).tolist()
        for a, z in zip([0, *ends], ends, strict=False):
            yield "".join(out[a:z].tolist())[:-1]


def _spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes."""
    start, total = 0, 0
    for i, s in enumerate(sizes, 1):
        total += s
        if total >= most or i == len(sizes):
            yield start, i
            start, total = i, 0


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _bytes(numbers: np.ndarray, kind: str = "<i8") -> bytes:
    return numbers.astype(kind).tobytes()


def _longs(column) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i8") for b in column.to_pylist()]


def read(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", held: int = HELD) -> DataFrame:
    """Written rows of two kinds: documents (n, row, a, b) and a task's sums
    (part, bucket, keys, counts)."""
    packed_docs = docs.select(carried(docs, [text])[0], F.col(f"`{text}`").cast("string").alias("text"))
    row = packed_docs.schema["row"].dataType
    schema = (T.StructType().add("n", "long").add("row", row).add("a", "binary").add("b", "binary")
              .add("part", "integer").add("bucket", "integer").add("keys", "binary").add("counts", "binary"))

    def sums(part: int, keys: np.ndarray, counts: np.ndarray, pair: Pair) -> pa.RecordBatch:
        bucket = keys // pair.wide % BUCKETS
        here = np.unique(bucket)
        return pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(len(here), part, np.int32)), "bucket": pa.array(here.astype(np.int32)),
            "keys": pa.array([_bytes(keys[bucket == i]) for i in here], pa.binary()),
            "counts": pa.array([_bytes(counts[bucket == i]) for i in here], pa.binary())})

    def whole(batch: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
        """The columns of both kinds, those of the other null."""
        types = {"n": pa.int64(), "row": kind, "a": pa.binary(), "b": pa.binary(), "part": pa.int32(),
                 "bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.RecordBatch.from_pydict({c: batch.column(c) if c in batch.schema.names
                                           else pa.nulls(batch.num_rows, t) for c, t in types.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, pair = TaskContext.get().partitionId(), pair_of(byte_file, piece_file)
        n, keys, counts, kind = part << 36, [], [], None
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            kind = rows.type
            for s, z in _spans([len(t or "") for t in texts], TEXT_BYTES):
                a, b = pair.encode(texts[s:z])
                flat = [np.fromiter((i for ids in x for i in ids), np.int32) for x in (a, b)]
                na, nb = (np.fromiter(map(len, x), np.int64, z - s) for x in (a, b))
                k, c = Alignment(pair, *flat, na, nb).held()
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > 2 * held:
                    keys, counts = map(lambda x: [x], _sum(keys, counts))
                    if len(keys[0]) > held:
                        yield whole(sums(part, keys[0], counts[0], pair), kind)
                        keys, counts = [], []
                cut_a, cut_b = (np.split(x, np.cumsum(m)[:-1]) for x, m in zip(flat, (na, nb), strict=True))
                yield whole(pa.RecordBatch.from_pydict({
                    "n": pa.array(np.arange(n, n + z - s)), "row": rows.slice(s, z - s),
                    "a": pa.array([packed(x) for x in cut_a], pa.binary()),
                    "b": pa.array([packed(x) for x in cut_b], pa.binary())}), kind)
                n += z - s
        if keys:
            yield whole(sums(part, *_sum(keys, counts), pair), kind)

    return written(packed_docs.mapInArrow(work, schema))


def _tree(df: DataFrame, parts: int, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row a bucket: ``merge`` over FAN parts at a time."""
    while True:
        df = df.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "bucket").applyInArrow(
            merge, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            return df


def counted(sums: DataFrame, wide: int) -> DataFrame:
    """Per bucket: sizes and words of its hash function, and by number the
    keys, counts and whether a count is the highest of its first id."""
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1

    def unite(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part").slice(0, 1), "bucket": group.column("bucket").slice(0, 1),
                         "keys": pa.array([_bytes(np.unique(np.concatenate(_longs(group.column("keys")))))])})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.frombuffer(batch.column("keys")[i].as_py(), "<i8")
                sizes, words = mphf.build(keys)
                number = mphf.Numbers.of([(sizes, words)]).find(keys, np.zeros(len(keys), np.int64))
                ordered = np.empty_like(keys)
                ordered[number] = keys
                yield pa.RecordBatch.from_pydict({
                    "bucket": batch.column("bucket").slice(i, 1), "sizes": pa.array([sizes.tobytes()]),
                    "words": pa.array([words.tobytes()]), "keys": pa.array([_bytes(ordered)])})

    def dense(group: pa.Table, functions: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()),
                             "vector": pa.array([], pa.binary())})
        sizes, words, known = (np.frombuffer(functions.column(c)[0].as_py(), t)
                               for c, t in (("sizes", "<u4"), ("words", "<u8"), ("keys", "<i8")))
        function, vector = mphf.Numbers.of([(sizes, words)]), np.zeros(len(known), np.int64)
        for keys, counts in zip(_longs(group.column("keys")), _longs(group.column("counts")), strict=True):
            at = function.find(keys, np.zeros(len(keys), np.int64))
            if not np.array_equal(known[at], keys):
                raise ValueError("a pair is missing from its hash function")
            vector[at] += counts
        return pa.table({"part": group.column("group").slice(0, 1), "bucket": group.column("bucket").slice(0, 1),
                         "vector": pa.array([_bytes(vector)])})

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part").slice(0, 1), "bucket": group.column("bucket").slice(0, 1),
                         "vector": pa.array([_bytes(np.sum(_longs(group.column("vector")), axis=0))])})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("keys", "vector"))
                first = keys // wide
                ids, where = np.unique(first, return_inverse=True)
                highest = np.zeros(len(ids), np.int64)
                np.maximum.at(highest, where, counts)
                small = [_bytes(x, "<u4" if x.max() < 1 << 32 else "<i8") for x in (keys, counts)]
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).slice(i, 1) for c in ("bucket", "sizes", "words")},
                    "keys": pa.array([small[0]]), "counts": pa.array([small[1]]),
                    "best": pa.array([(counts == highest[where]).tobytes()]),
                    "n": pa.array([len(keys)], pa.int64())})

    united = _tree(sums.select("part", "bucket", "keys"), parts, unite, "part int, bucket int, keys binary")
    functions = written(united.mapInArrow(hashed, "bucket int, sizes binary, words binary, keys binary"))
    groups = -(-parts // FAN)
    copies = functions.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    leaves = (sums.select("bucket", "keys", "counts", F.floor(F.col("part") / FAN).cast("int").alias("group"))
              .groupBy("bucket", "group").cogroup(copies.groupBy("bucket", "group"))
              .applyInArrow(dense, "part int, bucket int, vector binary"))
    vectors = _tree(leaves, groups, add, "part int, bucket int, vector binary")
    joined = functions.join(vectors.select("bucket", "vector"), "bucket")
    return written(joined.mapInArrow(ranked, "bucket int, sizes binary, words binary, keys binary, counts binary, "
                                             "best binary, n long"))


def pairs(table: DataFrame, wide: int) -> DataFrame:
    """The counted pairs as rows: a, b, count, best."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = Table([batch.slice(i, 1).to_pylist()[0]])
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array((t.keys // wide).astype(np.int32)), "b": pa.array((t.keys % wide).astype(np.int32)),
                    "count": pa.array(t.counts), "best": pa.array(t.best)})

    return table.mapInArrow(rows, "a int, b int, count long, best boolean")


class Table:
    """Some buckets of the counted pairs, ready for look-ups."""

    def __init__(self, rows: list[dict]):
        def numbers(c: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *[
                np.frombuffer(r[c], f"<u{len(r[c]) // r['n']}").astype(np.int64) for r in rows]])

        self.slot = np.full(BUCKETS, -1, np.int64)
        self.slot[[r["bucket"] for r in rows]] = np.arange(len(rows))
        self.numbers = mphf.Numbers.of([(np.frombuffer(r["sizes"], "<u4"), np.frombuffer(r["words"], "<u8"))
                                        for r in rows])
        self.keys, self.counts = numbers("keys"), numbers("counts")
        self.best = np.concatenate([np.zeros(0, bool), *[np.frombuffer(r["best"], bool) for r in rows]])

    def look(self, keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and whether each is its first id's highest; zeros for keys of
        other buckets.  A key of these buckets must be there."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = self.slot[keys // wide % BUCKETS]
        mine = np.flatnonzero(slot >= 0)
        at = self.numbers.find(keys[mine], slot[mine])
        if len(at) and (at.min() < 0 or not np.array_equal(self.keys[at], keys[mine])):
            raise ValueError("a pair was not counted in the first pass")
        counts[mine], best[mine] = self.counts[at], self.best[at]
        return counts, best


def _blocks(table: DataFrame, most: int) -> list[list[int]]:
    """Buckets in runs of at most ``most`` bytes."""
    size = sum((F.length(c) for c in ("words", "keys", "counts", "best")), F.lit(0))
    rows = table.select("bucket", size.alias("size")).orderBy("bucket").collect()  # at most BUCKETS rows
    out, room = [], 0
    for r in rows:
        if not out or room + r["size"] > most:
            out.append([])
            room = 0
        out[-1].append(r["bucket"])
        room += r["size"]
    return out


def _second(texts: DataFrame, byte_file: str, piece_file: str, block, shapes: bool) -> DataFrame:
    """Aligns again and adds up what ``block`` (a broadcast) holds."""
    row = texts.schema["row"].dataType
    schema = T.StructType().add("n", "long")
    for c in ("n_best", "count_sum"):
        schema = schema.add(c, "long")
    if shapes:
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            schema = schema.add(c, "long")
        schema = schema.add("groups", "string").add("row", row)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, table = pair_of(byte_file, piece_file), Table(block.value if block is not None else [])
        for batch in batches:
            sizes = [len(x) for x in batch.column("a").to_pylist()]
            for s, z in _spans(sizes, TEXT_BYTES // 2):
                part = batch.slice(s, z - s)
                a, b = ([unpacked(x).astype(np.int32) for x in part.column(c).to_pylist()] for c in ("a", "b"))
                na, nb = (np.fromiter(map(len, x), np.int64, z - s) for x in (a, b))
                found = Alignment(pair, np.concatenate(a), np.concatenate(b), na, nb)
                counts, best = table.look(found.keys(), pair.wide) if block is not None else ([], [])
                sums = {c: np.diff(np.concatenate([[0], np.cumsum(x)])[found.links] if block is not None
                                   else np.zeros(z - s, np.int64), prepend=0)
                        for c, x in (("n_best", best), ("count_sum", counts))}
                out = {"n": part.column("n"), **{c: pa.array(x.astype(np.int64)) for c, x in sums.items()}}
                if shapes:
                    out |= {"n_a": pa.array(na), "n_b": pa.array(nb),
                            "n_groups": pa.array(np.diff(found.groups, prepend=0).astype(np.int64)),
                            "n_links": pa.array(np.diff(found.links, prepend=0).astype(np.int64)),
                            "groups": pa.array(list(found.text()), pa.string()), "row": part.column("row")}
                yield pa.RecordBatch.from_pydict(out)

    return texts.mapInArrow(work, schema)


def align(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", held: int = HELD,
          lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """The columns of ``docs`` but the text, with n_a, n_b, n_groups, n_links,
    n_best, count_sum and groups (the alignment as text)."""
    spark, wide = docs.sparkSession, pair_of(byte_file, piece_file).wide
    both = read(docs, byte_file, piece_file, text, held)
    texts = both.filter("bucket is null").select("n", "row", "a", "b")
    table = counted(both.filter("bucket is not null").select("part", "bucket", "keys", "counts"), wide)
    blocks, done = _blocks(table, lookup_bytes), []

    def sent(buckets: list[int]):
        rows = table.filter(F.col("bucket").isin(buckets)).collect()  # bounded by lookup_bytes
        return spark.sparkContext.broadcast([r.asDict() for r in rows])

    for buckets in blocks[1:]:  # further passes, one block in the driver at a time
        block = sent(buckets)
        done.append(written(_second(texts, byte_file, piece_file, block, shapes=False)))
        block.destroy()
    out = _second(texts, byte_file, piece_file, sent(blocks[0]) if blocks else None, shapes=True)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if done:
        more = done[0]
        for d in done[1:]:
            more = more.unionByName(d)
        more = more.groupBy("n").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
        out = out.join(more, "n").withColumns({"n_best": F.col("n_best") + F.col("more_best"),
                                               "count_sum": F.col("count_sum") + F.col("more_sum")})
    return restored(out, carried(docs, [text])[1], *names)
