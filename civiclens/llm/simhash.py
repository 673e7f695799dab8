"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits, each the majority over the XXH64 hashes of
its word shingles.  Two fingerprints that differ in at most ``distance`` bits
are linked, and links chain into components.

Candidates.  Put ``segments`` consecutive pieces of the fingerprint on a ring.
If two fingerprints differ in at most d bits, some place on the ring starts a
chain whose first l segments together differ in at most ``l * d / segments``
bits, for every l.  While that budget is below one the chain must agree
exactly, so these leading segments (with the place) are an equi-join key; the
longer chains' budgets then drop pairs before the full distance is taken.

Hot keys.  A group of near copies fills a key with fingerprints.  Keys over
``HOT_ROWS`` fingerprints are not paired; all their fingerprints go to a
second, exact join: of ``FINE * d`` pieces any two that differ in at most d
bits agree outside some d pieces, so each choice of d pieces left out gives a
key of 48 bits or more, which at most 2^16 distinct fingerprints can share.
Pairs are not emitted: a key's group is compared in blocks and gives only the
links of a spanning forest.

Copies meet first: only distinct fingerprints are linked, and components are
found on fingerprints by alternating large-star and small-star steps.

Defined cases: a text with fewer words than a shingle is one shingle; no
words, or a null text, give fingerprint zero, linked like any other; null ids
sort first and a component of null ids only has a null id; repeated rows stay
as many rows; extra columns pass through (``dedup``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm.common import pack_row, positional, renamed, saved, unpack_row

#: Contract values: words in a shingle, largest distance, hash seed.
SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Segments on the ring, fingerprints a key may pair directly, pieces of the
#: second join, shingles counted at a time, rows compared at a time.
SEGMENTS = 5
HOT_ROWS = 32
FINE = 4
CHUNK = 1 << 15
BLOCK = 1024


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text (unsigned)."""
    from xxhash import xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[:len(found) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    ones, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED)
                      for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` (the fingerprint as a signed long), in place of ``text``."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            fp = np.array([text_fingerprint(t.as_py(), shingle) for t in texts], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())],
                                             names=[*batch.schema.names[:-1], "fp"])

    return docs.select(*rest, text).mapInArrow(run, schema)


def _cuts(parts: int) -> list[int]:
    return [64 * i // parts for i in range(parts + 1)]


def _bits(fp: Column, start: int, end: int) -> Column:
    """Bits start..end-1 of a fingerprint."""
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << (end - start)) - 1))


def ring_keys(fps: DataFrame, distance: int, segments: int) -> DataFrame:
    """Each fingerprint once per place on the ring, with the place and the
    segments on which a passing chain from there must agree exactly."""
    exact = max(1, -(-segments // max(distance, 1)) - 1) if distance else segments
    cuts = _cuts(segments)
    keys = []
    for place in range(segments):
        parts = [(place + i) % segments for i in range(exact)]
        value = [_bits(F.col("fp"), cuts[p], cuts[p + 1]) for p in parts]
        keys.append(F.struct(F.lit(place).alias("place"), F.xxhash64(*value).alias("value")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.place", "key.value")


def chain_passes(place: Column, diff: Column, distance: int, segments: int) -> Column:
    """Every chain from ``place`` keeps within its proportional budget."""
    cuts = _cuts(segments)
    ones = [F.bit_count(_bits(diff, cuts[p], cuts[p + 1])) for p in range(segments)]
    ok = F.lit(False)
    for start in range(segments):
        upto, within = F.lit(0), F.lit(True)
        for step in range(segments):
            upto = upto + ones[(start + step) % segments]
            within = within & (upto <= (step + 1) * distance // segments)
        ok = F.when(place == start, within).otherwise(ok)
    return ok


def direct_links(keys: DataFrame, distance: int, segments: int) -> DataFrame:
    """Linked pairs (a < b) among the fingerprints of each key that is not hot."""
    left = keys.select(F.col("fp").alias("a"), "place", "value")
    right = keys.select(F.col("fp").alias("b"), F.col("place").alias("p"), F.col("value").alias("v"))
    pairs = left.join(right, (F.col("place") == F.col("p")) & (F.col("value") == F.col("v"))
                      & (F.col("a") < F.col("b")))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    return pairs.filter(chain_passes(F.col("place"), diff, distance, segments)
                        & (F.bit_count(diff) <= distance)).select("a", "b")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of one key, compared in
    blocks; only rows that are still in different trees give a link."""
    fps, parent = fps.astype(np.int64).view(np.uint64), np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            near = np.bitwise_count(fps[i:i + BLOCK, None] ^ fps[None, j:j + BLOCK]) <= distance
            for x, y in zip(*np.nonzero(near), strict=True):
                x, y = int(x) + i, int(y) + j
                if x < y and (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    links.append((x, y))
    return links


def hot_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links that connect the same fingerprints as all links would."""
    pieces = FINE * max(distance, 1)
    cuts = _cuts(pieces)
    keys = []
    for left_out in combinations(range(pieces), distance):
        kept = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in range(pieces) if p not in left_out)
        kept = kept - (1 << 64) if kept >> 63 else kept
        keys.append(F.struct(F.lit(len(keys)).alias("place"), F.col("fp").bitwiseAND(F.lit(kept)).alias("value")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.place", "key.value")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(group["fp"].to_numpy())
        found = forest(fp, distance)
        return pd.DataFrame({"a": fp[[x for x, _ in found]], "b": fp[[y for _, y in found]]}, dtype="int64")

    many = (rows.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.col("place").alias("p"), F.col("value").alias("v")))
    shared = rows.join(many, (F.col("place") == F.col("p")) & (F.col("value") == F.col("v"))).select("fp", "place", "value")
    return shared.groupBy("place", "value").applyInPandas(link, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect every two
    within ``distance``: all links of ordinary keys, a forest of hot ones."""
    if segments <= distance:
        raise ValueError("a chain needs more segments than the largest distance")
    keys = ring_keys(fps, distance, segments)
    sizes = keys.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = saved(sizes.select(F.col("place").alias("s_place"), F.col("value").alias("s_value"), "n"))
    shared = keys.join(sizes, (F.col("place") == F.col("s_place")) & (F.col("value") == F.col("s_value")))
    cold = shared.filter(F.col("n") <= hot_rows).select("fp", "place", "value")
    hot = shared.filter(F.col("n") > hot_rows).select("fp").distinct()
    return direct_links(cold, distance, segments).unionByName(hot_links(hot, distance))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of its component as root, for every
    node with a link: alternating large-star and small-star steps, which take
    a number of rounds logarithmic in the component's size."""
    edges = saved(edges.select("a", "b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(lowest, "a")
                 .select(F.col("b").alias("x"), F.col("m").alias("y")).distinct())
        down = large.filter(F.col("x") != F.col("y"))
        mins = down.groupBy("x").agg(F.min("y").alias("m"))
        small = (down.join(mins, "x").select(F.col("y").alias("x"), F.col("m"))
                 .unionByName(mins.select("x", "m")).filter("x != m").distinct())
        new = saved(small.select(F.col("m").alias("a"), F.col("x").alias("b")))
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
            distance: int = DISTANCE) -> DataFrame:
    """The columns of ``docs`` but the text, with fp, root (names the
    component) and component_id: the smallest key reachable over links, the
    row's own included; input columns of these names are replaced."""
    plain, kept = positional(docs, text, key)
    marked = saved(fingerprints(plain, "text", shingle))
    first = saved(marked.groupBy("fp").agg(F.min("key0").alias("first")))
    roots = components(links(first.select("fp"), distance))
    placed = first.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return renamed(marked.join(named, F.col("fp") == F.col("f")), kept, "fp", "root", "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
          distance: int = DISTANCE) -> DataFrame:
    """One row of each component: the smallest key, then the smallest text hash.
    Columns of ``docs``."""
    t = F.col(f"`{text}`")
    helper = (F.col(f"`{key}`").alias("id"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit("text"), t).alias("g"))
    marked = cluster(docs.select(*helper, t.alias("text")), "id", "text", shingle, distance)
    stay = (marked.groupBy("root", "id", "h", "g").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("root").agg(F.min(F.struct("id", "h", "g", "n")).alias("k"))
            .select(F.col("k.id").alias("k_id"), F.col("k.h").alias("k_h"), F.col("k.g").alias("k_g"), "k.n"))
    rows = pack_row(docs, *helper).join(stay, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
                                        & (F.col("g") == F.col("k_g")))
    alone = rows.filter("n = 1").select("row")
    repeated = rows.filter("n > 1").dropDuplicates(["id", "h", "g"]).select("row")
    return unpack_row(alone.unionByName(repeated), docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
