"""Repair of conversation structure by least edit cost, with Four-Russians tables.

A conversation's roles should read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turns.  Every turn is kept (0), given the other
role (3) or deleted (4), and empty turns may be inserted anywhere (3); a turn
cut short costs 3 more unless deleted, and a blank or repeated one must go.
Of the cheapest edits the ASCII-least string of their initials is taken.

What the rest of a conversation costs from each of the four places in the
pattern is a vector whose differences are bounded, so only a few vectors occur
once the least cost is taken off.  ``Tables`` finds them all, and tabulates
what every block of ``BLOCK`` symbols makes of each.  Turns are read backward a
block a look-up; the trace then goes forward and expands one block at a time
backward from the vector kept at its end, so that every tie is seen.

Turns are sorted by range and numbered, and ``TILE`` neighbours form a tile.
Conversations inside a tile are solved there.  One that crosses tiles gives a
small map from each tile (vector behind to vector before, and place before to
place behind); the maps of a conversation are joined in one short scan, which
tells each tile what it needs.  A long conversation is so spread over tasks.

Defined cases: a null role or text is one blank; turns are ordered by turn
(nulls first), then role, then text; null conversations are one conversation;
repeated rows are repeated turns; a role that starts with none of s, u, a
cannot be kept; an empty table gives none; other columns, whatever their
names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.llm.common import WHITESPACE, carried, restored, written

#: Costs of the edits, and of leaving a truncated turn (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Role initials in order; symbols 2 * role (+ 1: truncated), and 8: must go.
ROLES = "sua"
MUST_GO = 8
SYMBOLS = 9
#: Places: nothing said, behind s, behind u, behind a.  The turn each takes
#: next (of user and assistant), and the place behind it.
TAKES = "uuau"
BEHIND = (2, 2, 3, 2)
BLOCK = 4
TILE = 1 << 14
NAMES = {"u": "user", "a": "assistant"}


def _open(costs: list[int]) -> tuple[int, ...]:
    """Costs once turns may be inserted."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[BEHIND[q]]) for q, c in enumerate(out)]
    return tuple(out)


def _choices(symbol: int, place: int) -> Iterator[tuple[str, int, int, str]]:
    """Edits of one turn: initial, cost, place behind, role initial said."""
    yield "D", DELETE, place, ""
    if symbol == MUST_GO:
        return
    role, more = (ROLES + " ")[symbol // 2], TRUNCATED * (symbol % 2)
    if role == "s" and place == 0:
        yield "K", more, 1, "s"
    yield ("K" if role == TAKES[place] else "R"), more + REROLE * (role != TAKES[place]), BEHIND[place], TAKES[place]


class Tables:
    """All cost vectors that occur, and what symbols and blocks make of them."""

    def __init__(self, block: int = BLOCK):
        far = 1 << 20
        end = _open([0, far, far, 0])
        self.vectors, step = [end], {}
        known = {end: 0}
        for v, costs in enumerate(self.vectors):  # grows while it is read
            for x in range(SYMBOLS):
                raw = _open([min(c + costs[to] for _, c, to, _ in _choices(x, q)) for q in range(4)])
                least = min(raw)
                after = tuple(c - least for c in raw)
                if after not in known:
                    known[after] = len(self.vectors)
                    self.vectors.append(after)
                step[v, x] = known[after], least
        n = len(self.vectors)
        self.end, self.block = 0, block
        self.before = np.array([[step[v, x][0] for x in range(SYMBOLS)] for v in range(n)], np.int16)
        self.least = np.array([[step[v, x][1] for x in range(SYMBOLS)] for v in range(n)], np.int32)
        # Blocks: the code's first digit is the block's first symbol.
        self.over, self.cost = np.arange(n, dtype=np.int16)[:, None], np.zeros((n, 1), np.int32)
        for _ in range(block):  # one more symbol in front
            self.cost = (self.cost[:, None, :] + self.least[self.over].transpose(0, 2, 1)).reshape(n, -1)
            self.over = self.before[self.over].transpose(0, 2, 1).reshape(n, -1)
        self.edits = {key: self._edit(*key) for key in product(range(n), range(SYMBOLS), range(4))}
        self.behind = np.array([[[self.edits[v, x, q][1] for q in range(4)] for x in range(SYMBOLS)]
                                for v in range(n)], np.int8)
        self.last = [self._inserts(self.vectors[0], q, lambda costs, at: costs[at] == 0 and at in (0, 3))
                     for q in range(4)]

    @staticmethod
    def _inserts(costs, place, stop) -> tuple[str, int]:
        said = ""
        while not stop(costs, place):
            said, place = said + TAKES[place], BEHIND[place]
        return said, place

    def _edit(self, v: int, x: int, place: int) -> tuple[str, int, int, str, str]:
        """From a place before symbol x, with vector v behind it: initial of
        the turn's edit, place behind, cost, roles inserted before, role said."""
        after, least = self.vectors[v], self.least[v, x]
        here = [c + least for c in self.vectors[self.before[v, x]]]
        inserted, spent = "", 0
        while True:
            best = {e: (c, to, said) for e, c, to, said in _choices(x, place) if c + after[to] == here[place]}
            if "D" not in best and INSERT + here[BEHIND[place]] == here[place]:
                inserted, spent, place = inserted + TAKES[place], spent + INSERT, BEHIND[place]
                continue
            e = min(best)
            cost, to, said = best[e]
            return e, to, spent + cost, inserted, said

    def blocks(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Symbols in front that fill no block, and the block codes in order."""
        head = len(symbols) % self.block
        code, codes = 0, []
        for i, x in enumerate(symbols[head:], 1):
            code = code * SYMBOLS + x
            if i % self.block == 0:
                codes.append(code)
                code = 0
        return symbols[:head], codes

    def solve(self, symbols: list[int], vector: int, place: int) -> Iterator[tuple[str, int, int, str, str]]:
        """The edits of the turns, with the vector behind them known."""
        head, codes = self.blocks(symbols)
        kept = [vector]
        for code in reversed(codes):
            kept.append(int(self.over[kept[-1], code]))
        at = 0
        for size, behind in zip([len(head)] + [self.block] * len(codes), reversed(kept), strict=True):
            inside = [behind]
            for x in reversed(symbols[at + 1:at + size]):
                inside.append(int(self.before[inside[-1], x]))
            for x, v in zip(symbols[at:at + size], reversed(inside), strict=False):
                edit = self.edits[v, x, place]
                yield edit
                place = edit[1]
            at += size

    def maps(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols the vector before them, and for
        every place before them the place behind."""
        head, codes = self.blocks(symbols)
        over = np.arange(len(self.vectors), dtype=np.int16)
        for code in reversed(codes):
            over = self.over[over, code]
        for x in reversed(head):
            over = self.before[over, x]
        inside = [np.arange(len(self.vectors), dtype=np.int16)]
        for x in reversed(symbols[1:]):
            inside.append(self.before[inside[-1], x])
        place = np.tile(np.arange(4, dtype=np.int8), (len(self.vectors), 1))
        for x, v in zip(symbols, reversed(inside), strict=True):
            place = self.behind[v[:, None], x, place]
        return over, place


@lru_cache(maxsize=2)
def tables(block: int = BLOCK) -> Tables:
    """The tables follow from the costs alone; a worker makes them once."""
    return Tables(block)


def _runs(conv: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Where each conversation's turns lie in a sorted tile."""
    coded = conv.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(cuts, cuts[1:], strict=False))


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order with their numbers ``n``, faults aside.  Written once."""
    def blank_if_null(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    flat = turns.select(carried(turns, [])[0], F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                        blank_if_null(role).alias("role"), blank_if_null(text).alias("text"))
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            n = pa.array(np.arange(at, at + b.num_rows))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, "n"])

    dealt = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(number, T.StructType([*flat.schema.fields, T.StructField("n", T.LongType())])))


def faults(ordered: DataFrame) -> DataFrame:
    """(n, conv, initial, fault): blank, duplicate, truncated or null."""
    trimmed = F.rtrim("text", F.lit(WHITESPACE))
    initial = F.substring("role", 1, 1)
    key = F.sha2(F.concat("role", F.lit("\n"), "text"), 256)
    first = ordered.groupBy("conv", F.length("role").alias("r"), key.alias("k")).agg(F.min("n").alias("n"))
    marked = ordered.select("n", "conv", initial.alias("initial"), F.when(trimmed == "", "blank").when(
        ~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").alias("found"))
    seen = marked.join(first.select("n", F.lit(True).alias("new")), "n", "left")
    return seen.select("n", "conv", "initial", F.when(F.col("found") == "blank", "blank").when(
        F.col("new").isNull(), "duplicate").otherwise(F.col("found")).alias("fault"))


def _symbol() -> Column:
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.col("initial")), F.lit(0)), F.lit(len(ROLES) + 1)) - 1
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    return F.when(must, F.lit(MUST_GO)).otherwise(
        2 * F.when(F.col("initial") == "", F.lit(len(ROLES))).otherwise(role)
        + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int")).cast("int")


def edits(found: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Per turn: n, edit, cost, before (roles inserted), said, after (roles
    inserted behind the last turn), illegal (does not follow the turn before)."""
    conv = found.schema["conv"]
    small = found.select(F.floor(F.col("n") / F.lit(tile)).alias("tile"), "n", "conv", "initial",
                         _symbol().alias("symbol"))

    def outline(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        symbols, initials = group.column("symbol").to_pylist(), group.column("initial").to_pylist()
        runs = _runs(group.column("conv"))
        ends = sorted({runs[0], runs[-1]})
        made = [tables(block).maps(symbols[a:b]) for a, b in ends]
        return pa.table({
            "conv": group.column("conv").take(pa.array([a for a, _ in ends])),
            "tile": pa.array([group.column("tile")[0].as_py()] * len(ends), pa.int64()),
            "vectors": pa.array([v.tobytes() for v, _ in made], pa.binary()),
            "places": pa.array([p.tobytes() for _, p in made], pa.binary()),
            "first": pa.array([initials[a] for a, _ in ends]), "last": pa.array([initials[b - 1] for _, b in ends])})

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("tile")
        over = [np.frombuffer(b, np.int16) for b in group.column("vectors").to_pylist()]
        behind = [tables(block).end]
        for v in reversed(over[1:]):
            behind.append(int(v[behind[-1]]))
        behind.reverse()
        place, places = 0, []
        for b, v in zip(group.column("places").to_pylist(), behind, strict=True):
            places.append(place)
            place = int(np.frombuffer(b, np.int8).reshape(-1, 4)[v, place])
        return pa.table({"conv": group.column("conv"), "tile": group.column("tile"),
                         "vector": pa.array(behind, pa.int32()), "place": pa.array(places, pa.int32()),
                         "earlier": pa.array([None, *group.column("last").to_pylist()[:-1]], pa.string()),
                         "final": pa.array([False] * (len(places) - 1) + [True])})

    def trace(group: pa.Table, border: pa.Table) -> pa.Table:
        group, border = group.sort_by("n"), border.sort_by("tile")
        symbols, initials = group.column("symbol").to_pylist(), group.column("initial").to_pylist()
        runs, known = _runs(group.column("conv")), {}
        names = ("vector", "place", "earlier", "final")
        conv_of = group.column("conv")
        for c, *what in zip(border.column("conv").to_pylist(), *[border.column(x).to_pylist() for x in names],
                            strict=True):
            known[c] = what
        t, rows = tables(block), []
        for r, (a, b) in enumerate(runs):
            vector, place, earlier, final = t.end, 0, None, True
            if r in (0, len(runs) - 1):
                vector, place, earlier, final = known[conv_of[a].as_py()]
            for i, (e, to, cost, before, said) in enumerate(t.solve(symbols[a:b], vector, place), a):
                wrong = earlier is not None and earlier + initials[i] not in ("su", "ua", "au")
                rows.append([e, cost, before, said, "", wrong])
                earlier, place = initials[i], to
            if final:
                after = t.last[place][0]
                rows[-1][4] = after
                rows[-1][1] += INSERT * len(after)
        e, cost, before, said, after, wrong = zip(*rows, strict=True)
        return pa.table({"n": group.column("n"), "edit": pa.array(e), "cost": pa.array(cost, pa.int64()),
                         "before": pa.array(before), "said": pa.array(said), "after": pa.array(after),
                         "illegal": pa.array(wrong)})

    kind = T.StructType([T.StructField("conv", conv.dataType), T.StructField("tile", T.LongType())])
    outlines = small.groupBy("tile").applyInArrow(outline, T.StructType([
        *kind.fields, T.StructField("vectors", T.BinaryType()), T.StructField("places", T.BinaryType()),
        T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]))
    borders = outlines.groupBy("conv").applyInArrow(scan, T.StructType([
        *kind.fields, T.StructField("vector", T.IntegerType()), T.StructField("place", T.IntegerType()),
        T.StructField("earlier", T.StringType()), T.StructField("final", T.BooleanType())]))
    return small.groupBy("tile").cogroup(borders.groupBy("tile")).applyInArrow(
        trace, "n long, edit string, cost long, before string, said string, after string, illegal boolean")


def _said(roles: str) -> Column:
    """Empty turns of inserted roles, as structs."""
    each = F.filter(F.split(F.col(roles), ""), lambda c: c != "")
    return F.transform(each, lambda c: F.struct(F.when(c == "u", NAMES["u"]).otherwise(NAMES["a"]).alias("role"),
                                                F.lit("").alias("text")))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """The columns of ``turns`` with n (order), fault, edits (initials, inserts
    among them), cost, illegal, and said: the repaired turns it becomes, as
    structs of role and text."""
    ordered = numbered(turns, conv, turn, role, text)
    found = written(faults(ordered))
    done = (edits(found, block, tile).join(found.select("n", "fault"), "n"))
    both = ordered.join(done, "n")
    own = F.when(F.col("said") != "", F.array(F.struct(
        F.when(F.col("edit") == "K", F.col("role")).when(F.col("said") == "u", NAMES["u"])
        .otherwise(NAMES["a"]).alias("role"), F.col("text").alias("text")))).otherwise(
            F.array().cast("array<struct<role:string,text:string>>"))
    shown = F.concat(F.translate("before", "ua", "II"), F.col("edit"), F.translate("after", "ua", "II"))
    out = both.select("row", "n", "fault", shown.alias("edits"), "cost", "illegal",
                      F.concat(_said("before"), own, _said("after")).alias("said"))
    return restored(out, carried(turns, [])[1], "n", "fault", "edits", "cost", "illegal", "said")


def repaired(fixed: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repaired conversations themselves: conv, turn (from 0), role, text.
    ``turn`` is numbered within a row's number, so no conversation is gathered."""
    return fixed.select(F.col(f"`{conv}`"), "n", F.posexplode("said").alias("part", "turn")).select(
        F.col(f"`{conv}`"), F.struct("n", "part").alias("turn_key"), "turn.role", "turn.text")
