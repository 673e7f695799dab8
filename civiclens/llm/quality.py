"""Quality rules as a short-circuit cascade.  DataFrame functions only.

Each rule is a predicate over one or two measures of a text.  On a sample the
cascade counts what every rule rejects and the characters and words that its
measures go through, at a unit time each (``UNIT_NS``), then orders the rules by
rejections per cost, so a cheap rule that rejects much runs first and an
expensive one sees only what the others let through (``CASE`` evaluates its
branches in order and stops at the first that holds).  The order changes the
time, never the verdict, and is the same in every call on the same table.

Defined cases: a null text counts as empty (no words, rejected); texts are
measured whole; repeated rows get the same verdict; an empty table gives an
empty result; an input column named like an output one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.llm.common import WHITESPACE, let, pack_row, unpack_row, words

#: Characters counted as symbols, the repeated-window width and the base limits
#: (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _solid(text: Column) -> Column:
    """The text without white space."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


# Every measure takes the text and its words, which are split once for all.
def n_words(text: Column, found: Column) -> Column:
    return F.size(found).cast("long")


def word_chars(text: Column, found: Column) -> Column:
    return F.length(_solid(text)).cast("long")


def n_symbols(text: Column, found: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                    lambda x: F.translate(x, WHITESPACE, "") != "")


def n_lines(text: Column, found: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column, found: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, found: Column, width: int = WINDOW) -> Column:
    """Words lying in a window of ``width`` words that occurs twice or more in
    the text (the first occurrence counts too).

    Windows are compared by a 64-bit hash of their words' hashes.  Only a text
    that has a repeated window pays for the sort that locates the repeats.
    """
    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.filter(F.transform(s, lambda x, k: F.when(
                (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"])),
                lambda i: i.isNotNull())

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return let(ordered, lambda s: F.aggregate(
            F.sort_array(starts(s)), zero,
            lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).alias("n"),
                                  (p + width).alias("end")),
            lambda a: a["n"]))

    def windows(h: Column) -> Column:
        hashed = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
        return let(hashed, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0))
                   .otherwise(covered(g)))

    return let(F.transform(found, lambda w: F.xxhash64(w)), windows).cast("long")


def upper_words(text: Column, found: Column) -> Column:
    """Words with a letter and no lower-case letter."""
    return F.size(F.filter(found, lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long")


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines,
    "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "upper_words": upper_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function from a measure's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("too_few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * MAX_REPEAT_PERCENT),
)
#: Beyond the base: one symbol in ten words, over half of the lines repeated,
#: average words outside 2 to 12 characters, mostly capitals in a long text.
RULES = BASE_RULES + (
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2)
         | (m("word_chars") > m("n_words") * 12)),
    Rule("capitals", lambda m: (m("n_words") >= 50) & (m("upper_words") * 2 > m("n_words"))),
)


#: Time of a measure by what it goes through, in nanoseconds of one core over
#: those of splitting the words (measured on the test documents; rounded).
#: ``rule`` is a rule's own test, ``other`` a measure not named here.
UNIT_NS = {
    "rule": ("row", 100), "other": ("char", 100), "n_words": ("row", 10), "word_chars": ("char", 85),
    "n_symbols": ("char", 100), "n_lines": ("char", 95), "n_dup_lines": ("char", 95),
    "n_repeat_words": ("word", 1570), "upper_words": ("word", 190),
}


def _measures_of(rule: Rule) -> list[str]:
    """The measures a rule asks for, each once."""
    asked: dict[str, Column] = {}
    rule.rejects(lambda n: asked.setdefault(n, F.col(n)))
    return list(asked)


def _values(text: Column, names: Sequence[str]) -> Column:
    """The named measures of a text as one struct."""
    return let(words(text), lambda w: F.struct(*[MEASURES[n](text, w).alias(n) for n in names]))


def measure(docs: DataFrame, names: Sequence[str], text: str = "text") -> DataFrame:
    """``docs`` with the named measures as columns."""
    df = pack_row(docs, _values(F.col(f"`{text}`"), names).alias("m"))
    return unpack_row(df, docs.columns, **{n: F.col(f"m.{n}") for n in names})


def rank_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 1000,
               seed: int = 42) -> list[Rule]:
    """Rules by rejections per cost on a sample of about ``sample_rows`` rows.

    One job over the sample; it only sets the order of evaluation.
    """
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    t = F.col("text")
    sample = docs.select(F.col(f"`{text}`").alias("text")).sample(False, share, seed)

    def looked_at(found: Column) -> Column:
        hits = [F.coalesce(r.rejects(lambda n: MEASURES[n](t, found)), F.lit(False)).alias(f"r{i}")
                for i, r in enumerate(rules)]
        return F.struct(F.coalesce(F.length(t), F.lit(0)).alias("chars"), F.size(found).alias("words"), *hits)

    seen = (sample.select(let(words(t), looked_at).alias("s")).select("s.*")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words"),
                 *[F.count_if(f"r{i}").alias(f"r{i}") for i in range(len(rules))]).first())
    amount = {"row": seen["n"], "char": seen["chars"] or 0, "word": seen["words"] or 0}
    scored = []
    for position, rule in enumerate(rules):
        units = [UNIT_NS["rule"], *(UNIT_NS.get(m, UNIT_NS["other"]) for m in _measures_of(rule))]
        cost = sum(ns * amount[unit] for unit, ns in units) or 1
        scored.append((-seen[f"r{position}"] / cost, position, rule))
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def verdict(text: Column, rules: Sequence[Rule], measures: Sequence[str] = ()) -> Column:
    """A struct of the named measures and ``kept``: no rule rejects the text.

    Rules are tried in order up to the first that rejects.  A measure is
    computed inside its rule, so a text rejected early never pays for the later
    rules' measures; those in ``measures`` are wanted anyway and are computed
    once before.
    """
    def judged(found: Column, known: Column | None) -> Column:
        out = F.lit(True)
        for rule in reversed(rules):
            rejects = rule.rejects(lambda n: known[n] if n in measures else MEASURES[n](text, found))
            out = F.when(rejects, F.lit(False)).otherwise(out)
        return F.struct(*[known[n].alias(n) for n in measures], out.alias("kept"))

    if not measures:
        return let(words(text), lambda w: judged(w, None))
    return let(words(text), lambda w: let(F.struct(*[MEASURES[n](text, w).alias(n) for n in measures]),
                                          lambda m: judged(w, m)))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
            measures: Sequence[str] = (), sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the named measures and ``kept``, the rules in the order that
    a sample suggests."""
    ordered = rank_rules(docs, rules, text, sample_rows)
    df = pack_row(docs, verdict(F.col(f"`{text}`"), ordered, measures).alias("v"))
    return unpack_row(df, docs.columns, **{n: F.col(f"v.{n}") for n in (*measures, "kept")})


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Rows that pass every rule, with the columns of ``docs``."""
    ordered = rank_rules(docs, rules, text)
    return docs.filter(verdict(F.col(f"`{text}`"), ordered)["kept"])
