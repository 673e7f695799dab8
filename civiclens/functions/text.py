"""Word-level text rules as Spark array expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that join phrases; a label never ends with one.
CONNECTORS = ("and", "or", "/", "-", "&")
# Leading words that carry no meaning in a service type.
SKIP_PREFIXES = ("service", "request", "type", "for", "the", "a", "an")
# Stop words left out of keyword counts.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "what", "which", "who", "when", "where", "why", "how", "all",
    "each", "every", "some", "any", "no", "not", "only", "just",
    "more", "most", "very", "too", "so", "than", "then", "now",
)
# Letters, digits and underscore form words (Unicode aware, T21).
NON_WORD = r"[^\p{L}\p{N}_]+"


# The characters that Python's ``str.strip`` and ``str.split``
# take for white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
          + "\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Text without white space at its ends (``str.strip``)."""
    return F.btrim(_c(col), F.lit(SPACES))


def words(col) -> Column:
    """Whitespace-separated words (``str.split()``); empty array for blank."""
    t = strip(col)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(
        F.split(t, f"[{SPACES}]+"))


def is_connector(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"[.,;:]+$", "").isin(*CONNECTORS)


def meaningful(ws: Column) -> Column:
    return F.filter(ws, lambda w: ~F.lower(w).isin(*SKIP_PREFIXES))


def shorten(col, max_words: int = 3) -> Column:
    """At most ``max_words`` words: a short type loses trailing connectors; a
    long one keeps its first meaningful words (or first words when fewer
    than ``max_words`` are meaningful) up to the first connector.  Nothing
    left -> the original; null/empty -> ''."""
    s = _c(col)
    ws = words(s)
    n = F.size(ws)
    flags = F.transform(ws, is_connector)
    last_real = F.array_position(F.reverse(flags), F.lit(False))  # 0 = none
    keep_a = F.when(last_real == 0, F.lit(0)).otherwise(n - last_real + 1)
    short = F.when(keep_a > 0, F.array_join(F.slice(ws, 1, F.greatest(keep_a, F.lit(1))), " ")) \
             .otherwise(s)
    m = meaningful(ws)
    src = F.when(F.size(m) >= max_words, F.slice(m, 1, max_words)).otherwise(F.slice(ws, 1, max_words))
    cpos = F.array_position(F.transform(src, is_connector), F.lit(True))
    keep_b = F.when(cpos == 0, F.size(src)).otherwise(cpos - 1)
    long_ = F.when(keep_b > 0, F.array_join(F.slice(src, 1, F.greatest(keep_b, F.lit(1))), " ")) \
             .otherwise(s)
    return (F.when(s.isNull() | (s == ""), F.lit(""))
             .when(n <= max_words, short).otherwise(long_))


def is_simple(col) -> Column:
    """2-3 words, or 2-3 words once skip prefixes are removed."""
    ws = words(col)
    return (F.size(ws).between(2, 3)) | (F.size(meaningful(ws)).between(2, 3))


def keyword_tokens(col) -> Column:
    """Lower-cased words of 3+ ASCII letters, stop words removed."""
    pieces = F.split(F.lower(_c(col)), NON_WORD)
    return F.filter(pieces, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*STOP_WORDS))
