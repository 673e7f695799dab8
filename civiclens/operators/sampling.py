"""Sampling and reduction: share-sized cuts in a total order, exactly.

``orderBy().limit(n)`` is right for a top-k report (small n).  When n is a
share of the table (keep 50 %, delete the oldest 30 %) the cut is found from
histograms instead: counts per slice of the order's first key, a running sum
over that small frame, and again inside the one slice in which the n-th row
lies, key after key, until few rows are left.  What comes out is the n-th
row's key, so the cut itself is one filter: no row is sorted or moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices of one histogram; rows that may be sorted to end the search.
SLICES = 1 << 16
FEW_ROWS = 10_000


def _slice_of(pool: DataFrame, key: Column, n: int, low: int, high: int) -> tuple[int, int, int, int]:
    """(low, high, rows before, rows) of the slice of ``key`` that holds the
    n-th row."""
    width = -(-(high - low + 1) // SLICES)
    number = F.floor((key - F.lit(low)) / width) if high - low < 1 << 52 else F.shiftright(
        key, (width - 1).bit_length()).cast("long")
    counts = pool.groupBy(number.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"),
                                                F.max(key).alias("high"))
    upto = F.sum("rows").over(Window.orderBy("s"))  # at most SLICES rows
    return tuple(counts.select("low", "high", (upto - F.col("rows")).alias("before"), "rows", upto.alias("upto"))
                 .filter(F.col("upto") >= n).orderBy("upto").first())[:4]


def nth_key(df: DataFrame, n: int, keys: Sequence[Column]) -> tuple[int, ...] | None:
    """The ``keys`` (long columns, ascending, a total order together) of the
    n-th row; None when the table has at most n rows."""
    pool = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    cols = [F.col(f"k{i}") for i in range(len(keys))]
    if pool.count() <= n:
        return None
    for key in cols:
        low, high, rows = pool.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        while low < high:
            if rows <= FEW_ROWS:
                return tuple(pool.orderBy(*cols).limit(n).tail(1)[0])
            low, high, before, rows = _slice_of(pool, key, n, low, high)
            n -= before
            pool = pool.filter(key.between(low, high))
    return tuple(pool.first())  # rows alike in all keys


def up_to(keys: Sequence[Column], cut: Sequence[int]) -> Column:
    """Rows whose keys are not beyond ``cut``."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, cut, strict=True))):
        out = (key < F.lit(value)) | ((key == F.lit(value)) & out)
    return out


def first_n(df: DataFrame, n: int, keys: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``."""
    if n <= 0:
        return df.filter(F.lit(False))
    cut = nth_key(df, n, keys)
    return df if cut is None else df.filter(up_to(keys, cut))


def share_count(df: DataFrame, percent: float) -> int:
    """``int(count * percent / 100)``."""
    return int(df.count() * percent / 100)


def hash_order(id_col: str, seed: int = 42) -> Column:
    """Reproducible pseudo-random order: md5 of the id and the seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_keys(id_col: str, seed: int = 42) -> list[Column]:
    """The md5 order as two integers of 60 bits each."""
    digest = hash_order(id_col, seed)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def sample_percent(df: DataFrame, percent: float, id_col: str, seed: int = 42) -> DataFrame:
    """Keep ``int(n * percent / 100)`` rows chosen by the md5 order (id
    breaks md5 ties); ``id_col`` must be a unique integer."""
    return first_n(df, share_count(df, percent), [*hash_keys(id_col, seed), F.col(id_col)])


def sample_approx(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample of about ``percent`` % (no exact size, no shuffle)."""
    return df.sample(fraction=percent / 100.0, seed=seed)


def every_nth(df: DataFrame, id_col: str = "id", n: int = 6) -> DataFrame:
    """Systematic 1-in-n sample: ``id % n = 0``."""
    return df.filter(F.pmod(F.col(id_col), F.lit(n)) == 0)


def reduce_ids(df: DataFrame, strategy: str = "oldest", percent: float = 50,
               id_col: str = "id", created: str = "created_at", seed: int = 42) -> DataFrame:
    """Ids to delete: ``int(total * percent / 100)`` (total = all rows) of
    the oldest / newest (created not null, id breaks ties) or md5-random."""
    n, when, i = share_count(df, percent), F.unix_micros(F.col(created).cast("timestamp")), F.col(id_col)
    if strategy not in ("oldest", "newest", "random"):
        raise ValueError(f"Unknown strategy: {strategy}")
    if strategy == "random":
        return first_n(df, n, [*hash_keys(id_col, seed), i]).select(id_col, created)
    dated = df.filter(F.col(created).isNotNull())
    return first_n(dated, n, [when if strategy == "oldest" else -when, i]).select(id_col, created)


def reduce_keep(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The table after the delete: an anti join on the id."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def reduce_preview(df: DataFrame, ids: DataFrame, id_col: str = "id",
                   created: str = "created_at", k: int = 10) -> DataFrame:
    """Dry run: ten doomed rows by created date plus the total count."""
    doomed = df.join(ids.select(id_col), id_col, "left_semi")
    total = ids.select(F.count(F.lit(1))).scalar()
    return (doomed.select(id_col, "service_type", created)
                  .orderBy(F.asc(created), F.asc(id_col)).limit(k)
                  .withColumn("would_delete", total))


def clear_clusters(df: DataFrame, cols: Sequence[str] = ("top_cluster_id", "sub_cluster_id")) -> DataFrame:
    """``UPDATE ... SET cluster columns = NULL`` as a projection."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.lit(None).cast("int"))
    return out


def empty_like(df: DataFrame) -> DataFrame:
    """``DELETE FROM clusters``: same schema, no rows (written with overwrite)."""
    return df.limit(0)
