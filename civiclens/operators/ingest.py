"""Ingest: required columns/rows, date parsing, description/location,
cleaning into the ``requests`` schema, first-wins de-duplication, stats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from civiclens.functions.text import strip
from civiclens.functions.timecalc import parse_date

# Columns a raw file must carry.
REQUIRED_COLUMNS = ("Service Request ID", "Reference Number", "Service Type", "Date Created",
                    "Date Closed", "Electoral District", "Neighbourhood")
REQUIRED_VALUES = ("Service Request ID", "Service Type", "Date Created")
LEVEL_COLUMNS = tuple(f"Service Level {i}" for i in range(1, 6))
# Raw columns that ``clean`` reads.
CLEAN_COLUMNS = (*REQUIRED_COLUMNS, *LEVEL_COLUMNS)


class MissingColumnsError(ValueError):
    pass


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Schema check only (no job): required names absent from ``df``."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    miss = missing_columns(df, required)
    if miss:
        raise MissingColumnsError(f"missing required columns: {miss}")
    return df


def column_report(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column: whether it exists and how many rows hold
    a value (one aggregate over the table; missing columns count null)."""
    have = set(df.columns)
    present = [c for c in required if c in have]
    counts = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(present)]) if present else None
    rows = []
    for c in required:
        if c in have:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"),
                                 F.col(f"c{present.index(c)}").alias("non_null_rows")))
        else:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("present"),
                                 F.lit(None).cast("long").alias("non_null_rows")))
    base = counts if counts is not None else df.sparkSession.range(1)
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def required_rows(df: DataFrame, subset: Sequence[str] = REQUIRED_VALUES) -> DataFrame:
    """Rows with all required values non-null (``dropna(subset)``)."""
    return df.dropna(subset=list(subset))


def q(name: str) -> F.Column:
    return F.col(f"`{name}`")


def _present(c: F.Column) -> F.Column:
    """Trimmed text, null when null or blank."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def description(levels: Sequence[str] = LEVEL_COLUMNS) -> F.Column:
    """Non-blank trimmed levels joined with ' > '; null when none."""
    return F.nullif(F.concat_ws(" > ", *[_present(q(c)) for c in levels]), F.lit(""))


def location(district: str = "Electoral District", hood: str = "Neighbourhood") -> F.Column:
    """District and neighbourhood (trimmed, nulls skipped) joined with ', '."""
    return F.nullif(F.concat_ws(", ", strip(q(district)), strip(q(hood))), F.lit(""))


def clean(raw: DataFrame, keep: Sequence[str] = (), seen: Observation | None = None) -> DataFrame:
    """Raw rows -> ``requests`` schema.  Skipped: missing/empty id or type,
    created date that does not parse.  ``keep`` passes extra columns through
    (e.g. a stable row order for de-duplication).

    With ``seen`` the job that uses the result also counts what it read,
    accepted and skipped (the columns of ``clean_counts``), in the same pass."""
    sid, stype = q("Service Request ID"), q("Service Type")
    named = (sid.isNotNull() & (sid.cast("string") != "") & stype.isNotNull()
             & (stype.cast("string") != ""))
    if seen is None:
        rows, created = raw.filter(named), parse_date(q("Date Created"))
    else:
        marked = raw.withColumns({"_named": F.coalesce(named, F.lit(False)), "_created": parse_date(q("Date Created"))})
        dated = F.col("_created").isNotNull()
        rows = marked.observe(
            seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("_named") & dated).alias("accepted"),
            F.count_if(~F.col("_named")).alias("skipped_missing"),
            F.count_if(F.col("_named") & ~dated).alias("skipped_date")).filter("_named")
        created = F.col("_created")
    ref = q("Reference Number").cast("string")
    out = rows.select(
        *[F.col(k) for k in keep],
        strip(sid.cast("string")).alias("service_request_id"),
        F.when(ref.isNull() | (ref == ""), F.lit(None)).otherwise(strip(ref)).alias("ref_number"),
        strip(stype.cast("string")).alias("service_type"),
        description().alias("description"),
        created.alias("created_at"),
        parse_date(q("Date Closed")).alias("resolved_at"),
        location().alias("location"))
    return out.filter(F.col("created_at").isNotNull())


def load_clean(raw: DataFrame, path: str, keep: Sequence[str] = ()) -> dict[str, int]:
    """Writes the cleaned rows and returns the counts of that same job."""
    seen = Observation()
    clean(raw, keep, seen).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def load_required(raw: DataFrame, path: str, subset: Sequence[str] = REQUIRED_VALUES) -> dict[str, int]:
    """Writes the rows with all required values; ``total`` and ``dropped`` are
    counted by the writing job."""
    seen = Observation()
    missing = ~F.coalesce(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in subset]), F.lit(False))
    watched = raw.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("dropped"))
    required_rows(watched, subset).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def clean_counts(raw: DataFrame) -> DataFrame:
    """What ``clean`` accepts and why it skips the rest, in one aggregate."""
    sid, stype = q("Service Request ID").cast("string"), q("Service Type").cast("string")
    named = F.coalesce((sid != "") & (stype != ""), F.lit(False))
    dated = parse_date(q("Date Created")).isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(named & dated).alias("accepted"),
                   F.count_if(~named).alias("skipped_missing"), F.count_if(named & ~dated).alias("skipped_date"))


def dedupe_first(df: DataFrame, key: str, order: Sequence[str],
                 existing: DataFrame | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING``: the first row per key in
    ``order`` wins, and keys already in ``existing`` are left out.

    ``min`` over a struct is a declarative aggregate, so each map task keeps
    one row per key before the shuffle: a key holding a large share of the rows
    costs one row per task, not one giant group.  The struct begins with
    ``order`` and holds each column once; rows alike in ``order`` go by the
    columns after it, so a rerun takes the same one.  Columns without an order
    (maps) are taken by ``min_by``, which moves ``order`` twice.  The anti join
    against ``existing`` only needs its key column.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    unordered = any("map<" in df.schema[c].dataType.simpleString() or "variant" in df.schema[c].dataType.simpleString()
                    for c in rest)
    winner = F.min_by(row, F.struct(*[F.col(c) for c in order])) if unordered else F.min(row)
    first = df.groupBy(key).agg(winner.alias("_r")).select(
        *[key if c == key else F.col(f"_r.{c}") for c in df.columns])
    if existing is not None:
        first = first.join(existing.select(key).distinct(), key, "left_anti")
    return first


def request_stats(df: DataFrame, created: str | None = "created_at") -> DataFrame:
    """Totals of a loaded ``requests`` table in one aggregate: rows, those with a
    vector, a cluster and a place in the plot where the columns exist, and the
    span of dates."""
    extra = []
    if "x_2d" in df.columns:
        extra.append(F.count_if(F.col("x_2d").isNotNull()).alias("with_projection"))
    if "embedding" in df.columns:
        extra.append(F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"))
    if "top_cluster_id" in df.columns:
        extra.append(F.count_if(F.col("top_cluster_id").isNotNull()).alias("with_clusters"))
    if created is not None:
        extra += [F.min(created).alias("min_date"), F.max(created).alias("max_date")]
    return df.agg(F.count(F.lit(1)).alias("total"), *extra)
