"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.session import checkpoint_dir

#: The six ASCII white-space characters that separate words (fixed values).
WHITESPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null text: none)."""
    plain = F.translate(F.coalesce(text, F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(plain, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is a bound value, so an array built for one step of an
    expression is not rebuilt for each element of the next.
    """
    return F.transform(F.array(value), body)[0]


def pack_row(df: DataFrame, *extra: Column) -> DataFrame:
    """All columns in one struct ``row`` beside the helper columns ``extra``,
    so that no input name can clash with a helper's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def unpack_row(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``row`` again; ``replaced`` overrides or appends some."""
    kept = [replaced.pop(c).alias(c) if c in replaced else F.col("row").getField(c).alias(c)
            for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in replaced.items()])


def carried(df: DataFrame, without: list[str]) -> tuple[Column, list[str]]:
    """The other columns of ``df`` as one struct with fields named by position
    (so no name can clash, and it is never empty), and their names."""
    kept = [c for c in df.columns if c.lower() not in {w.lower() for w in without}]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    return F.struct(F.lit(0).alias("none"), *fields).alias("row"), kept


def restored(df: DataFrame, kept: list[str], *more: str) -> DataFrame:
    """The columns taken by ``carried`` and those named."""
    back = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept) if c.lower() not in more]
    return df.select(*back, *more)


def positional(df: DataFrame, text: str, *keys: str) -> tuple[DataFrame, list[str]]:
    """The other columns named ``c0, c1, ...`` with ``text`` (and copies of
    ``keys`` as ``key0, ...``) beside them, and their own names, for
    ``renamed``: no input name can clash with a helper's."""
    kept = [c for c in df.columns if c != text]
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
                     *[F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)],
                     F.col(f"`{text}`").alias("text")), kept


def renamed(df: DataFrame, kept: list[str], *more: str) -> DataFrame:
    """The columns of ``positional`` under their names, and those of ``more``,
    which replace input columns so named."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if c not in more], *more)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new folder for a table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a
    checkpoint, and read back by column."""
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of their place and compressed."""
    return zstandard.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(data), "u1")
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<u4").ravel()


def flat_lists(flat: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``code`` of a flat array, joined, and their lengths."""
    start = np.cumsum(length) - length
    n = length[code]
    total = int(n.sum())
    if not total:
        return flat[:0], n
    shift = np.repeat(start[code] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total)], n


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
