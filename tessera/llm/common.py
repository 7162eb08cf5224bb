"""Shared helpers: reading, written intermediate tables, names that cannot clash, keys of any type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import BROADCAST_ROWS, dealt, lookup_join, scratch, settle

__all__ = ["BROADCAST_ROWS", "dealt", "free_names", "lookup_join", "read", "real_key", "scratch", "settle", "typed_key"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free_names(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def typed_key(key: str) -> Column:
    """A key of any type as a struct whose order is that of the key, null first."""
    return F.struct(F.col(key).isNotNull().alias("is"), F.col(key).alias("key"))


def real_key(typed: Column | str) -> Column:
    """The key back from ``typed_key``."""
    return (F.col(typed) if isinstance(typed, str) else typed)["key"]
