"""Intermediate tables in the folder that the cluster shares, and helpers that look at a table's size first."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only after a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000
#: Salts of the other way, when the small side is larger than that.
SALTS = 16

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where driver and executors are one process may it be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/tessera"


def settle(df: DataFrame, name: str = "t", group: int | None = None) -> DataFrame:
    """Writes a table that several later steps read, and reads it back: it is made once, its lineage is cut, and a lost executor
    loses nothing. The files go at the end of the ``scratch`` around the call, else when the session's Python process ends.

    ``group``: bytes of a row group, for wide rows; a reader holds up to 4,096 rows of one group at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    options = {} if group is None else {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 100}
    df.write.options(**options).parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes what ``settle`` writes inside, at its end. Write or collect results inside it."""
    start = len(_written)
    try:
        yield
    finally:
        _clean(start)


def settled(make: Callable[[], DataFrame], name: str = "t") -> DataFrame:
    """``settle`` of what ``make`` returns; all other tables that it has written on its way are deleted."""
    start = len(_written)
    out = settle(make(), name)
    last = _written.pop()
    _clean(start)
    _written.append(last)
    return out


def _clean(start: int = 0) -> None:
    while len(_written) > start:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is already gone
            continue


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer splits than there are cores, dealt out over all cores; other tables as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup_join(left: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` with a per-key table.

    The table is counted first: up to BROADCAST_ROWS rows it is broadcast, beyond that the join is
    salted, so that a key with a third of all rows is still spread over SALTS tasks. ``how``: inner or left.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), key, how)
    salt = f"_salt_{uuid.uuid4().hex}"
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, salt], how).drop(salt)
