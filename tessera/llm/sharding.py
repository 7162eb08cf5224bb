"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until splitters fit, one exchange.

Rows have the key (hash of the text, number of the doc_id), so equal texts lie side by side, yet a group of copies with a third
of all rows still has boundaries inside. A whole-number doc_id is its own number; of other types it is a hash. Each round
counts, in one aggregation over the whole table, the bytes between candidate keys; only those counts (splitters x probes) reach the
driver. Probes then close in on the keys around each target, until the bytes below each splitter are within the tolerance, or no
key is left between its candidates. Rows move once, to tasks by ranges of keys, are sorted there, and their places in the
tasks and the counts of the tasks before give the slots, so a shard is in key order.

Law ``bytes``: the size of a row is its text's UTF-8 bytes plus 1, and shards get sizes near equal.

Defined results: a null text has size 1 and its own hash; an empty text has size 1; rows with equal text and doc_id
have one key and stay in one shard; null doc_ids come first among equal texts; an empty table gives an empty result; columns of
the input named ``_size``, ``_shard`` or ``_slot`` are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, read, settle

SHARDS = 8
#: Allowed distance of the bytes below a splitter from its target, as a part of one shard. A splitter also ends when a
#: single key lies between its candidates: no boundary does better then.
TOLERANCE = 0.002
PROBES = 16
#: A key is a number of 128 bits and each round leaves a splitter a sixteenth of its range: more rounds than that mean a fault.
ROUNDS = 200
#: Bytes of rows that one task sorts.
TASK_BYTES = 128 << 20

_LOW = (-(1 << 63), -(1 << 63))
_HIGH = ((1 << 63) - 1, (1 << 63) - 1)


def _below(hash_: Column, id_: Column, at: tuple[int, int]) -> Column:
    """Whether a key is below the boundary ``at``."""
    h, i = F.lit(at[0]).cast("long"), F.lit(at[1]).cast("long")
    return (hash_ < h) | ((hash_ == h) & (id_ < i))


def _between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n boundaries, evenly, that part the keys from ``low`` to ``high``."""
    a, b = (((x[0] + (1 << 63)) << 64) + x[1] + (1 << 63) for x in (low, high))
    cuts = sorted({a + 1 + (b - a - 1) * k // max(1, n - 1) for k in range(n)}) if b > a else []
    return [((c >> 64) - (1 << 63), (c & ((1 << 64) - 1)) - (1 << 63)) for c in cuts]


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list[tuple[int, int]], int, int]:
    """Boundaries between the shards of keys(_hash, _id, _size), the whole size and the number of rows."""
    total, rows = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    goals = [total * k // shards for k in range(1, shards)]
    slack = int(total / shards * tolerance)
    # for each goal: the least and the greatest key (plus 1) between which its splitter lies, and the best one so far
    low, high = [_LOW] * len(goals), [_HIGH] * len(goals)
    best = [min((abs(c - g), b) for b, c in ((_LOW, 0), (_HIGH, total))) for g in goals]
    for _ in range(ROUNDS):
        open_ = [k for k in range(len(goals)) if best[k][0] > slack]
        cuts = sorted({c for k in open_ for c in _between(low[k], high[k], probes)})
        if not cuts:
            break  # every open splitter has a single key at its target

        def place(a: int, b: int) -> Column:
            """Binary search: log2(cuts) comparisons a row."""
            if a == b:
                return F.lit(a)
            m = (a + b) // 2
            return F.when(_below(F.col("_hash"), F.col("_id"), cuts[m]), place(a, m)).otherwise(place(m + 1, b))

        counted = {}
        ends = [f(c) for c in ("_hash", "_id") for f in (F.min, F.max)]
        for spot, n, h0, h1, i0, i1 in keys.groupBy(place(0, len(cuts)).alias("place")).agg(F.sum("_size"), *ends).collect():
            # the ids bound the keys only where all have one hash
            counted[spot] = (n, (h0, i0 if h0 == h1 else _LOW[1]), (h1, i1 if h0 == h1 else _HIGH[1]))
        below = 0
        for i in range(len(cuts) + 1):
            if i:
                for k in open_:
                    best[k] = min(best[k], (abs(below - goals[k]), cuts[i - 1]))
            if i in counted:
                n, least, most = counted[i]
                # the keys of this place lie from the boundary below it to just under the one above it
                if i:
                    least = max(least, cuts[i - 1])
                if i < len(cuts):
                    h, j = cuts[i]
                    most = min(most, (h, j - 1) if j > _LOW[1] else (h - 1, _HIGH[1]))
                for k in open_:
                    # the splitter lies among the keys of this place: bounds close in on the keys that are there
                    if below <= goals[k] < below + n:
                        low[k], high[k] = max(low[k], least), min(high[k], most)
                below += n
    else:
        raise RuntimeError(f"splitters are not settled after {ROUNDS} rounds")
    return [b for _, b in best], total, rows


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``_size``, ``_shard`` and ``_slot`` (from 0 without gaps in each shard).

    ``keep``: with all columns; else the text does not move.
    """
    docs = docs.drop("_size", "_shard", "_slot")
    h, i, task, place_, s, t, o = free_names(docs, ["_hash", "_id", "_task", "_place", "_of_shard", "_of_task", "_first"])
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.coalesce(F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(_LOW[0]))
    sized = docs.withColumns({"_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, h: F.xxhash64(text), i: number})
    if not keep:
        sized = settle(sized.drop(text), "keys")
    keys = sized.select(F.col(h).alias("_hash"), F.col(i).alias("_id"), "_size")
    cuts, total, _ = splitters(keys if not keep else settle(keys, "keys"), shards, tolerance)
    shard_of = sum((F.when(_below(F.col(h), F.col(i), c), 0).otherwise(1) for c in cuts), F.lit(0)).cast("int")

    # the one exchange: ranges of keys, from a sample, decide only how even the tasks are
    tasks = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // task_bytes))
    placed = sized.repartitionByRange(tasks, h, i).sortWithinPartitions(h, i)
    # an id counts from 0 in each task, in its lower 33 bits
    placed = placed.withColumns({"_shard": shard_of, task: F.spark_partition_id(), place_: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = settle(placed.drop(h, i), "placed")
    # one row for each task and shard: where its rows begin in the shard
    counts = placed.select("_shard", task, place_).groupBy("_shard", task).agg(F.count("*").alias("n"), F.min(place_).alias("least"))
    before = Window.partitionBy("_shard").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).cast("long")
    starts = settle(counts.select(F.col("_shard").alias(s), F.col(task).alias(t), offset.alias(o)), "starts")
    # at most tasks + shards rows, and a task's rows lie together
    out = placed.join(F.broadcast(starts), (F.col("_shard") == F.col(s)) & (F.col(task) == F.col(t)))
    return out.withColumn("_slot", F.col(o) + F.col(place_)).select([c for c in placed.columns if c not in (task, place_)] + ["_slot"])


def op5_sharding(spark, sf_dir):
    """All documents in 8 shards of near equal bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return shard(docs, keep=False).select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
