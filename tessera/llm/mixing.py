"""Mixing sources to target weights by repetition rates.

Tokens are summed per source; every source gets a target and so a repetition rate; each document is then
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.

A single seed leaves a source with few long documents far from its target, so SEEDS seeds are drawn for every
document in the one pass that sums, and each source uses the seed whose copies come nearest to its target
(the first of equals). Every copy stays a Bernoulli draw of the document's own hash.

Defined results: a null text has no token and is emitted like any other document; a null source is a source
of its own, last in order; sources without any token have target 0 and rate 0; rows that repeat draw alike; an
empty table gives an empty result; columns of the input named ``_size``, ``_source_size``, ``_target``, ``_rate`` or ``_copies``
are replaced, all others stay; keys of any type draw by their text. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, lookup_join, read, settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2.0
SEEDS = 16
#: Stands for a null source where sources are joined.
_NULL = "\x00null"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: Column | int) -> Column:
    """Uniform number in [0, 1) of a document's key and a seed: the first 32 bits of an MD5."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    h = F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target, rate) of sizes(source_key, source_size), one row for each source.

    Sources in code-point order take the weights in turn and share ``budget`` times all tokens; a target stops
    at ``most`` times its source's size and the excess is shared again. That ends where every open source has
    level * weight: with sources by rising cap / weight, the capped ones come first, and the level is the largest of
    those that running sums give for each number of capped sources. One row a source, so the single ordered partition holds sources, not documents.
    """
    order = Window.orderBy(F.col("source_key") == _NULL, "source_key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source_key") == _NULL, "source_key")
    every = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("before", F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("level_here", (F.lit(budget) * F.col("all_size") - F.lit(most) * F.col("before")) / F.col("open_w"))
        .withColumn("level", F.max("level_here").over(every))
    )
    target = F.when(F.col("level") * F.col("w") > F.col("cap"), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return s.select("source_key", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """(source_key, source_size, target, rate, seed) of sized(key, source_key, size).

    Sums are made per task before rows move, so a source with a third of all rows is no hot key.
    """
    rates = settle(targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, budget, most), "rates")
    drawn = lookup_join(sized, rates.select("source_key", "rate"), "source_key").withColumn("part", F.col("rate") - F.floor("rate"))
    taken = drawn.groupBy("source_key").agg(
        F.array(*[F.sum(F.when(draw(F.col("key"), k) < F.col("part"), F.col("size")).otherwise(0)) for k in range(seeds)]).alias("extra")
    )
    off = F.transform("extra", lambda x, k: F.struct(F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")).alias("off"), k.alias("seed")))
    return rates.join(taken, "source_key").select("source_key", "source_size", "target", "rate", F.array_min(off)["seed"].alias("seed"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: bool = True, **how) -> DataFrame:
    """Every row of ``docs`` with ``_size``, ``_source_size``, ``_target``, ``_rate`` and ``_copies``. ``keep``: with all columns; else without the text."""
    docs = docs.drop("_size", "_source_size", "_target", "_rate", "_copies")
    at, seed = free_names(docs, ["_source_key", "_seed"])
    sized = docs.withColumns({"_size": words(F.col(text)), at: F.coalesce(F.col(source).cast("string"), F.lit(_NULL))})
    if not keep:  # the words are then counted once
        sized = settle(sized.drop(text), "sized")
    skinny = sized.select(F.col(key).alias("key"), F.col(at).alias("source_key"), F.col("_size").alias("size"))
    p = settle(plan(skinny if not keep else settle(skinny, "sizes"), **how), "plan").select(
        F.col("source_key").alias(at), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"), F.col("seed").alias(seed)
    )
    extra = F.when(draw(F.col(key), F.col(seed)) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return lookup_join(sized, p, at).withColumn("_copies", (F.floor("_rate") + extra).cast("int")).drop(at, seed)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row ``_copies`` times, without the operator's columns."""
    (copy,) = free_names(mixed, ["_copy"])
    rows = mixed.where("_copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.drop(copy, "_size", "_source_size", "_target", "_rate", "_copies")


def op10_mixing(spark, sf_dir):
    """All documents with the words that the mix takes of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=False).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken")
    )


def op10_sql() -> str:
    """DuckDB SQL for op10_mixing."""
    u = "('0x' || substr(md5({s} || ':' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint::double / 4294967296.0"
    return f"""
    with d as (select doc_id, source, coalesce(source, chr(0) || 'null') as k, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
    a as (select k, sum(size)::bigint as source_size from d group by k),
    b as (select k, source_size, ([5.0::double, 2.0::double, 1.0::double])[((row_number() over (order by k = chr(0) || 'null', k) - 1) % 3 + 1)::bigint] as w from a),
    c as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as ratio from b),
    e as (select *, coalesce(sum(source_size) over (order by ratio, k = chr(0) || 'null', k rows between unbounded preceding and 1 preceding), 0)::bigint as before,
                 sum(w) over (order by ratio, k = chr(0) || 'null', k rows between current row and unbounded following) as open_w,
                 (sum(source_size) over ())::bigint as all_size from c),
    f as (select *, (1.5::double * all_size - 2.0::double * before) / open_w as here from e),
    g as (select *, max(here) over () as level from f),
    h as (select k, source_size, case when level * w > cap then cap else level * w end as target from g),
    r as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from h),
    t as (select d.k, s.s as seed, sum(case when {u.format(s="s.s")} < rate - floor(rate) then size else 0 end) as extra
          from d join r using (k), range({SEEDS}) s(s) group by d.k, s.s),
    q as (select k, arg_min(seed, (abs(floor(rate) * source_size + extra - target), seed)) as seed from t join r using (k) group by k)
    select doc_id, size, source_size, target,
           (size * (floor(rate) + case when {u.format(s="seed")} < rate - floor(rate) then 1 else 0 end))::bigint as taken
    from d join r using (k) join q using (k)"""
