"""Joins with ledgers, filters with reasons, keyed loads, upserts, ordered text, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.evaluate import average_rank


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in order. Kept as an aggregate, so rows are combined before they move."""
    rest = [c for c in df.columns if c not in (key, order)]
    m = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order))
    return m.select(key, order, "r.*")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, order)]
    m = df.groupBy(*keys).agg(F.min(order).alias(order), *([F.min_by(F.struct(*rest), order).alias("r")] if rest else []))
    return m.select(*keys, order, *(["r.*"] if rest else []))


def eval_rows(df: DataFrame, state: str = "summary_success_state", score: str = "faithfulness_score") -> DataFrame:
    """Successful rows whose score is not 1; rows without a score stay."""
    return df.where((F.col(state) == "success") & ~F.col(score).eqNullSafe(F.lit(1.0)))


def in_domain(df: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Rows any of whose columns is the wanted domain but for case and outer spaces; '' wants all."""
    w = wanted.strip().lower()
    if not w:
        return df
    hit = F.lit(False)
    for c in columns:
        if c in df.columns:
            hit = hit | F.coalesce(F.lower(F.trim(F.col(c))) == w, F.lit(False))
    return df.where(hit)


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], ident: str) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and a ledger (sample_id, reason) with the first rule that holds."""
    reason = F.coalesce(*[F.when(cond, name) for name, cond in rules]) if rules else F.lit(None).cast("string")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(F.col(ident).alias("sample_id"), "reason")


def human_label(has_error: Column, intrinsic: Column, extrinsic: Column) -> Column:
    """1 without error, 0 with; null if nothing is known."""
    return F.when(has_error.isNotNull(), 1 - has_error.cast("int")).when(intrinsic.isNull() & extrinsic.isNull(), F.lit(None)).otherwise(F.when(F.coalesce(intrinsic, F.lit(False)) | F.coalesce(extrinsic, F.lit(False)), 0).otherwise(1))


def unpivot_sections(df: DataFrame, ident: str, source: str, kinds: list[str]) -> DataFrame:
    """A row for each summary kind that is present; ids get _kind only where there is more than one; blanks go."""
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    n = sum((has(k).cast("int") for k in kinds), F.lit(0))
    rows = df.withColumn("_n", n).select(ident, source, "_n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("summary")) for k in kinds])).alias("x")).select(ident, source, "_n", "x.*")
    rows = rows.where(has("summary") & has(source))
    return rows.select(F.when(F.col("_n") > 1, F.concat_ws("_", F.col(ident).cast("string"), "kind")).otherwise(F.col(ident).cast("string")).alias("id"), "kind", "summary")


def resume(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Merges a map column: keys of ``changes`` win."""
    empty = F.create_map().cast(dict(base.dtypes)[column])
    a, b = base.select(key, F.col(column).alias("_a")), changes.select(key, F.col(column).alias("_b"))
    old = F.coalesce("_a", empty)
    return a.join(b, key, "full").select(key, F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("_b", k), F.lit(False))), F.coalesce("_b", empty)).alias(column))


def guarded_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Full outer join of two score tables with status and reasons; keys that repeat on a side are excluded.

    Inputs have ``status`` (ok or not) and a score.
    """
    def side(df: DataFrame, v: str, s: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n" + s), F.max(F.col("status") == "ok").alias("ok" + s), F.min(v).alias("v" + s))

    j = side(left, x, "_x").join(side(right, y, "_y"), keys, "full")
    bad = lambda s: T.finite("v" + s).isNull() & F.col("n" + s).isNotNull()
    reasons = F.concat_ws(
        "|",
        F.when(F.col("n_x").isNull(), "missing_left"), F.when(F.col("n_y").isNull(), "missing_right"),
        F.when((F.col("n_x") > 1) | (F.col("n_y") > 1), "many_to_many"),
        F.when(~F.col("ok_x"), "left_failed"), F.when(~F.col("ok_y"), "right_failed"),
        F.when(bad("_x") & F.col("ok_x"), "left_not_finite"), F.when(bad("_y") & F.col("ok_y"), "right_not_finite"),
    )
    return j.select(*keys, F.when(reasons == "", F.col("v_x")).alias(x), F.when(reasons == "", F.col("v_y")).alias(y), F.when(reasons == "", "ok").otherwise("excluded").alias("status"), reasons.alias("reason"))


def pair_ledger(candidate: DataFrame, human: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """candidate ⟗ human ⟕ labels with a status: ok, missing_pair or missing_label."""
    j = candidate.join(human, key, "full").join(labels.withColumn("_l", F.lit(True)), key, "left")
    c, h = [x for x in candidate.columns if x != key][0], [x for x in human.columns if x != key][0]
    return j.withColumn("ledger", F.when(F.col(c).isNull() | F.col(h).isNull(), "missing_pair").when(F.col("_l").isNull(), "missing_label").otherwise("ok")).drop("_l")


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default, order: str) -> DataFrame:
    """Left join with a map read line by line: the last line of a key wins, unmatched rows get the default."""
    m = last_wins(lookup.select(key, order, value), key, order).select(key, value)
    return df.join(m, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def prediction_quality(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Counts of labels with a usable prediction and without: missing, failed, or no score."""
    j = labels.select(key).distinct().join(predictions.select(key, "score", "error", F.lit(True).alias("_p")), key, "left")
    return j.agg(F.count("*").alias("n_labels"), F.count_if(F.col("score").isNotNull() & F.col("error").isNull()).alias("n_valid"), F.count_if(F.col("_p").isNull()).alias("n_missing"), F.count_if(F.col("_p").isNotNull() & (F.col("score").isNull() | F.col("error").isNotNull())).alias("n_invalid"))


def bundle_problems(candidates: DataFrame, references: DataFrame, events: DataFrame, systems: list[str]) -> DataFrame:
    """(problem, event, system): repeated candidates, and candidates or references that an event lacks."""
    s = events.sparkSession.createDataFrame([(x,) for x in systems], "system string")
    dup = candidates.groupBy("event", "system").count().where("count > 1").select(F.lit("duplicate_candidate").alias("problem"), "event", "system")
    want = events.select("event").distinct().join(s)  # systems are a list in the configuration
    miss = want.join(candidates.select("event", "system"), ["event", "system"], "left_anti").select(F.lit("missing_candidate").alias("problem"), "event", "system")
    ref = events.select("event").distinct().join(references.select("event"), "event", "left_anti").select(F.lit("missing_reference").alias("problem"), "event", F.lit(None).cast("string").alias("system"))
    return dup.unionByName(miss).unionByName(ref)


def greedy_match(left: DataFrame, right: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """One-to-one matches of texts within a key, best ratio first (ties: earlier left, later right).

    left(key, i, text), right(key, j, text). Candidates are compared within their key by SequenceMatcher.
    """
    a = left.select(key, "i", T.squeeze("text").alias("a"))
    b = right.select(key, "j", T.squeeze("text").alias("b"))
    scored = a.join(b, key).withColumn("ratio", T.sequence_ratio("a", "b")).where(F.col("ratio") >= least)
    kinds = dict(scored.dtypes)

    def match(pdf):
        used_i, used_j, rows = set(), set(), []
        for r in pdf.sort_values(["ratio", "i", "j"], ascending=[False, True, False]).itertuples():
            if r.i not in used_i and r.j not in used_j:
                used_i.add(r.i)
                used_j.add(r.j)
                rows.append(r.Index)
        return pdf.loc[rows, [key, "i", "j", "ratio"]]

    return scored.drop("a", "b").groupBy(key).applyInPandas(match, f"`{key}` {kinds[key]}, i {kinds['i']}, j {kinds['j']}, ratio double")


def ordered_text(df: DataFrame, key: str, text: str, time: str, pos: str) -> DataFrame:
    """Per key: texts by time (if any row has one, blanks last) or else by position, without blanks and repeats, joined by
    line ends; with numbers of rows, kept rows, and the mode."""
    t = T.time_key(time)
    rows = df.select(key, F.trim(F.col(text)).alias("_t"), pos, t.alias("_k"))
    mode = rows.groupBy(key).agg(F.min("_k.missing").alias("blank"), F.count("*").alias("n_raw"), F.count_if(F.coalesce(F.col("_t"), F.lit("")) == "").alias("n_empty"))
    live = rows.where(F.coalesce(F.col("_t"), F.lit("")) != "").join(mode.select(key, "blank"), key)
    at = F.struct(F.when(F.col("blank") == 0, F.col("_k.missing")).otherwise(0).alias("m"), F.when(F.col("blank") == 0, F.col("_k.key")).otherwise("").alias("k"), F.col(pos).alias("p"))
    first = live.groupBy(key, "_t").agg(F.min(at).alias("at"))
    joined = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_t"))), lambda x: x["_t"]), "\n").alias("source_text"), F.count("*").alias("n_kept"))
    return mode.join(joined, key, "left").select(key, "n_raw", "n_empty", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.when(F.col("blank") == 0, "timestamp").otherwise("original_order").alias("sort_mode"), F.coalesce("source_text", F.lit("")).alias("source_text"))


def top_paragraphs(df: DataFrame, key: str, text: str, query: str, most: int = 5, fallback: int = 3, chars: int = 12_000) -> DataFrame:
    """The paragraphs with most of the query's words (if any share one, else the first ones), in document order, clipped."""
    p = df.select(key, F.array_distinct(T.words(query)).alias("q"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "p")).where(F.trim("p") != "")
    p = p.withColumn("hit", F.size(F.array_intersect("q", T.words("p"))))
    some = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("hit")).alias("h"), "i", "p"))).alias("all"))
    hits = F.filter("all", lambda x: x["h"] < 0)
    chosen = F.when(F.size(hits) > 0, F.slice(hits, 1, most)).otherwise(F.slice(F.array_sort(F.transform("all", lambda x: F.struct(F.lit(0).alias("h"), x["i"].alias("i"), x["p"].alias("p")))), 1, fallback))
    text_ = F.array_join(F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"]), "\n")
    return some.select(key, F.substring(text_, 1, chars).alias("evidence"))


def full_coverage_ranking(df: DataFrame, system: str, event: str, score: str) -> DataFrame:
    """(system, n_events, mean, full, rank): ranks by mean, best first, only among systems with every event."""
    n = df.select(event).distinct().agg(F.count("*").alias("all"))
    m = df.groupBy(system).agg(F.countDistinct(event).alias("n_events"), F.avg(score).alias("mean")).join(F.broadcast(n))  # one row
    m = m.withColumn("full", F.col("n_events") == F.col("all"))
    ranked = m.where("full").withColumn("rank", average_rank("mean", descending=True)).select(system, "rank")
    return m.join(ranked, system, "left").select(system, "n_events", "mean", "full", "rank")


def ranking_agreement(df: DataFrame, system: str, a: str, b: str, top: int = 3) -> DataFrame:
    """Mean distance of ranks, whether the best agrees, and overlap and Jaccard of the top systems (null for fewer)."""
    r = df.select(system, average_rank(a, descending=True).alias("ra"), average_rank(b, descending=True).alias("rb"), F.row_number().over(Window.orderBy(F.desc(a), system)).alias("pa"), F.row_number().over(Window.orderBy(F.desc(b), system)).alias("pb"))
    both = F.count_if((F.col("pa") <= top) & (F.col("pb") <= top))
    n, mx, my = F.count("*"), F.avg("ra"), F.avg("rb")
    cov, vx, vy = F.avg(F.col("ra") * F.col("rb")) - mx * my, F.avg(F.col("ra") * F.col("ra")) - mx * mx, F.avg(F.col("rb") * F.col("rb")) - my * my
    # systems are few, so their pairs are compared
    q = r.select(F.col(system).alias("s2"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    signs = r.join(q, F.col(system) < F.col("s2")).select(F.signum(F.col("ra") - F.col("ra2")).alias("a"), F.signum(F.col("rb") - F.col("rb2")).alias("b"))
    tau = signs.agg(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.abs("a")) * F.sum(F.abs("b")))).alias("tau"))
    return tau.crossJoin(r.agg(  # one row each
        F.when(n >= 2, F.try_divide(cov, F.sqrt(vx * vy))).alias("rho"), F.count("*").alias("n"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("mean_rank_distance"), (F.count_if((F.col("pa") == 1) & (F.col("pb") == 1)) == 1).alias("top1_match"),
        F.when(F.count("*") >= top, both).alias("top_overlap"), F.when(F.count("*") >= top, both / (2.0 * top - both)).alias("top_jaccard"),
    ))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): union of keys with ``both``, ``left`` or ``right``."""
    j = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full")
    return j.select(*keys, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def tagged_union(parts: dict[str, DataFrame], line: str, ident: str) -> DataFrame:
    """Union with a source tag and ids source__id__Lline."""
    out = None
    for name, df in sorted(parts.items()):
        d = df.withColumn("source_file", F.lit(name)).withColumn("row_id", F.concat(F.lit(f"{name}__"), F.col(ident).cast("string"), F.lit("__L"), F.col(line).cast("string")))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def scores_with_labels(scores: DataFrame, labels: DataFrame, key: str, state: str, human: str, score: str, exclude_perfect: bool = True) -> DataFrame:
    """labels(key, state, human) with a reason each: skip_state, skip_score1, missing_sim, or used where both scores are there. scores(key, score)."""
    perfect = F.coalesce(F.col(human) == 1, F.lit(False)) if exclude_perfect else F.lit(False)
    j = labels.select(key, state, human).join(scores.select(key, score), key, "left")
    why = F.when(~F.coalesce(F.col(state) == "success", F.lit(False)), "skip_state").when(perfect, "skip_score1").when(F.col(score).isNull() | F.col(human).isNull(), "missing_sim").otherwise("used")
    return j.withColumn("why", why)


def attach_scores(lines: DataFrame, files: DataFrame, key: str, column: str, metric: str) -> DataFrame:
    """A map column with one more metric where there is a file for the key: its value, null where the file lacks it. files(key, value)."""
    found = files.groupBy(key).agg(F.first("value").alias("_v"), F.lit(True).alias("_there"))
    old = F.coalesce(F.col(column), F.create_map().cast(dict(lines.dtypes)[column]))
    new = F.map_concat(F.map_filter(old, lambda k, _: k != metric), F.create_map(F.lit(metric), F.col("_v")))
    return lines.join(found, key, "left").withColumn(column, F.when(F.col("_there"), new).otherwise(F.col(column))).drop("_v", "_there")


def match_ledger(left: DataFrame, right: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, i, reason) of left rows without a match: no_label where the key has no right row, else below_threshold."""
    there = right.select(key).distinct().withColumn("_r", F.lit(True))
    return left.join(matches.select(key, "i"), [key, "i"], "left_anti").join(there, key, "left").select(key, "i", F.when(F.col("_r").isNull(), "no_label").otherwise("below_threshold").alias("reason"))
