"""Secret scans: an incremental blob ledger over DataFrames only (no Python on the executors).

Every version of a text is addressed by its SHA-256. A ledger holds the (blob, rule version) pairs that
were scanned before, with what was found; a run scans only pairs that the ledger lacks, each blob once
however many paths hold it, and joins findings back to all paths.

Defined results: a null text counts as empty; an empty text has no span; equal rows give equal rows; an
empty table gives an empty result; further columns of the input are carried along by ``findings_by_path``
unless they clash with its own (``blob``, ``spans``), which then win. Very long texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup_join, read, settle


@dataclass(frozen=True)
class Rule:
    """``pattern``: regex (read alike by Java and RE2) whose matches have positive width. ``by_value``: a match
    stays only if its value has 8 characters."""

    kind: str
    version: int
    pattern: str
    by_value: bool = False
    base: bool = False


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which spans of equal start are listed. The quantified forms of ``access`` and ``hex`` match
#: the same maximal runs as an open ``+`` filtered by length; ``assign`` keeps the open form, because a match
#: that is too short still uses up its text.
RULES = (
    Rule("assign", 1, _ASSIGN, True, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", False, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", False, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[0-9A-Za-z-]{20,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: Matches of a text that are listed together.
BLOCK = 256
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in code points. The pieces between matches give the positions of the matches."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        keep = x["ok"]
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def located(pairs: Column) -> Column:
        """Spans by blocks of matches: lists grow within a block only, so the work is linear in the matches but for their number of blocks."""
        block = lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        wide = lambda b: F.aggregate(block(b), F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + wide(b))))
        each = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, at: F.aggregate(block(b), F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(each)

    pairs = F.zip_with(
        hits,
        F.slice(pieces, F.lit(1), F.size(hits)),
        lambda m, p: F.struct(F.length(m).alias("size"), F.length(p).alias("gap"), _kept(m, rule).alias("ok")),
    )
    # the pieces are made only where there is a match, and once
    found = F.get(F.transform(F.array(pairs), located), F.lit(0))
    return F.when(F.regexp_instr(text, F.lit(rule.pattern)) > 0, found).otherwise(none)


def _kept(m: Column, rule: Rule) -> Column:
    if not rule.by_value:
        return F.lit(True)
    return F.length(F.regexp_extract(m, _ASSIGN_VALUE, 1)) >= 8


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, kind, version, spans) of blobs(blob, text): one row for each blob and rule."""
    order = {r.kind: i for i, r in enumerate(RULES)}
    each = F.array(
        *[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r, order.get(r.kind, len(RULES) + i)).alias("spans")) for i, r in enumerate(rules)]
    )
    return blobs.select("blob", F.inline(each))


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of every version."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], path: str, text: str) -> DataFrame:
    """(blob, text) once for each blob that lacks a pair in the ledger.

    A blob's text comes from the row whose path is least; only addresses and paths are grouped, so a blob
    with a third of all rows costs no more than any other.
    """
    v = settle(versions(docs, path, text), "versions")
    first = v.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        pairs = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)
        done = ledger.where(pairs).groupBy("blob").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == len(rules))
        first = first.join(done, "blob", "left_anti")
    texts = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = first.select(F.col("blob").alias("_b"), F.col("path").alias("_p"))
    joined = texts.withColumn("blob", F.sha2("text", 256)).join(first, (F.col("blob") == F.col("_b")) & F.col("path").eqNullSafe(F.col("_p")), "left_semi").select("blob", "text")
    # a path that repeats with the same text gives its blob more than once
    repeated = v.groupBy("blob", "path").count().where("count > 1").limit(1).count() > 0
    return joined.dropDuplicates(["blob"]) if repeated else joined


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows. Append them to the ledger's table; the next run then skips those pairs."""
    rows = scan(unseen(docs, ledger, rules, path, text), rules)
    if ledger is not None:
        rows = rows.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    return rows


def findings_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``spans`` of the given rules by start, then rule.

    Only blobs with findings are joined, by the blob's address: a list that is short is broadcast, else the join is
    salted, so that a blob with very many paths is spread out.
    """
    wanted = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)
    found = (
        ledger.where(wanted)
        .where(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    )
    kept = docs.drop(*({"blob", "spans"} - {path, text})).withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).drop(text)
    return lookup_join(kept, settle(found, "findings"), "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scans(spark, sf_dir):
    """All documents scanned against an empty ledger."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = findings_by_path(docs, scan_ledger(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in RULES if r.base]))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op7_sql() -> str:
    """DuckDB SQL for op7_secret_scans."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        value = _ASSIGN_VALUE.replace("'", "''")
        keep = f"length(regexp_extract(h, '{value}', 1)) >= 8" if r.by_value else "true"
        parts.append(f"""
        select doc_id, {i} as ord, '{r.kind}' as kind, start_ as s, start_ + length(h) as e from (
          select doc_id, h, i, coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)::bigint
                 + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::bigint as start_
          from (select doc_id, hits, pieces, unnest(hits) as h, generate_subscripts(hits, 1) as i
                from (select doc_id, regexp_extract_all(t, '{p}') as hits, regexp_split_to_array(t, '{p}') as pieces from d
                      where regexp_matches(t, '{p}')))) where {keep}""")
    every = " union all ".join(parts)
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    s as ({every}),
    g as (select doc_id,
            count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
            coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (where ord < 3), '') as base,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans
          from s group by doc_id)
    select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
           coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join g using (doc_id)"""
