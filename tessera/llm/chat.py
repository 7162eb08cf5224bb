"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message's text is plain, or a JSON object: an assistant's with ``tool_calls`` (a list of objects with id, name, arguments)
and perhaps ``content``; a tool's with ``tool_call_id`` and ``content``. Arguments may refer to the result of another call
by an object {"$ref": id}. Each message gives events: its text, each call, or a result.

Calls and results are hash-joined by (conversation, id); of several with one id the first by turn and place is linked, the
others are marked. Topological order: an event comes after what it needs (a result needs its call, a call the results
it refers to). ``level`` is the longest way from an event that needs nothing, ``due`` the greatest turn on such ways, so that
order by (due, level, turn, place) keeps the dialogue's order wherever needs allow. Levels are found by rounds of joins
over the calls with references alone, until a round finds none; chains of calls with one reference each are shortened by
doubling first. Positions come from counts of blocks of turns, and within these of parts by a hash of the event, so that even a
conversation with a third of all messages, or a single turn with so many, is numbered in many tasks.

Defined results: a null conversation is a conversation of its own; a null turn comes first, as turn -1; a null role is
``unknown``; null text gives content null, empty text content ""; text that is no such JSON object is plain; a call without an id
cannot be linked (``no_id``); an unknown tool, arguments that are no object or do not fit the schema are marked invalid with the first
reason; references to unknown calls do not hold an event up; events in or behind a cycle of references, a call that refers to itself
among them, have level null, status ``cycle``, and come at their turn after the others; rows that repeat are events of their own; an empty table gives an empty
result; further columns of the input are not carried. Texts are read whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, settle

#: Turns that are numbered together.
BLOCK = 64
#: Bits of the hash that part the events of a turn.
PART_BITS = 8

#: The tools that ``op8_chat_formatting`` knows.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}, "digits": {"type": "integer", "minimum": 0}}},
}

_LONE = re.compile("[\ud800-\udfff]")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(x: object) -> str:
    """Keys in order, no white space, whole-number floats as integers, no NaN; surrogates without their other half stay escaped."""
    return _encodable(json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _encodable(x: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", x)


def _ident(x: object) -> str | None:
    return None if x in (None, "") else _encodable(str(x))


def _plain(x: object) -> object:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return int(x) if isinstance(x, float) and math.isfinite(x) and x.is_integer() and abs(x) < 2**53 else x


def mismatch(x: object, schema: Mapping, at: str = "$") -> str | None:
    """The first reason why a value does not fit a schema (type, enum, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength); a reference fits any schema."""
    if isinstance(x, dict) and set(x) == {"$ref"}:
        return None
    kinds = schema.get("type")
    if kinds is not None and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and not any(canonical(x) == canonical(e) for e in schema["enum"]):
        return f"{at}: enum"
    if isinstance(x, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in x:
                return f"{at}.{k}: required"
        for k in sorted(x):
            if k in known:
                if why := mismatch(x[k], known[k], f"{at}.{k}"):
                    return why
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: unknown"
    elif isinstance(x, list) and "items" in schema:
        for i, v in enumerate(x):
            if why := mismatch(v, schema["items"], f"{at}[{i}]"):
                return why
    elif isinstance(x, str):
        if not schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", math.inf):
            return f"{at}: length"
    elif isinstance(x, (int, float)) and not isinstance(x, bool) and not schema.get("minimum", -math.inf) <= x <= schema.get("maximum", math.inf):
        return f"{at}: range"
    return None


def _is(x: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(x, (int, float)) and not isinstance(x, bool) and (kind == "number" or isinstance(x, int) or x.is_integer())
    return isinstance(x, _KINDS[kind])


def _refs(x: object) -> list[str]:
    if isinstance(x, dict):
        if set(x) == {"$ref"}:
            return [_encodable(str(x["$ref"]))]
        return [r for k in sorted(x) for r in _refs(x[k])]
    return [r for v in x for r in _refs(v)] if isinstance(x, list) else []


def _reject(x: str) -> None:
    raise ValueError(x)


def _object(text: str | None, role: str) -> dict | None:
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return None
    try:
        x = json.loads(text, parse_constant=_reject)
        canonical(x)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def events_of(role: str, text: str | None, tools: Mapping[str, Mapping]) -> list[tuple]:
    """(kind, id, refs, problem, json) of one message."""
    try:
        return _events_of(_object(text, role), role, text, tools)
    except RecursionError:
        return _events_of(None, role, text, tools)


def _events_of(x: dict | None, role: str, text: str | None, tools: Mapping[str, Mapping]) -> list[tuple]:
    if x is not None and role == "assistant" and isinstance(x.get("tool_calls"), list) and x["tool_calls"]:
        out = []
        if x.get("content") not in (None, ""):
            out.append(("text", None, [], None, canonical({"role": role, "content": x["content"]})))
        for call in x["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            ident = _ident(call.get("id"))
            args = call.get("arguments")
            if isinstance(args, str):  # arguments may come as a JSON text
                try:
                    args = json.loads(args, parse_constant=_reject)
                    canonical(args)
                except (ValueError, RecursionError):
                    args = call["arguments"]
            name = str(call.get("name"))
            why = "unknown tool" if name not in tools else "$: type" if not isinstance(args, dict) else mismatch(args, tools[name])
            out.append(("call", ident, sorted(set(_refs(args))), why and _encodable(why), canonical({"role": role, "tool_call": {"id": ident, "name": name, "arguments": args}})))
        return out
    if x is not None and role == "tool" and "tool_call_id" in x:
        ident = _ident(x["tool_call_id"])
        return [("result", ident, [], None, canonical({"role": role, "tool_call_id": ident, "content": x.get("content")}))]
    return [("text", None, [], None, canonical({"role": role, "content": text}))]


def _parse(tools: Mapping[str, Mapping]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv", "turn", "role", "text"))):
                rows += [(c, t, r, place, *e) for place, e in enumerate(events_of(r, x, tools))]
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv", "turn", "role", "place", "kind", "call_id", "refs", "problem", "json"])

    return run


def _shortened(needs: DataFrame, timed: DataFrame) -> DataFrame:
    """(conv, call_id, need, steps, mid): the needs, where a call with one need has instead the first call on its way that has
    none or several, ``steps`` references away, with ``mid``, the greatest turn of the calls between and their results.

    Ways double in every round, so a chain of n calls takes log2(n). A way of more steps than there are calls runs in a
    cycle: its call keeps its own need, which is never met.
    """
    one = needs.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.min("need").alias("to"))
    own = timed.select("conv", "call_id", F.greatest("turn", "answered").alias("own"))
    single = one.where("n = 1").join(own, ["conv", "call_id"]).select("conv", "call_id", "to", F.lit(1).cast("long").alias("steps"), F.lit(None).cast("long").alias("mid"), "own")
    single, most = settle(single, "single"), timed.count()
    moving, ended = single, []
    jump = single
    while True:
        far = jump.select("conv", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("s2"), F.col("mid").alias("m2"), F.col("own").alias("o2"))
        both = settle(moving.join(far, ["conv", "to"], "left"), "jump")
        ended.append(both.where("to2 is null").select("conv", "call_id", "to", "steps", "mid", "own"))
        moving = both.where("to2 is not null").select("conv", "call_id", F.col("to2").alias("to"), (F.col("steps") + F.col("s2")).alias("steps"), F.greatest("mid", "o2", "m2").alias("mid"), "own")
        moving = moving.where(F.col("steps") <= most)
        if not moving.limit(1).count():
            break
        jump = reduce(DataFrame.union, ended, moving)
    short = settle(reduce(DataFrame.union, ended).select("conv", "call_id", F.col("to").alias("need"), "steps", "mid"), "short")
    rest = needs.join(short.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    return short.unionByName(rest.select("conv", "call_id", "need", F.lit(1).cast("long").alias("steps"), F.lit(None).cast("long").alias("mid")))


def link(messages: DataFrame, tools: Mapping[str, Mapping] = TOOLS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Events (conv, turn, role, place, kind, call_id, status, problem, due, level, position, json).

    status: text, linked, no_result, orphan, duplicate, no_id, cycle. ``conv`` is text, null for null.
    """
    rows = messages.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("\x00")).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.col(text).alias("text")
    )
    schema = "conv string, turn bigint, role string, place int, kind string, call_id string, refs array<string>, problem string, json string"
    events = settle(rows.mapInArrow(_parse(tools), schema).withColumn("h", F.xxhash64("json")), "events")

    # the first event of each kind for an id; counts are made per task first, so an id that repeats is no hot key
    firsts = events.where("call_id is not null").groupBy("conv", "call_id", "kind").agg(F.min(F.struct("turn", "place", "h")).alias("first"))
    calls = firsts.where("kind = 'call'").select("conv", "call_id", F.col("first").alias("call"))
    results = firsts.where("kind = 'result'").select("conv", "call_id", F.col("first").alias("result"))
    pairs = settle(calls.join(results, ["conv", "call_id"], "full"), "pairs")

    # levels of linked calls: 0 without references to linked calls, else two more than the greatest they need
    first_call = events.where("kind = 'call'").join(pairs, ["conv", "call_id"]).where(F.struct("turn", "place", "h") == F.col("call"))
    needs = first_call.select("conv", "call_id", F.explode("refs").alias("need")).distinct()
    known = pairs.where("call is not null").select("conv", F.col("call_id").alias("need"))
    needs = settle(needs.join(known, ["conv", "need"]), "needs")
    timed = pairs.where("call is not null").select("conv", "call_id", F.col("call")["turn"].alias("turn"), F.coalesce(F.col("result")["turn"], F.col("call")["turn"]).alias("answered"))
    waiting = needs.select("conv", "call_id").distinct()
    done = timed.join(waiting, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)).withColumn("due", F.col("turn"))
    done = done.withColumn("ready", F.greatest("due", "answered"))
    if needs.limit(1).count():
        done = settle(done, "done")
        needs = settle(_shortened(needs, timed), "ways")
        while True:  # each pass finds the level of one more call at least
            at = done.select("conv", F.col("call_id").alias("need"), F.col("level").alias("l"), F.col("ready").alias("d"))
            met = needs.join(at, ["conv", "need"], "left").groupBy("conv", "call_id").agg(F.max(F.col("l") + 2 * F.col("steps")).alias("l"), F.max(F.greatest("d", "mid")).alias("d"), F.count_if(F.col("l").isNull()).alias("missing"))
            fresh = met.where("missing = 0").join(done.select("conv", "call_id"), ["conv", "call_id"], "left_anti").join(timed, ["conv", "call_id"])
            fresh = fresh.select("conv", "call_id", "turn", "answered", F.col("l").cast("int").alias("level"), F.greatest("turn", "d").alias("due")).withColumn("ready", F.greatest("due", "answered"))
            fresh = settle(fresh, "fresh")
            if not fresh.limit(1).count():
                break
            done = settle(done.union(fresh), "done")
    placed = pairs.join(done.select("conv", "call_id", "level", "due"), ["conv", "call_id"], "left")

    own = F.struct("turn", "place", "h")
    linked = events.where("call_id is not null").join(placed, ["conv", "call_id"])
    is_call = F.col("kind") == "call"
    status = (
        F.when(is_call & (own != F.col("call")), "duplicate")
        .when(~is_call & (own != F.col("result")), "duplicate")
        .when(is_call & F.col("level").isNull(), "cycle")
        .when(is_call & F.col("result").isNull(), "no_result")
        .when(~is_call & F.col("call").isNull(), "orphan")
        .when(~is_call & F.col("level").isNull(), "cycle")
        .otherwise("linked")
    )
    linked = linked.withColumn("status", status)
    tied = F.col("status").isin("linked", "no_result")
    linked = linked.withColumn("due", F.when(tied, F.greatest("turn", "due")).otherwise(F.col("turn"))).withColumn(
        "level", F.when(tied, F.col("level") + F.when(is_call, 0).otherwise(1)).when(F.col("status") != "cycle", 0)
    )
    plain = events.where("call_id is null").select("*", F.when(F.col("kind") == "text", "text").otherwise("no_id").alias("status"), F.col("turn").alias("due"), F.lit(0).alias("level"))
    cols = ["conv", "turn", "role", "place", "kind", "call_id", "status", "problem", "due", "level", "json", "h"]
    out = linked.select(cols).unionByName(plain.select(cols)).withColumn("block", F.floor(F.col("due") / BLOCK))

    # where positions begin: one row for each conversation and block of turns, then one for each group of equal order and part of its hashes
    out = settle(out.withColumn("part", F.shiftright("h", 64 - PART_BITS)), "placed")
    group = [F.col("due"), F.col("level").asc_nulls_last(), F.col("turn"), F.col("place"), F.col("role"), F.col("part")]
    cells = settle(out.groupBy("conv", "block", "due", "level", "turn", "place", "role", "part").agg(F.count("*").alias("n")), "cells")
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("conv", "block", so_far(Window.partitionBy("conv").orderBy("block")).alias("first"))
    cells = cells.withColumn("start", so_far(Window.partitionBy("conv", "block").orderBy(*group))).join(blocks, ["conv", "block"])
    cells = cells.select(F.xxhash64("conv", *group[:1], "level", *group[2:]).alias("cell"), *[F.col(c).alias(f"_{c}") for c in ("conv", "due", "level", "turn", "place", "role", "part")], (F.col("first") + F.col("start")).alias("start"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv", "due", "level", "turn", "place", "role", "part")])
    out = out.join(cells, same & (F.xxhash64("conv", "due", "level", "turn", "place", "role", "part") == F.col("cell")))
    within = Window.partitionBy("cell", "_conv", "_due", "_level", "_turn", "_place", "_role", "_part").orderBy("h")
    out = out.withColumn("position", F.col("start") + F.row_number().over(within) - 1)
    return out.select(F.when(F.col("conv") != "\x00", F.col("conv")).alias("conv"), "turn", "role", "place", "kind", "call_id", "status", "problem", "due", "level", "position", "json")


def with_calls(conversations: DataFrame) -> DataFrame:
    """All messages as they are, and messages of tools made of them: an assistant's text is the query of a call, or waits for the result
    of the last assistant's call; a later user's text is the result of the call of the turn before."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    ref = F.struct(name(F.col("turn") - 2).alias("$ref"))
    query = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query")))
    args = F.when(F.col("turn") > 1, F.to_json(F.struct(ref.alias("url")))).otherwise(query)
    call = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 1, "fetch").otherwise("search").alias("name"), args.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    calls = c.where("role = 'assistant'").select("conv_id", "turn", "role", call.alias("text"))
    return c.unionByName(calls).unionByName(c.where("role = 'user' and turn > 1").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text")))


def op8_chat_formatting(spark, sf_dir):
    """All conversations, with calls and results made of their texts, as ordered events of canonical JSON."""
    out = link(with_calls(read(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").cast("long").alias("conv_id"), "turn", "position", "kind", "call_id", "status", "problem", "level", "json", F.sha2("json", 256).alias("json_sha256"))
