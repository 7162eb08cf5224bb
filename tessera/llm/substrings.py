"""Suffix-array dedup of passages: bucket-pointer refinement of the places that can repeat.

Every byte that lies in a LENGTH-byte string which also starts earlier (in a smaller doc_id, or earlier in the same
document) is removed; strings are judged on the input and never cross documents.

A suffix array of all positions would move eight bytes for every byte of text, so the initial q-gram buckets are made on
a sample that loses nothing: in each window of LENGTH bytes the q-gram of least hash is its anchor, and equal windows have
equal anchors. Neighbouring windows with one anchor form a run. (1) Runs go to their anchor's bucket as hashes; of equal runs in one
batch of texts only the earliest goes, as the others repeat it. In a bucket, runs of equal content repeat the earliest one wholly; a bucket of a
single content is done. An anchor with a large part of all runs (a line in very many documents) would be a hot bucket of as many
contents as the line has neighbours: its runs are taken apart to windows, each in the bucket of its own hash. Which anchors are, is counted
on every SIXTEENTH document by SLOTS of anchors' hashes; it decides only how work is dealt, not what is found. (2) Only for the
other buckets is content fetched, once for each distinct content. There windows are refined as in bucket-pointer
refinement: positions start in buckets of their 8-gram, and are refined by sorting on the bucket identifiers of later
offsets (8, 16, 32, then 36 for 100 bytes), each round reusing the identifiers that the last one has updated, and
dropping positions that are alone. What is left together is equal byte for byte, and all but its earliest place repeats.
(3) Repeated places go back to their documents.

Rows move as packed arrays: anchors by bucket, texts by document, each in parts of about PART_BYTES; a task takes many parts, one after the
other. Both deal by hash, and the anchors of a document lie in many buckets, so a group of copies, or a passage in very many documents, is spread out.

Defined results: null and empty texts have nothing to remove; texts under LENGTH bytes are kept whole; rows that repeat wholly
(doc_id and text) count as one document and give equal rows; rows of one doc_id with different texts are ordered by a
hash of the text; doc_ids of any type that has an order; a null doc_id comes first; an empty table gives an empty result; further input columns are not carried
(join on doc_id). Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import grams
from tessera.llm.common import read, settle, typed_key

LENGTH, GRAM = 100, 32
#: Bytes of text that are handled together after texts or contents have been dealt out, and tasks that take them at most.
PART_BYTES, MOST_TASKS = 4 << 20, 20_000
#: Counters of runs by anchor; an anchor is hot if its counter, over the counted documents, is above HOT and above MANY times the mean.
SLOTS, SIXTEENTH, HOT, MANY = 1 << 16, 16, 256, 8
_NO_ID = -(1 << 63)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: ``again``: known to repeat an earlier run.
_RUN = np.dtype([("bucket", "<u8"), ("content", "<u8"), ("id", "<i8"), ("start", "<i4"), ("n", "<u2"), ("again", "u1")])
_WANT = np.dtype([("bucket", "<u8"), ("id", "<i8"), ("start", "<i4"), ("n", "<u2")])
_REPEAT = np.dtype([("id", "<i8"), ("start", "<i4"), ("n", "<i4")])


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of longs as the SQL function has it, so that tasks can deal rows as a join would."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.full(len(x), np.uint64(42) + p5 + np.uint64(8), dtype=np.uint64)
    h ^= rot(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def slot(bucket: np.ndarray) -> np.ndarray:
    return (bucket >> np.uint64(24)) % np.uint64(SLOTS)


def runs_of(texts: list[bytes], ids: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> np.ndarray:
    """The runs (_RUN) of windows with one anchor, of some texts; windows, where ``hot`` has the anchor's slot."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(buf)
    if not len(size) or size.max() < length:
        return np.zeros(0, _RUN)
    first = np.concatenate([[0], np.cumsum(size)])
    end_of = np.repeat(first[1:], size)
    here = np.arange(n)
    ok = here + length <= end_of  # a window starts here
    pre, down = [], []
    for base in (_A, _B):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * grams.powers(base, n), out=total[1:])
        pre.append(total)
        down.append(grams.powers(grams.inverse(int(base)), n))
    w = length - gram + 1
    h = np.full(-(-n // w) * w + w, np.uint64(0xFFFFFFFFFFFFFFFF))
    m = n - gram + 1
    full = grams.mix((pre[0][gram:] - pre[0][:m]) * down[0][:m])
    bits = np.uint64(n.bit_length())
    h[:m] = (full >> bits << bits) | here[:m].astype(np.uint64)  # of equal hashes the leftmost
    del total
    block = h.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.flatnonzero(ok)
    anchor = (np.minimum(behind[start], ahead[start + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(anchor) != 0) | (np.diff(end_of[start]) != 0)])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), _RUN)
    s, a = start[at], anchor[at]
    count = np.diff(np.concatenate([at, [len(start)]]))
    e = s + count - 1 + length
    doc = np.searchsorted(first, s, side="right") - 1
    out["bucket"] = full[a]
    out["content"] = grams.mix((pre[1][e] - pre[1][s]) * down[1][s] + grams.mix((count << 32 | (a - s)).astype(np.uint64)))
    out["id"], out["start"], out["n"] = ids[doc], s - first[doc], count
    apart = np.flatnonzero(hot[slot(out["bucket"])]) if hot is not None else np.zeros(0, np.int64)
    if not len(apart):
        return out
    p = np.repeat(s[apart] - np.cumsum(count[apart]) + count[apart], count[apart]) + np.arange(int(count[apart].sum()))
    single = np.zeros(len(p), _RUN)
    for name, k in (("bucket", 0), ("content", 1)):
        single[name] = grams.mix((pre[k][p + length] - pre[k][p]) * down[k][p] + np.uint64(length))
    doc = np.searchsorted(first, p, side="right") - 1
    single["id"], single["start"], single["n"] = ids[doc], p - first[doc], 1
    rest = np.ones(len(out), dtype=bool)
    rest[apart] = False
    return np.concatenate([out[rest], single])


def joined(ids: np.ndarray, start: np.ndarray, n: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Runs of neighbouring windows of one document as one run each."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order].astype(np.int64), start[order].astype(np.int64) + n[order]
    # a run begins where none before it in its document reaches it; runs of one document are far from the next one's
    base = np.concatenate([[0], np.cumsum(np.diff(ids) != 0)]) * (1 << 33) if len(ids) else start
    reach = np.maximum.accumulate(base + end) if len(ids) else end
    new = np.concatenate([[True], (base + start)[1:] > reach[:-1]]) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), kind)
    last = np.concatenate([at[1:], [len(ids)]]) - 1 if len(at) else at
    out["id"], out["start"] = ids[at], start[at]
    size = (reach - base)[last] - start[at]
    if kind == _RUN:  # its length has two bytes
        out = np.repeat(out, -(-size // 0xFFFF))
        many = -(-size // 0xFFFF)
        k = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
        out["start"] += (k * 0xFFFF).astype(np.int32)
        out["n"], out["again"] = np.minimum(np.repeat(size, many) - k * 0xFFFF, 0xFFFF), 1
    else:
        out["n"] = size
    return out


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal runs, and which of ``rows`` repeat one of those."""
    rows = rows[np.lexsort((rows["start"], rows["id"], rows["content"], rows["bucket"]))]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = (rows["bucket"][1:] != rows["bucket"][:-1]) | (rows["content"][1:] != rows["content"][:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = ~head & ((rows["id"] != rows["id"][lead]) | (rows["start"] != rows["start"][lead]))
    return rows[head], rows[later]


def equal_windows(contents: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For the first ``counts`` windows of every content: positions in the joined contents that are not alone, and the
    identifier of the class of equal windows at each.

    Bucket-pointer refinement: ``name[p]`` is the bucket of the string of the current depth at p; only positions whose
    bucket has company are sorted again.
    """
    size = np.array([len(c) for c in contents], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    t = np.frombuffer(b"".join(contents) + bytes(8), dtype=np.uint8).astype(np.uint64)
    n = len(t) - 8
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | t[k : n + k]
    live = np.arange(n)
    name = np.zeros(n + length, dtype=np.int64)  # 0: alone, and so unlike any other position
    depth = 8
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))

    def refine(where: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Names those positions anew that share a key; returns them."""
        if not len(where):
            name[:] = 0
            return where
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        shared = same | np.concatenate([same[1:], [False]])
        ident = np.cumsum(~same)
        name[:] = 0
        name[where[order[shared]]] = ident[shared]
        return np.sort(where[order[shared]])

    live = refine(live, key)
    while depth * 2 <= length:
        live = live[name[live + depth] > 0]
        live = refine(live, name[live] * np.int64(n + 1) + name[live + depth])
        depth *= 2
    rest = length - depth
    live = np.intersect1d(live, start, assume_unique=False)
    if rest:
        live = live[name[live + rest] > 0]
        live = refine(live, name[live] * np.int64(n + 1) + name[live + rest])
    return live, name[live]


def _blobs(rows: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows as bytes for each part."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            yield int(part[a]), rows[a:b].tobytes()


def _packed(pairs, kind: int | None = None) -> pa.RecordBatch:
    pairs = list(pairs)
    cols = [pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())]
    if kind is None:
        return pa.RecordBatch.from_arrays(cols, ["part", "blob"])
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(pairs), pa.int32()), *cols], ["kind", "part", "blob"])


def _counted(length: int, gram: int):
    """Runs by slot, of some documents: one row a task."""

    def run(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, part in grams.chunks(batch.column(1).to_pylist()):
                total += np.bincount(slot(runs_of(part, ids[at : at + len(part)], length, gram)["bucket"]).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def hot_slots(rows: DataFrame, length: int, gram: int) -> np.ndarray:
    """The slots of hot anchors, from every SIXTEENTH document. Tasks' counters are added in up to eight tasks before the driver adds those."""

    def added(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    some = rows.where(F.pmod(F.xxhash64("id", F.lit("hot")), F.lit(SIXTEENTH)) == 0)
    total = np.zeros(SLOTS, dtype=np.int64)
    for r in settle(some.mapInArrow(_counted(length, gram), "counts binary"), "counts").coalesce(8).mapInArrow(added, "counts binary").toLocalIterator():
        total += np.frombuffer(r["counts"], dtype=np.int64)
    return total > max(HOT, MANY * total.mean())


def _anchors(parts: int, length: int, gram: int, hot: np.ndarray):
    """Runs by the part of their bucket; those that repeat a run of their batch by a part of their document."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            made = [runs_of(part, ids[at : at + len(part)], length, gram, hot) for at, part in grams.chunks(texts)]
            rows, again = combined(np.concatenate(made) if made else np.zeros(0, _RUN))
            again = joined(again["id"], again["start"], again["n"].astype(np.int64), _RUN)
            part = np.concatenate([((rows["bucket"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), np.mod(spark_hash(again["id"]), parts)])
            yield _packed(_blobs(np.concatenate([rows, again]), part))

    return run


def _by_part(batches) -> Iterator[list[bytes]]:
    """The blobs of each part, of batches (part, blob) in order of parts."""
    held, last = [], None
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != last and held:
                yield held
                held = []
            held.append(blob)
            last = part
    if held:
        yield held


def _buckets(doc_parts: int):
    """Of all runs of one part. Kind 0: repeats, kind 1: runs whose content is wanted; both by the part of their document."""

    def one(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = rows[rows["again"] > 0]
        heads, later = combined(rows[rows["again"] == 0])
        later = np.concatenate([known, later])
        again = joined(later["id"], later["start"], later["n"].astype(np.int64), _REPEAT)
        yield _packed(_blobs(again, np.mod(spark_hash(again["id"]), doc_parts)), 0)
        _, which, count = np.unique(heads["bucket"], return_inverse=True, return_counts=True)
        heads = heads[count[which] > 1]
        want = np.zeros(len(heads), _WANT)
        for c in want.dtype.names:
            want[c] = heads[c]
        yield _packed(_blobs(want, np.mod(spark_hash(want["id"]), doc_parts)), 1)

    def run(batches):
        for blobs in _by_part(batches):
            yield from one(np.frombuffer(b"".join(blobs), _RUN))

    return run


def _contents(parts: int, length: int):
    """Cogroup of texts and wanted runs of one part: each run with its bytes, by the part of its bucket."""

    def run(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        want = np.frombuffer(b"".join(wanted.column("blob").to_pylist()), _WANT)
        want = want[np.argsort(want["id"], kind="stable")]
        out: dict[int, list[bytes]] = {}
        texts = dict(zip(docs.column("id").to_pylist(), docs.column("text").to_pylist()))
        encoded, last = b"", None
        for row, (bucket, i, start, n) in zip(want, want.tolist()):
            if i != last:
                encoded, last = (texts.get(i) or "").encode("utf-8", "surrogatepass"), i
            out.setdefault((bucket >> 32) % parts, []).append(row.tobytes() + encoded[start : start + n - 1 + length])
        return pa.table({"part": pa.array(list(out), pa.int32()), "blob": pa.array([b"".join(x) for x in out.values()], pa.binary())})

    return run


def _refined(doc_parts: int, length: int, limit: int):
    """Repeats among the distinct contents of each bucket, by the part of their document."""

    def one(rows: np.ndarray, contents: list[bytes]) -> pa.RecordBatch:
        counts = rows["n"].astype(np.int64)
        at, name = equal_windows(contents, counts, length)
        first = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
        row = np.searchsorted(first, at, side="right") - 1
        ids, pos = rows["id"][row], rows["start"][row] + at - first[row]
        order = np.lexsort((pos, ids, name))
        name, ids, pos = name[order], ids[order], pos[order]
        head = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(name) else np.zeros(0, np.int64)
        later = ~head & ((ids != ids[lead]) | (pos != pos[lead]))
        ids, pos = ids[later], pos[later]
        again = joined(ids, pos, np.ones(len(ids), dtype=np.int64), _REPEAT)
        return _packed(_blobs(again, np.mod(spark_hash(again["id"]), doc_parts)))

    def run(batches):
        for blobs in _by_part(batches):
            yield from part(blobs)

    def part(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads, contents = [], []
        for blob in blobs:
            at = 0
            while at < len(blob):
                row = np.frombuffer(blob, _WANT, 1, at)
                size = int(row["n"][0]) - 1 + length
                heads.append(row)
                contents.append(blob[at + _WANT.itemsize : at + _WANT.itemsize + size])
                at += _WANT.itemsize + size
        rows = np.concatenate(heads)
        order = np.argsort(rows["bucket"], kind="stable")
        rows, contents = rows[order], [contents[i] for i in order]
        # whole buckets together, about ``limit`` bytes at a time
        ends = np.concatenate([np.flatnonzero(np.diff(rows["bucket"])) + 1, [len(rows)]])
        size = np.cumsum([len(c) for c in contents])
        a = 0
        while a < len(rows):
            base = size[a - 1] if a else 0
            fit = ends[(ends > a) & (size[ends - 1] - base <= limit)]
            b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
            yield one(rows[a:b], contents[a:b])
            a = b

    return run


def removed_spans(size: int, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes within windows that start at start .. start + n - 1."""
    cover = np.zeros(size + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, np.minimum(start + n - 1 + length, size), -1)
    on = np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]]))
    return np.flatnonzero(on == 1), np.flatnonzero(on == -1)


def _cut(length: int, keep_text: bool):
    def run(key, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        again = np.frombuffer(b"".join(repeats.column("blob").to_pylist()), _REPEAT)
        again = again[np.argsort(again["id"], kind="stable")]
        ids = docs.column("id").to_numpy()
        lo, hi = np.searchsorted(again["id"], ids), np.searchsorted(again["id"], ids, side="right")
        rows = []
        for i, text, a, b in zip(ids.tolist(), docs.column("text").to_pylist(), lo, hi):
            raw = (text or "").encode("utf-8", "surrogatepass")
            s, e = removed_spans(len(raw), again["start"][a:b], again["n"][a:b], length) if b > a else ((), ())
            kept = raw
            if b > a:
                edges = [0, *np.stack([s, e], 1).reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((i, len(raw), len(raw) - len(kept), [{"start": int(x), "end": int(y)} for x, y in zip(s, e)], hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        cols = list(zip(*rows)) if rows else [[]] * 6
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({
            "id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()),
            "spans": pa.array(cols[3], spans), "kept_sha256": pa.array(cols[4], pa.string()), "kept": pa.array(cols[5], pa.binary()),
        })

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256, kept) of every row; ``kept`` (bytes) is null unless ``keep_text``."""
    if not 0 < gram <= length or length - gram + 1 > 0xFFFF or length < 8:
        raise ValueError("a window has 8 bytes or more, at least those of its q-gram, and at most 65,535 places of it")
    spark = docs.sparkSession
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rows = docs.select(typed_key(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = rows.select(F.coalesce(F.col("key")["key"].cast("long"), F.lit(_NO_ID)).alias("id"), "text") if whole else None
    real = None
    if not whole or numbered.groupBy("id").count().where("count > 1").limit(1).count():
        # documents are numbered in the order of doc_id and a hash of the text
        named = rows.select("key", F.xxhash64("text").alias("th")).distinct().orderBy("key", "th")
        kind = named.schema["key"].dataType
        schema = StructType([StructField("key", kind), StructField("th", LongType()), StructField("rid", LongType())])
        real = settle(spark.createDataFrame(named.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), schema), "ids")
        numbered = settle(rows.withColumn("th", F.xxhash64("text")).join(real, ["key", "th"]).select(F.col("rid").alias("id"), "text"), "rows")
    rows = numbered
    volume = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # documents are dealt to parts by a hash, buckets to parts by theirs, and parts to tasks by their number
    parts = max(2 * tasks, -(-volume // PART_BYTES))
    tasks = min(max(tasks, parts // 2), max(tasks, MOST_TASKS))
    buckets = max(tasks, parts // 2)
    in_order = lambda d: d.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")

    hot = hot_slots(rows, length, gram)
    anchors = in_order(rows.mapInArrow(_anchors(buckets, length, gram, hot), "part int, blob binary"))
    found = settle(anchors.mapInArrow(_buckets(parts), "kind int, part int, blob binary"), "buckets")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(tasks, "part")
    wanted, again = (found.where(F.col("kind") == k).select("part", "blob").repartition(tasks, "part") for k in (1, 0))
    contents = dealt.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(_contents(buckets, length), "part int, blob binary")
    more = in_order(contents).mapInArrow(_refined(parts, length, PART_BYTES), "part int, blob binary")
    repeats = again.unionByName(more.select("part", "blob")).repartition(tasks, "part")
    out = dealt.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(
        _cut(length, keep_text), "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"
    )
    if real is not None:
        out = out.join(real.select(F.col("rid").alias("id"), "key"), "id").withColumn(key, F.col("key")["key"])
    else:
        out = out.withColumn(key, F.when(F.col("id") != _NO_ID, F.col("id")).cast(docs.schema[key].dataType))
    return out.select(key, "n_bytes", "n_removed", "spans", "kept_sha256", "kept")


def op3_suffix_array_dedup(spark, sf_dir):
    """All documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
