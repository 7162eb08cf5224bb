"""Benchmark decontamination: an FM-index for every training shard.

Texts become lower-case words (A-Z only; words are runs of 0-9, a-z and non-ASCII characters). A benchmark item gives
windows of WINDOW consecutive words; a shorter item with any word is one window. Benchmark words are numbered; other
words of a document can lie in no window, so a shard's sequence keeps only runs of benchmark words that are as long as
the shortest window, parted by separators. Over that sequence stand a suffix array, its Burrows-Wheeler transform in a
wavelet matrix (ranks by bit planes) and sampled suffix positions: windows are searched backward, all at once, and
occurrences are located by walking to the nearest sample. Overlapping occurrences merge to removal spans.

A training shard is up to SHARD_BYTES of the texts of one task, so memory is bounded and nothing is shuffled. The
benchmark goes to the tasks in blocks of about BLOCK_WORDS words (its bytes are counted first); a benchmark of more
blocks is searched in as many passes, one after the other, and what a pass has found is written before the next block is
read: driver, plan and tasks hold a single block at a time.

Defined results: null and empty texts have no words, no hit, no item; an item without text or words gives no window;
a null item_id is listed as ``null``; item rows that repeat count once; repeated documents get equal rows; an empty
benchmark hits nothing; an empty table gives an empty result; input columns named like the results (``n_words``,
``n_hit``, ``spans``, ``items``) are replaced. Texts are read whole; one longer than SHARD_BYTES is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, settle

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 2_000_000
SAMPLE = 8

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The windows of some items: numbered words, one row of numbers for each distinct window, items by window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add("null" if item is None else str(item))
        self.names = sorted({x for s in found.values() for x in s})
        number = {x: i for i, x in enumerate(self.names)}
        keys = sorted(found)
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if keys else 0
        width = int(self.lengths.max()) if keys else 0
        #: aligned to the right: backward search reads columns from the last
        self.rows = np.zeros((len(keys), width), dtype=np.int32)
        for i, k in enumerate(keys):
            self.rows[i, width - len(k) :] = k
        lists = [sorted(number[x] for x in found[k]) for k in keys]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.items = np.array([x for y in lists for x in y], dtype=np.int64)


class FmIndex:
    """Over numbers 0..top, where 0 parts the runs and ends the sequence; patterns hold no 0."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(seq)
        bar = seq == 0
        # separators differ from each other, so that order is settled within a run
        rank = np.where(bar, np.cumsum(bar) - 1, int(bar.sum()) + seq.astype(np.int64))
        step = 1
        while True:
            later = np.zeros(n, dtype=np.int64)
            later[: max(0, n - step)] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + later
            sa = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            rank[sa] = new
            if new[-1] == n - 1:
                break
            step *= 2
        bwt = seq[sa - 1].astype(np.int64)  # sa 0 takes the last number, a separator
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.planes = []
        cur = bwt
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            on = (cur >> bit & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(on)])
            self.planes.append((bit, ones, n - int(ones[-1])))
            cur = np.concatenate([cur[~on], cur[on]])
        start = np.concatenate([[True], bar[:-1]])  # walks end at the start of a run, and never cross a separator
        marked = (sa % sample == 0) | start[sa]
        #: sampled positions alone are kept, with the number of marked rows before each row
        self.n, self.marked, self.at = n, np.concatenate([[0], np.cumsum(marked)]), sa[marked]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        i, base = row.copy(), np.zeros_like(row)
        for bit, ones, zeros in self.planes:
            on = (symbol >> bit & 1).astype(bool)
            i = np.where(on, zeros + ones[i], i - ones[i])
            base = np.where(on, zeros + ones[base], base - ones[base])
        return i - base

    def symbol(self, row: np.ndarray) -> np.ndarray:
        i, out = row.copy(), np.zeros_like(row)
        for bit, ones, zeros in self.planes:
            on = ones[i + 1] > ones[i]
            out |= on.astype(np.int64) << bit
            i = np.where(on, zeros + ones[i], i - ones[i])
        return out

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row + 1 of each pattern (rows, aligned to the right, 0 before their start)."""
        lo = np.zeros(len(rows), dtype=np.int64)
        hi = np.full(len(rows), self.n, dtype=np.int64)
        for col in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((rows[:, col] > 0) & (hi > lo))
            if len(live):
                c = rows[live, col].astype(np.int64)
                lo[live] = self.below[c] + self.rank(c, lo[live])
                hi[live] = self.below[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        row, steps, todo = row.copy(), np.zeros(len(row), dtype=np.int64), np.arange(len(row))
        while len(todo := todo[self.marked[row[todo] + 1] == self.marked[row[todo]]]):
            c = self.symbol(row[todo])
            row[todo] = self.below[c] + self.rank(c, row[todo])
            steps[todo] += 1
        return self.at[self.marked[row]] + steps


def hits_of(texts: list[str | None], w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one training shard: words per document; starts and ends of merged spans, in words of the whole shard; and
    (document, item) pairs. Documents' words follow each other, each document's with a separator after them."""
    get = w.vocab.get
    docs = [words_of(t) for t in texts]
    n_words = np.array([len(d) for d in docs], dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n_words + 1)])
    if not w.shortest:
        return n_words, none, none, none, none
    seq = np.zeros(int(first[-1]), dtype=np.int64)
    for d, at in zip(docs, first):
        if d:
            seq[at : at + len(d)] = [get(x, 0) for x in d]
    known = np.concatenate([[0], (seq > 0).astype(np.int8), [0]])
    a, b = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long_ = b - a >= w.shortest
    a, b = a[long_], b[long_]
    if not len(a):
        return n_words, none, none, none, none
    size = b - a + 1  # with the separator
    place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    fm = FmIndex(seq[place], len(w.vocab))
    lo, hi = fm.search(w.rows)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    at = place[fm.locate(rows)]
    cover = np.zeros(len(seq) + 2, dtype=np.int64)
    np.add.at(cover, at + 1, 1)
    np.add.at(cover, at + 1 + w.lengths[which], -1)
    on = np.diff((np.cumsum(cover) > 0).astype(np.int8))
    doc = np.searchsorted(first, at, side="right") - 1
    pair = np.unique(doc * len(n) + which)
    doc, which = pair // len(n), pair % len(n)
    many = w.first[which + 1] - w.first[which]
    item = w.items[np.repeat(w.first[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
    pair = np.unique(np.repeat(doc, many) * len(w.names) + item)
    return n_words, np.flatnonzero(on == 1), np.flatnonzero(on == -1), pair // len(w.names), pair % len(w.names)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pass(w: Windows, text: str, limit: int, again: bool):
    """One pass over record batches. ``again``: the rows already have the spans and items of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            size = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) if pa.types.is_string(column.type) and len(column) else np.zeros(len(column))
            at = 0
            while at < len(column):
                end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), limit)))
                part = batch.slice(at, end - at)
                yield one(part)
                at = end

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, a, b, doc, item = hits_of(batch.column(text).to_pylist(), w)
        first = np.concatenate([[0], np.cumsum(n_words + 1)])
        spans = [list(x or []) for x in batch.column("spans").to_pylist()] if again else [[] for _ in n_words]
        items = [list(x or []) for x in batch.column("items").to_pylist()] if again else [[] for _ in n_words]
        spans = [[(x["start"], x["end"]) for x in s] for s in spans]
        for d, x, y in zip(np.searchsorted(first, a, side="right") - 1, a, b):
            spans[d].append((int(x - first[d]), int(y - first[d])))
        for d, i in zip(doc, item):
            items[d].append(w.names[i])
        if again:
            items = [sorted(set(x)) for x in items]
        spans = [_merge(s) for s in spans]
        new = {
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()),
            "spans": pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], _SPANS),
            "items": pa.array(items, pa.list_(pa.string())),
        }
        names = [c for c in batch.schema.names if c not in new]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in names] + list(new.values()), names + list(new))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, ``spans`` (array of word ranges start, end to remove) and ``items``
    (array of the ids, as strings in order, of items with occurring windows)."""
    bench = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    # twice as many word characters' ends as there can be words; bytes bound the words of an item
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (2 * block_words)))
    out = docs.drop("n_words", "n_hit", "spans", "items")
    kept = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    schema = f"{kept}, n_words bigint, n_hit bigint, spans array<struct<start:int,end:int>>, items array<string>"
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        w = Windows([(r["item"], r["text"]) for r in part.toLocalIterator()], window)
        out = out.mapInArrow(_pass(w, text, shard_bytes, b > 0), schema)
        if b + 1 < blocks:
            out = settle(out, "searched")
    return out


def op6_benchmark_decontamination(spark, sf_dir):
    """All documents against the whole benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_sql() -> str:
    """DuckDB SQL for op6_benchmark_decontamination."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    with b as (select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') as w from benchmark),
    bw as (select distinct item, least(len(w), {WINDOW}) as n, unnest(list_transform(range(1, greatest(2, len(w) - {WINDOW} + 2)), lambda i: array_to_string(w[i:i + {WINDOW} - 1], ' '))) as win from b where len(w) > 0),
    d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') as w from documents),
    dw as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d, (select distinct n from bw) where len(w) >= n),
    h as (select r, i, n, item from (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as win from dw) join bw using (n, win)),
    c as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from (select distinct r, i, n from h)) group by r),
    k as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from h) group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join c using (r) left join k using (r)"""
