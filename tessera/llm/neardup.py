"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of word shingles (five words). Equal word sequences form one class first. A class has a sequence of DEPTH symbols
(16 bits of a MinHash each) in each of TREES tries; as two longs a sequence sorts as it stands in its trie, and a prefix is a shift. The forest is
walked from the longest prefix: the classes below a node (a prefix in a tree) are candidates, without making their pairs: a node
is a star from its least class. How many trees each star's pair shares is counted over all classes. A pair that shares m of
TREES nodes at this depth is found with probability 1 - (1 - m / TREES)^TREES, so the pairs found stand for the sum of the inverses. The
pairs that share as many nodes as one at the threshold would are the links to find; while their recall, so measured, is under
TARGET, the prefix is shortened by one symbol.

The stars' connected components are candidate groups, each verified exactly on the sets of 64-bit shingle hashes. A group of more than BLOCK classes is
dealt out as pairs of blocks, so no task holds more than two blocks; in a group of more than PARTS blocks only classes below a common node are compared, and a
pair counts at the least node that both have. Links are counted, not listed.

Result: for every row its class (``class_id``: the least doc_id of the connected component of links) and ``n_links``, the
number of other rows with a Jaccard similarity of THRESHOLD or more, copies included.

Defined results: null texts count as empty; texts without words link with each other (as equal) and with nothing else;
texts of fewer than five words are one shingle; rows that repeat link with each other; null doc_ids come first
in order, and a class whose least doc_id is null has class_id null; doc_ids of any type that has an order; an empty table gives an empty result; further
columns are not carried. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import grams
from tessera.llm.common import BROADCAST_ROWS, free_names, lookup_join, read, real_key, settle, typed_key

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, LEAST_DEPTH, TARGET = 24, 7, 3, 0.999
#: Classes, and bytes of shingle sets, in a block of a candidate group; blocks of a group whose pairs of blocks are all compared.
BLOCK, BLOCK_BYTES, PARTS = 512, 32 << 20, 8
#: Bytes of shingle sets, and classes, of small groups that are dealt to one task.
DEAL_BYTES, DEAL = 16 << 20, 1_000
#: Edges of a node that are joined apart from others.
HUB = 512


def found_with(m: int, trees: int) -> float:
    """Probability that a pair which shares m of the trees' nodes shares any."""
    return 1 - (1 - m / trees) ** trees


def measured(shared: dict[int, int], depth: int, threshold: float, trees: int) -> float:
    """Recall of links, from the number of star pairs by how many trees they share a node of this depth in."""
    links = {m: n for m, n in shared.items() if m >= round(trees * threshold**depth)}
    stand_for = sum(n / found_with(m, trees) for m, n in links.items())
    return sum(links.values()) / stand_for if links else 1.0


def _sign(words: int, trees: int, seed: int = 20_011):
    """Rows (id, th, k1, k2, n_words, hi, lo) of rows (id, th, text): the first four symbols of each tree's sequence are ``hi``, the others ``lo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 31, trees * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32)
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for at, part in grams.chunks(texts):
                w, n = grams.word_hashes(part)
                k1, k2 = grams.sequence_keys(w, n)
                s, per = grams.shingles(w, n, words)
                full = np.flatnonzero(per)
                first = np.concatenate([[0], np.cumsum(per)])[:-1][full]
                both = np.zeros((2, len(full), trees), dtype=np.uint64)
                x = (s >> np.uint64(32)).astype(np.uint32)
                if len(full):
                    for t in range(trees):
                        for k in range(DEPTH):
                            least = np.minimum.reduceat(x * a[t * DEPTH + k] + b[t * DEPTH + k], first)
                            symbol = grams.mix(least.astype(np.uint64) + np.uint64(k + 1)) & np.uint64(0xFFFF)
                            both[k // 4, :, t] = both[k // 4, :, t] << np.uint64(16) | symbol
                where = pa.array(np.concatenate([[0], np.cumsum(np.where(per > 0, trees, 0))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(where, pa.array(side.reshape(-1).view(np.int64), pa.int64())) for side in both]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), hashes.slice(at, len(part)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int64)), *lists],
                    ["id", "th", "k1", "k2", "n_words", "hi", "lo"],
                )

    return run


def nodes_at(depth: int) -> Column:
    """The nodes of a class: for each tree a hash of the tree and the prefix. Nodes that collide only make candidates more."""
    hi = F.transform("hi", lambda h, t: F.struct(t.alias("t"), F.shiftrightunsigned(h, 16 * (4 - min(depth, 4))).alias("h")))
    if depth <= 4:
        return F.transform(hi, lambda x: F.xxhash64(x["t"], x["h"]))
    return F.zip_with(hi, "lo", lambda x, y: F.xxhash64(x["t"], x["h"], F.shiftrightunsigned(y, 16 * (DEPTH - depth))))


def _sets(words: int):
    """Adds ``shingles`` (sorted distinct hashes as bytes) and drops the text. Rows that repeat in a batch go, as does a text that is not its class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            once = np.sort(np.unique(np.stack([c1, c2], 1), axis=0, return_index=True)[1]) if len(batch) else np.zeros(0, np.int64)
            batch, c1, c2 = batch.take(pa.array(once)), c1[once], c2[once]
            for at, part in grams.chunks(batch.column("text").to_pylist()):
                w, n = grams.word_hashes(part)
                k1, k2 = grams.sequence_keys(w, n)
                s, per = grams.shingles(w, n, words)
                ends = np.cumsum(per)
                own = (k1.view(np.int64) == c1[at : at + len(part)]) & (k2.view(np.int64) == c2[at : at + len(part)])
                made = [np.unique(s[e - p : e]).tobytes() if o else None for e, p, o in zip(ends, per, own)]
                sub = batch.slice(at, len(part))
                names = [c for c in sub.schema.names if c != "text"]
                out = pa.RecordBatch.from_arrays([sub.column(c) for c in names] + [pa.array(made, pa.binary())], names + ["shingles"])
                yield out.filter(pa.array(own))

    return run


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Square matrix: which sets have a Jaccard similarity of the threshold or more."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    common = np.zeros((n, n), dtype=np.int64)
    if n <= 12:
        for i in range(n):
            for j in range(i):
                a, b = size[i], size[j]
                if min(a, b) >= threshold * max(a, b) - 1e-9:
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        col = np.cumsum(new) - 1
        shared = np.bincount(col) > 1
        keep = shared[col]
        row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
        width = max(256, (8 << 20) // (4 * n))
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [c, c + width])
            x = np.zeros((n, width), dtype=np.float32)
            x[row[a:b], col[a:b] - c] = 1
            common += np.rint(x @ x.T).astype(np.int64)
    either = size[:, None] + size[None, :] - common
    # whole numbers: common / either >= threshold
    out = (common > 0) & (common >= threshold * either - 1e-9)
    np.fill_diagonal(out, False)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _earlier(own: list[np.ndarray], node: int) -> np.ndarray:
    """Square matrix: which classes have a common node below ``node``."""
    size = [int(np.searchsorted(x, node)) for x in own]
    flat = np.concatenate([x[:k] for x, k in zip(own, size)])
    out = np.zeros((len(own), len(own)), dtype=np.float32)
    if len(flat):
        _, col = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(own)), size)
        for c in range(0, int(col.max()) + 1, 4096):
            use = (col >= c) & (col < c + 4096)
            x = np.zeros((len(own), 4096), dtype=np.float32)
            x[row[use], col[use] - c] = 1
            out += x @ x.T
    return out > 0


def _verify(threshold: float):
    """(k1, k2, links, r1, r2, many) of one dealt group: whole candidate groups, one pair of blocks of a large one, or of a node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, i, j), g in pdf.drop_duplicates(["k1", "k2", "g1", "g2", "i", "j"]).groupby(["g1", "g2", "i", "j"], sort=False):
            g = g.sort_values(["k1", "k2"])
            m = linked([np.frombuffer(x, dtype=np.uint64) for x in g["shingles"]], threshold)
            if i != j:
                block = g["block"].to_numpy()
                m &= block[:, None] != block[None, :]
            node = g["node"].iloc[0]
            if not pd.isna(node) and m.any():
                # the pairs of other blocks and nodes are counted there, but keep the group together here
                counted = m & ~_earlier([np.asarray(x, dtype=np.int64) for x in g["own"]], int(node))
            else:
                counted = m
            root = _roots(m)
            out.append(pd.DataFrame({"k1": g["k1"], "k2": g["k2"], "links": counted @ g["copies"].to_numpy(), "r1": g["k1"].to_numpy()[root], "r2": g["k2"].to_numpy()[root], "many": g["parts"] > 1}))
        return pd.concat(out)

    return run


def _to(frame: DataFrame, *names: str) -> DataFrame:
    """An edge table with new names for its columns."""
    return frame.toDF(*names)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(n1, n2, r1, r2) of edges(u1, u2, v1, v2): least node of each component, by alternating large and small stars.

    Each round is two grouped minima joined back; intermediate edges are written, so that lineage stays short. Nodes
    that are their component's least are not listed.
    """
    flip = lambda d: d.select(F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
    over = (F.col("v1") > F.col("u1")) | ((F.col("v1") == F.col("u1")) & (F.col("v2") > F.col("u2")))
    down = lambda d: d.where("u1 <> v1 or u2 <> v2").where(~over).unionByName(flip(d.where(over))).distinct()
    # two longs each, so that minima are kept in fixed-width buffers; nodes of equal first and unlike second long are told apart by joins
    least = [F.min("v1").alias("m1"), F.min_by("v2", "v1").alias("m2"), F.count("*").alias("n")]
    e = settle(down(edges), "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(flip(e))
        low = both.groupBy("u1", "u2").agg(*least)
        own = (F.col("m1") < F.col("u1")) | ((F.col("m1") == F.col("u1")) & (F.col("m2") < F.col("u2")))
        low = settle(low.select("u1", "u2", "n", F.when(own, F.col("m1")).otherwise(F.col("u1")).alias("m1"), F.when(own, F.col("m2")).otherwise(F.col("u2")).alias("m2")), "low")
        hubs = low.where(F.col("n") > HUB).select("u1", "u2", "m1", "m2")
        many = hubs.limit(BROADCAST_ROWS + 1).count()
        # the hub of a star has the edges of its whole group: hubs are few, so they are joined where the edges lie
        if many <= BROADCAST_ROWS:
            met = both.join(low.where(F.col("n") <= HUB).drop("n").hint("merge"), ["u1", "u2"])
            if many:
                met = met.unionByName(both.join(F.broadcast(hubs), ["u1", "u2"]))
        else:
            met = lookup_join(both.withColumn("u", F.struct("u1", "u2")), low.select(F.struct("u1", "u2").alias("u"), "m1", "m2"), "u").drop("u")
        large = settle(_to(met.where(over).select("v1", "v2", "m1", "m2"), "u1", "u2", "v1", "v2").distinct(), "large")
        low = large.groupBy("u1", "u2").agg(*least)
        pair = F.array(F.struct(F.col("v1").alias("u1"), F.col("v2").alias("u2"), F.col("m1").alias("v1"), F.col("m2").alias("v2")), F.struct("u1", "u2", F.col("m1").alias("v1"), F.col("m2").alias("v2")))
        e = settle(down(large.join(low.drop("n"), ["u1", "u2"]).select(F.explode(pair).alias("x")).select("x.*")), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u1", "u2", "v1", "v2").cast("decimal(20,0)"))).first())
        if now == seen:
            return _to(e.select("u1", "u2", "v1", "v2"), "n1", "n2", "r1", "r2")
        seen = now
    raise RuntimeError(f"components still changed after {rounds} rounds")


def stars(classes: DataFrame, depth: int) -> DataFrame:
    """(u1, u2, v1, v2, m) of the nodes at a depth: each class with the least class below a node of it, and in how many trees."""
    placed = classes.select("k1", "k2", F.explode(nodes_at(depth)).alias("node"))
    shared = placed.groupBy("node").agg(F.min("k1").alias("v1"), F.min_by("k2", "k1").alias("v2"), F.count("*").alias("n")).where("n > 1")
    pairs = placed.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), "node").join(shared.drop("n"), "node").where("u1 <> v1 or u2 <> v2")
    return pairs.groupBy("u1", "u2", "v1", "v2").agg(F.count("*").cast("int").alias("m"))


def forest(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET) -> tuple[DataFrame, int, float]:
    """The stars of the longest prefixes with the target recall, their depth, and the recall measured there."""
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        found = settle(stars(classes, depth), "stars")
        recall = measured({r["m"]: r["n"] for r in found.groupBy("m").agg(F.count("*").alias("n")).collect()}, depth, threshold, trees)
        if recall >= target:
            break
    return found, depth, recall


def _below_nodes(large: DataFrame, classes: DataFrame, depth: int, block: int) -> DataFrame:
    """Members of very large groups, once for each node with others (nodes with the same classes count as one) and pair of blocks there: columns
    g1, g2, i, j, block, node, and ``own``, the sorted nodes of the class."""
    placed = large.select("k1", "k2").join(classes.select("k1", "k2", F.explode(nodes_at(depth)).alias("node")), ["k1", "k2"])
    # sums of hashes name the set of a node's classes
    h = [F.shiftright(F.xxhash64("k1", "k2", F.lit(k)), 24) for k in range(3)]
    sums = placed.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"h{k}") for k, x in enumerate(h)]).where("n > 1")
    kept = sums.groupBy("n", "h0", "h1", "h2").agg(F.min("node").alias("node")).select("node", F.ceil(F.col("n") / block).cast("int").alias("node_parts"))
    at = settle(placed.join(kept, "node"), "below")
    own = at.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("node")).alias("own"))  # at most one node a tree
    at = at.join(own, ["k1", "k2"]).join(large, ["k1", "k2"])
    at = at.withColumn("block", F.pmod(F.xxhash64("k2", "k1"), F.col("node_parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("node_parts") - 1)))
    return at.withColumn("g1", F.col("node")).withColumn("g2", F.lit(0).cast("long"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """(key, th, k1, k2, class_id, n_links, stays) of every row. k1 and k2 address its sequence of words, th its text;
    ``stays`` marks the first document of each group, with the copies that have its doc_id."""
    rows = docs.select(typed_key(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    signed = settle(rows.mapInArrow(_sign(words, trees), f"id {kind}, th bigint, k1 bigint, k2 bigint, n_words bigint, hi array<bigint>, lo array<bigint>"), "signed")
    classes = settle(signed.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("hi").alias("hi"), F.first("lo").alias("lo")), "classes")
    found, depth, _ = forest(classes, threshold, trees, target)
    groups = settle(components(found.select("u1", "u2", "v1", "v2")), "groups")
    groups = groups.unionByName(groups.select(F.col("r1").alias("n1"), F.col("r2").alias("n2"), "r1", "r2").distinct())
    members = classes.select("k1", "k2", "first", "copies", "n_words").join(_to(groups, "k1", "k2", "g1", "g2"), ["k1", "k2"])
    members = settle(members, "members")
    count = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_words") * 8 / BLOCK_BYTES)).cast("int")
    sized = lookup_join(members.withColumn("g", F.struct("g1", "g2")), members.groupBy("g1", "g2").agg(count.alias("parts")).select(F.struct("g1", "g2").alias("g"), "parts"), "g").drop("g")
    sized = settle(sized, "sized")
    wanted = ["k1", "k2", "first", "copies", "parts", "g1", "g2", "i", "j", "block", "node", "own", "deal"]
    ends = lambda d: d.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = sized.where(F.col("parts") <= parts).withColumn("block", F.pmod(F.xxhash64("k2", "k1"), F.col("parts")).cast("int"))
    dealt = ends(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).withColumn("node", F.lit(None).cast("long")).withColumn("own", F.array().cast("array<bigint>"))
    total = sized.where("parts = 1").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    tasks = max(1, -(-total["n"] // DEAL), -(-total["w"] * 8 // DEAL_BYTES))
    dealt = dealt.withColumn("deal", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("g1", "g2"), F.lit(tasks))).otherwise(F.xxhash64("g1", "g2", "i", "j"))).select(wanted)
    large = sized.where(F.col("parts") > parts).select("k1", "k2", "first", "copies", "parts")
    if large.limit(1).count():
        below = ends(_below_nodes(large, classes, depth, block))
        dealt = dealt.unionByName(below.withColumn("deal", F.xxhash64("g1", "i", "j")).select(wanted))
    # one text for each class, fetched once; members grow with the input, so this join is by a shuffle at every size
    texts = rows.join(members.select("k1", "k2", F.col("first.id").alias("id"), F.col("first.th").alias("th")).hint("merge"), ["id", "th"]).select("k1", "k2", "text")
    sets = texts.mapInArrow(_sets(words), "k1 bigint, k2 bigint, shingles binary")
    pairs = dealt.drop("first").join(sets.hint("merge"), ["k1", "k2"])
    found = pairs.groupBy("deal").applyInPandas(_verify(threshold), "k1 bigint, k2 bigint, links bigint, r1 bigint, r2 bigint, many boolean")
    found = settle(found, "found")
    # groups dealt out in parts: their parts' components are joined; elsewhere the local root is final
    over = components(found.where("many").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("r1").alias("v1"), F.col("r2").alias("v2")))
    root = F.max(F.when(~F.col("many"), F.col("r1"))).alias("r1"), F.max(F.when(~F.col("many"), F.col("r2"))).alias("r2")
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"), *root)
    links = links.join(_to(over, "k1", "k2", "o1", "o2"), ["k1", "k2"], "left")
    links = links.select("k1", "k2", "links", F.coalesce("r1", "o1", "k1").alias("l1"), F.coalesce("r2", "o2", "k2").alias("l2"))
    links = settle(links.join(classes.select("k1", "k2", F.col("first.id").alias("id")), ["k1", "k2"]), "links")
    first = links.groupBy("l1", "l2").agg(F.min(F.struct("id", "k1", "k2")).alias("first"))
    grouped = lookup_join(links.where("links > 0").withColumn("l", F.struct("l1", "l2")).drop("id"), first.select(F.struct("l1", "l2").alias("l"), "first"), "l")
    verified = classes.select("k1", "k2", F.col("first.id").alias("id"), "copies").join(grouped.select("k1", "k2", "links", "first"), ["k1", "k2"], "left")
    verified = verified.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", F.struct("id", "k1", "k2")).alias("first"))
    # written, so that the last join has two plain exchanges and a class with very many rows can be split
    verified = settle(verified, "verified")
    out = signed.select("id", "th", "k1", "k2").join(verified, ["k1", "k2"])
    stays = F.struct("id", "k1", "k2") == F.col("first")
    return out.select(real_key("id").alias(key), "th", "k1", "k2", real_key(F.col("first")["id"]).alias("class_id"), F.col("n_links").cast("long"), stays.alias("stays"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps its first document (least doc_id) once, with all their columns."""
    ident, th = free_names(docs, ["_id", "_th"])
    found = join(docs, key, text, **how).where("stays")
    # of rows with one doc_id and one sequence of words, the first text by its hash, once
    kept = found.groupBy(typed_key(key).alias(ident), "k1", "k2").agg(F.min("th").alias(th), F.count("*").alias("n"))
    kept = settle(kept.select(ident, th, "n"), "kept")
    rows = docs.withColumns({ident: typed_key(key), th: F.xxhash64(text)}).join(kept.select(ident, th), [ident, th], "left_semi")
    if kept.where("n > 1").limit(1).count():
        rows = rows.dropDuplicates([ident, th])
    return rows.drop(ident, th)


def op2_ngram_jaccard_join(spark, sf_dir):
    """All documents with class and number of links."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select("doc_id", "class_id", "n_links")
