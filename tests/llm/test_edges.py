"""Clashing names, doc_ids of other types, nulls, ties and repeated rows: values, not counts, against a plain run or brute force."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, jpeg, licenses, media, mixing, neardup, quality, secrets, sharding, substrings
from tessera.llm.common import free_names

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "té", "so") for b in ("ra", "pen", "t", "zu", "é")]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = words(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("kara", "X", 1)), (4, words(90, 2)), (5, None), (6, ""), (6, ""), (7, "  \n\t "), (8, "one two"), (9, words(3000, 3)),
    (10, words(40, 4) + " " + BASE[100:420] + " " + words(40, 5)), (None, words(50, 6)), (11, "Released under the MIT License.\n" + words(30, 7)),
    (12, 'password = "abcdefgh12" x AKIA' + "A" * 16 + " " + "0a" * 20 + " token=short"), (13, BASE), (13, BASE), (14, words(60, 8)),
]
LABELS = [(i, i % 2) for i in range(1, 15)] + [(1, 1), (2, None), (None, 1)]
BENCH = [(1, BASE[100:300]), (2, "one two"), (3, None), (None, "one two"), (1, BASE[100:300])]

#: Each operator with the columns of its result that are compared; every name that it uses within or gives.
RUNS = {
    "licenses": (lambda s, d: licenses.scan(d), ["licenses", "n_units", "best_license", "best_dice"], ["_sets", "_hits"]),
    "neardup": (lambda s, d: neardup.join(d), ["n_links"], ["class_id", "stays", "id", "th", "k1", "k2", "first", "copies", "node", "block", "own", "hi", "lo"]),
    "first": (lambda s, d: neardup.first_of_each(d), ["text"], ["_id", "_th", "n", "k1", "k2", "class_id"]),
    "substrings": (lambda s, d: substrings.dedup(d), ["n_bytes", "n_removed", "spans", "kept_sha256", "kept"], ["part", "blob", "id", "key", "rid", "th"]),
    "quality": (lambda s, d: quality.score(d, quality.fit(d, s.createDataFrame(LABELS, "doc_id bigint, quality int").select(F.col("doc_id").cast(dict(d.dtypes)["doc_id"]), "quality"))), ["score"], ["y", "x", "k", "h"]),
    "sharding": (lambda s, d: sharding.shard(d), ["_size", "_shard", "_slot"], ["_hash", "_id", "_task", "_place", "_bin", "s", "t", "o", "_start", "n", "least"]),
    "decontaminate": (lambda s, d: decontaminate.decontaminate(d, s.createDataFrame(BENCH, "item_id bigint, text string")), ["n_words", "n_hit", "spans", "items"], []),
    "secrets": (lambda s, d: secrets.findings_by_path(d, secrets.scan_ledger(d)), ["spans"], ["blob", "path", "_b", "_p", "kind", "version", "_salt"]),
    "media": (lambda s, d: media.load(media.store(d)), ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "rgb"], ["media"]),
    "mixing": (lambda s, d: mixing.mix(d), ["_size", "_source_size", "_target", "_rate", "_copies"], ["_key", "_seed", "_source_key", "source_key", "key", "rate", "_salt"]),
}
KEEPS = {"licenses", "first", "quality", "sharding", "decontaminate", "media", "mixing"}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, None if k % 4 == 3 else f"s{k % 4}") for k, (i, t) in enumerate(TEXTS)], "doc_id bigint, text string, source string")


def _rows(df, cols):
    return sorted(json.dumps([r["doc_id"]] + [r[c] for c in cols], default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x)) for r in df.select("doc_id", *cols).collect())


@pytest.fixture(scope="module")
def results(spark, plain):
    return {name: _rows(run(spark, plain), cols) for name, (run, cols, _) in RUNS.items()}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_names(spark, plain, results, name):
    run, cols, inner = RUNS[name]
    clash = [c for c in dict.fromkeys([*cols, *inner, "lang"]) if c not in ("doc_id", "text", "source")]
    d = plain.withColumns({c: F.lit(f"clash {c}") for c in clash})
    out = run(spark, d)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert _rows(out, cols) == results[name]
    if name in KEEPS:
        kept = [c for c in clash if c in out.columns and c not in (*cols, "media")]
        if name != "media":
            assert set(inner) <= set(kept)
        assert all(set(r.asDict().values()) == {f"clash {c}" for c in kept} for r in out.select(kept).distinct().collect())


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("quality", "mixing", "sharding")])
def test_text_ids(spark, plain, results, name):
    """Ids as texts in the order of the numbers. (The model's fold, the mix's draws and the shards' keys depend on the id itself.)"""
    run, cols, _ = RUNS[name]
    got = run(spark, plain.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.lpad(F.col("doc_id").cast("string"), 3, "0"))))
    assert sorted(json.dumps([None if r["doc_id"] is None else int(r["doc_id"])] + [r[c] for c in cols], default=lambda x: x.hex() if isinstance(x, (bytes, bytearray)) else str(x)) for r in got.select("doc_id", *cols).collect()) == results[name]


@pytest.mark.parametrize("name", ["quality", "mixing", "sharding"])
def test_text_ids_run(spark, plain, name):
    run, cols, _ = RUNS[name]
    got = run(spark, plain.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    assert got.count() == len(TEXTS) and got.where(F.col(cols[-1]).isNull()).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_repeated_rows_and_equal_texts(results, name):
    if name in ("sharding", "first", "mixing"):  # there rows of other sources and places
        return
    by = {}
    for r in map(json.loads, results[name]):
        by.setdefault(r[0], []).append(r[1:])
    assert by[6][0] == by[6][1] and by[13][0] == by[13][1]
    if name in ("licenses", "quality", "decontaminate", "secrets", "media"):
        assert by[1] == by[2] == by[13][:1] and by[5] == by[6][:1]


def test_values_of_edge_rows(results):
    one = {n: {json.loads(r)[0]: json.loads(r)[1:] for r in rows} for n, rows in results.items()}
    assert one["licenses"][5] == one["licenses"][8] == [[], 0, None, None]
    assert [one["neardup"][k][0] for k in (1, 2, 13, 5, 6, 7, 8, 9, None)] == [4, 4, 4, 3, 3, 3, 0, 0, 0]
    assert one["substrings"][5][:2] == [0, 0] and one["substrings"][1][1] == 0 and one["substrings"][2][1] == len(BASE.encode()) and one["substrings"][9][1] == 0
    assert one["quality"][5] == one["quality"][7]
    assert one["sharding"][5][0] == 1 and one["sharding"][8][0] == 8
    assert one["decontaminate"][8][:2] == [2, 2] and one["decontaminate"][8][3] == ["2", "null"] and one["decontaminate"][5] == [0, 0, [], []]
    assert one["secrets"][5] == [[]] and len(one["secrets"][12][0]) == 3
    assert one["media"][5][:2] == [0, 64] and one["media"][5][2] == hashlib.sha256(bytes(64)).hexdigest()
    assert one["mixing"][5][0] == 0 and one["mixing"][9][0] == 3000


def test_free_names(spark):
    assert free_names(spark.createDataFrame([(1, 2)], "_a int, __A int"), ["_a", "b", "B"]) == ["___a", "b", "_B"]


def test_shards_against_brute_force(spark):
    rows = [(i, "copy" if i % 3 == 0 else words(1 + i % 40, i % 500)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), task_bytes=2_000).withColumn("h", F.xxhash64("text")).collect()
    total = sum(r["_size"] for r in got)
    assert total == sum(len(t.encode()) + 1 for _, t in rows)
    order = sorted(got, key=lambda r: (r["h"], r["doc_id"]))
    assert [(r["_shard"], r["_slot"]) for r in order] == [(s, k) for s in range(8) for k in range(sum(r["_shard"] == s for r in got))]
    below = np.cumsum([r["_size"] for r in order])
    ends = [max(k for k, r in enumerate(order) if r["_shard"] == s) for s in range(7)]
    most = max(r["_size"] for r in got)
    assert all(abs(below[e] - total * (s + 1) / 8) <= max(total / 8 * sharding.TOLERANCE, most) for s, e in enumerate(ends))


def test_splitters_raise_when_they_do_not_settle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROUNDS", 1)
    d = spark.createDataFrame([(i, words(5, i)) for i in range(500)], "doc_id bigint, text string")
    with pytest.raises(RuntimeError):
        sharding.shard(d, tolerance=1e-9)


def test_classes_against_brute_force(spark):
    """Texts around the threshold, in chains."""
    r = random.Random(11)
    rows = [words(80, 50)]
    for k in range(1, 90):
        w = rows[r.randrange(max(0, k - 6), k)].split()
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"w{k}"
        rows.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((root[a], root[b]))
                root = [x if z == y else z for z in root]
    want = {k: (root[k], links[k]) for k in range(len(rows))}
    for how in ({}, {"block": 6, "parts": 100}, {"block": 6, "parts": 1}):  # whole groups, pairs of blocks, nodes
        assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in neardup.join(d, **how).collect()} == want


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 3)
    r = random.Random(2)
    edges = [(0, 0, k, k) for k in range(1, 12)] + [(20, 1, 21, 1), (21, 1, 22, 1), (22, 1, 5, 5)] + [(30 + k, 0, 31 + k, 0) for k in range(9)] + [(r.randrange(50, 90), 0, r.randrange(50, 90), 0) for _ in range(30)]
    root = {n: n for e in edges for n in (e[:2], e[2:])}
    for _ in root:
        for a, b, c, d in edges:
            root[a, b] = root[c, d] = min(root[a, b], root[c, d])
    got = {(x["n1"], x["n2"]): (x["r1"], x["r2"]) for x in neardup.components(spark.createDataFrame(edges, "u1 bigint, u2 bigint, v1 bigint, v2 bigint")).collect()}
    assert got == {n: x for n, x in root.items() if n != x}


def brute_removed(texts, length=100):
    seen, out = set(), []
    for raw in texts:
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(s)
        out.append(int((np.cumsum(cover)[:-1] > 0).sum()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(100, 32), (400, 32), (40, 8)])
def test_hot_anchors_and_long_windows(spark, monkeypatch, length, gram):
    line = "Read our terms of use before you go on; " + words(length // 5 + 14, 77)
    texts = [words(k % 60, k) + " " + line + " " + words(k % 40, 900 + k) for k in range(40)] + [words(50, 5)] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_removed([t.encode() for t in texts], length)
    cold = [x["n_removed"] for x in substrings.dedup(d, length=length, gram=gram).orderBy("doc_id").collect()]
    every = np.ones(substrings.SLOTS, dtype=bool)
    monkeypatch.setattr(substrings, "hot_slots", lambda *_: every)
    assert cold == [x["n_removed"] for x in substrings.dedup(d, length=length, gram=gram).orderBy("doc_id").collect()] == want


def test_hot_slots_are_those_of_a_common_line(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 20)
    line = "this line of some length stands in very many documents and is the same in all of them, whatever is around it."
    d = spark.createDataFrame([(k, words(20, k) + line + words(20, -k)) for k in range(800)], "id bigint, text string")
    hot = substrings.hot_slots(d, 100, 32)
    runs = substrings.runs_of([line.encode() * 2], np.array([1]))
    assert 0 < hot.sum() < 60 and hot[substrings.slot(runs["bucket"])].any()
    with pytest.raises(ValueError):
        substrings.dedup(d, key="id", length=70_000)


def test_a_benchmark_of_many_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, words(30, 400 + i)) for i in range(40)], "item_id bigint, text string")
    d = spark.createDataFrame([(i, words(20, i) + " " + words(30, 400 + i)) for i in range(12)] + [(99, None)], "doc_id bigint, text string")
    sizes, settled = [], decontaminate.settle
    monkeypatch.setattr(decontaminate, "settle", lambda df, name: sizes.append(str(df._jdf.queryExecution().logical()).count("MapInArrow")) or settled(df, name))
    whole = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate.decontaminate(d, bench).collect()}
    parts = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate.decontaminate(d, bench, block_words=600).collect()}
    assert whole == parts and whole[3][2] == ["3"] and whole[99] == (0, 0, [], [])
    assert len(sizes) > 2 and set(sizes) == {1}


def test_the_model_against_numpy(spark):
    """Fit and scores by plain loops over the same sample."""
    texts = [(i, (words(30, i) if i % 3 else " ".join(f"{w}!!" for w in words(30, i).split()))) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int")
    held = {r["doc_id"] for r in d.where(quality.held_out("doc_id")).collect()}
    sample = sorted(i for i, _ in texts if i not in held)
    index = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIM), dtype=np.int64)
    for _, t in texts:
        e, _ = quality.Entries().of(t)
        for i in range(len(e)):
            for j in range(max(0, i - quality.REACH), min(len(e), i + quality.REACH + 1)):
                if i != j:
                    sums[e[i]] += index[e[j]]
    vectors = quality.word_vectors(sums)

    def pool(t):
        e, shapes = quality.Entries().of(t)
        x = sum(vectors[k].astype(np.float64) for k in e) + sum(vectors[quality.BUCKETS + s] for s in shapes) + sum(vectors[quality.REPEAT] for a, b in zip(e, e[1:]) if a == b)
        return (x / len(e)).astype(np.float32)

    m = quality.train(vectors, np.stack([quality.pooled(dict(texts)[i], vectors, quality.Entries()) for i in sample]).astype(np.float64), np.array([float(i % 3 > 0) for i in sample]))
    got = {r["doc_id"]: r["score"] for r in quality.score(d, quality.fit(d, labels)).collect()}
    for i, t in texts:
        hidden = np.tanh((pool(t) - m.mean) / m.scale @ m.w1 + m.b1)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(hidden @ m.w2 + m.b2) / m.temperature)), abs=1e-4)


def test_scores_do_not_depend_on_neighbours(spark):
    m = quality.train(np.zeros((quality.ENTRIES, quality.DIM), np.float32), np.random.default_rng(1).normal(size=(40, quality.DIM)), np.arange(40) % 2.0)
    x = np.random.default_rng(2).normal(size=(300, quality.DIM))
    assert np.array_equal(m.score(x), np.concatenate([m.score(x[k : k + 1]) for k in range(300)]))


def test_repeated_ids_give_one_model(spark):
    rows = [(i, words(20, i)) for i in range(40)] + [(i, words(20, 100 + i)) for i in range(40)]
    l = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    a, b = (quality.fit(spark.createDataFrame(r, "doc_id bigint, text string"), l) for r in (rows, rows[::-1]))
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature


def test_secrets_of_many_matches(spark):
    text = " ".join(f"token={'x' * (6 + k % 4)} {'0a' * 16}" for k in range(700)) + " é AKIA" + "B" * 14
    d = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    ledger = secrets.scan_ledger(d)
    assert ledger.count() == len(secrets.RULES)  # repeated rows: each blob and rule once
    got = {(s["kind"], s["start"], s["end"]) for s in secrets.findings_by_path(d, ledger).where("doc_id = 2").first()["spans"]}
    import re

    want = {("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{32,}", text)} | {("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}", text)}
    want |= {("assign", m.start(), m.end()) for m in re.finditer("token=([A-Za-z0-9+/_.=-]+)", text) if len(m.group(1)) >= 8}
    assert got == want


def test_full_licence_texts(spark):
    gpl = licenses.TEMPLATES["gpl-3.0"]
    d = spark.createDataFrame([(1, gpl), (2, "\n".join(x for x in gpl.split("\n") if "warranty" not in x)), (3, words(4000, 1)), (4, gpl[: len(gpl) // 3]), (5, licenses.TEMPLATES["apache-2.0"])], "doc_id bigint, text string")
    got = {r["doc_id"]: {x["name"] for x in r["licenses"]} for r in licenses.scan(d).collect()}
    assert "gpl-3.0" in got[1] & got[2] and got[3] == set() and "apache-2.0" in got[5] and "gpl-3.0" not in got[4]


def _chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_takes_strange_json(spark):
    call = lambda i, args: f'{{"tool_calls":[{{"id":"{i}","name":"search","arguments":{args}}}]}}'
    rows = [
        (1, 1, "tool", '{"tool_call_id":"a","content":"\\ud800"}'), (1, 2, "assistant", call("b", '{"query":"x","limit":' + "9" * 400 + "}")), (1, 3, "assistant", call("s", '{"query":{"$ref":"s"}}')),
        (1, 4, "assistant", call("\\ud801", '{"query":"\\ud83d\\ude00"}')), (1, 5, "assistant", "{" * 50_000), (1, 6, "assistant", call("f", '{"query":"x","limit":2.5}')), (1, 7, "assistant", '{"tool_calls":[' + "[" * 900 + "]" * 900 + "]}"),
    ]
    got = {r["turn"]: r for r in chat.link(_chat(spark, rows)).collect()}
    assert got[1]["json"] == '{"content":"\\ud800","role":"tool","tool_call_id":"a"}'
    assert got[2]["problem"] == "$.limit: range" and got[3]["status"] == "cycle" and got[3]["level"] is None
    assert got[4]["call_id"] == "\\ud801" and "😀" in got[4]["json"] and got[5]["kind"] == "text" and got[6]["problem"] == "$.limit: type"


def test_chat_against_brute_force(spark):
    """Whole dialogues with ties, null turns and a turn of very many events: order and positions by a plain sort."""
    r = random.Random(9)
    rows = [(c, r.choice([None, *range(5)]), r.choice(["user", "assistant"]), words(3, r.randrange(60))) for c in (1, 2, None) for _ in range(60)]
    rows += [(3, t, "assistant", f'{{"tool_calls":[{{"id":"{t}","name":"search","arguments":{{"query":{{"$ref":"{t - 2}"}}}}}}]}}') for t in range(9)] + [(3, r.randrange(12), "tool", f'{{"tool_call_id":"{t}"}}') for t in range(9)]
    rows += [(4, 7, "user", f"hot {k}") for k in range(500)]
    got = chat.link(_chat(spark, rows)).collect()
    assert len(got) == len(rows)
    for conv in ("1", "2", None, "3", "4"):
        own = [x for x in got if x["conv"] == conv]
        assert sorted(x["position"] for x in own) == list(range(len(own)))
        keys = [(x["due"], x["level"] is None, x["level"] or 0, x["turn"], x["place"], x["role"]) for x in sorted(own, key=lambda x: x["position"])]
        assert keys == sorted(keys)
    call = {int(x["call_id"]): x for x in got if x["conv"] == "3" and x["kind"] == "call"}
    answered = {int(x["call_id"]): x for x in got if x["conv"] == "3" and x["kind"] == "result"}
    for t in range(9):
        assert call[t]["level"] == (call[t - 2]["level"] + 2 if t >= 2 else 0) and answered[t]["level"] == call[t]["level"] + 1
        assert answered[t]["position"] > call[t]["position"] and (t < 2 or call[t]["position"] > answered[t - 2]["position"])
    assert chat.link(_chat(spark, rows).limit(0)).count() == 0


def test_the_query_has_calls_and_results(spark):
    d = _chat(spark, [(1, 0, "user", "q\"1"), (1, 1, "assistant", "a\n1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a3"), (2, 0, "system", None)])
    got = {(x["conv"], x["kind"], x["call_id"]): (x["status"], x["level"], x["json"]) for x in chat.link(chat.with_calls(d)).where("kind <> 'text'").collect()}
    assert got["1", "call", "c1"][:2] == ("linked", 0) and got["1", "result", "c1"][:2] == ("linked", 1) and got["1", "call", "c3"][:2] == ("no_result", 2)
    assert json.loads(got["1", "call", "c1"][2])["tool_call"]["arguments"] == {"query": "a\n1"}
    assert json.loads(got["1", "result", "c1"][2])["content"] == "q2" and json.loads(got["1", "call", "c3"][2])["tool_call"]["arguments"] == {"url": {"$ref": "c1"}}


def _bits(values):
    return "".join(values)


class _Writer:
    """A progressive encoder that goes symbol by symbol, with the longest codes that keep it simple: every symbol has 8 bits (9 where a code would be all ones)."""

    def __init__(self, restart=0):
        self.symbols, self.restart = list(range(255)), restart

    def table(self, kind):
        # 254 codes of 8 bits and 2 of 9, none of them all ones
        counts = bytes([0] * 7 + [254, 1] + [0] * 7)
        return jpeg._segment(0xC4, bytes([kind]) + counts + bytes(self.symbols))

    def code(self, s):
        return format(s, "08b") if s < 254 else format(254 << 1, "09b")

    def pack(self, pieces):
        out = b""
        for k, p in enumerate(pieces):
            p += "1" * (-len(p) % 8)
            out += bytes(int(p[i : i + 8], 2) for i in range(0, len(p), 8)).replace(b"\xff", b"\xff\x00")
            if k + 1 < len(pieces):
                out += bytes([0xFF, 0xD0 + k % 8])
        return out


def _magnitude(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def _order_of(parts, across, down):
    """(component, block) of an interleaved scan, MCU by MCU."""
    out = []
    for m in range(across * down):
        for i, (h, v, stride, _) in enumerate(parts):
            out.append([(i, (m // across * v + y) * stride + m % across * h + x) for y in range(v) for x in range(h)])
    return [sum(out[k * len(parts) : (k + 1) * len(parts)], []) for k in range(across * down)]


def _write(coefs, sampling, width, height, restart=0):
    """File of zigzag coefficient arrays (rows of whole MCUs): DC with one refinement, AC 1-5 and 6-63 with one refinement each."""
    w = _Writer(restart)
    ht, vt = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * ht)), -(-height // (8 * vt))
    parts = [(h, v, across * h, down * v) for h, v in sampling]
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(jpeg._segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    out += [w.table(0), w.table(0x10)]
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))

    def scan(which, start, end, high, low, units):
        out.append(jpeg._segment(0xDA, bytes([len(which)]) + b"".join(bytes([i + 1, 0]) for i in which) + bytes([start, end, high << 4 | low])))
        step = restart or len(units)
        out.append(w.pack([_bits(units[k : k + step]) for k in range(0, len(units), step)]))

    mcus = _order_of(parts, across, down) if len(parts) > 1 else None
    blocks_of = lambda i: [y * parts[i][2] + x for y in range(-(-(-(-height * parts[i][1] // vt)) // 8)) for x in range(-(-(-(-width * parts[i][0] // ht)) // 8))]
    mcus = mcus or [[(0, b)] for b in blocks_of(0)]
    first, last = [], [0] * len(parts)
    for k, m in enumerate(mcus):
        if restart and k % restart == 0:
            last = [0] * len(parts)
        bits = ""
        for i, b in m:
            v = int(coefs[i][b, 0]) >> 1
            n, x = _magnitude(v - last[i])
            bits, last[i] = bits + w.code(n) + x, v
        first.append(bits)
    scan(range(len(parts)), 0, 0, 0, 1, first)

    def ac(i, start, end, low):
        """First pass, an end of band for each block (a run of one)."""
        units = []
        for b in blocks_of(i):
            bits, run, row = "", 0, [int(np.sign(c)) * (abs(int(c)) >> low) for c in coefs[i][b]]
            for k in range(start, end + 1):
                if not row[k]:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + w.code(0xF0), run - 16
                n, x = _magnitude(row[k])
                bits, run = bits + w.code(run << 4 | n) + x, 0
            units.append(bits + (w.code(0) if run else ""))
        scan([i], start, end, 0, low, units)

    def refine(i, start, end, low):
        units = []
        for b in blocks_of(i):
            row = [int(c) for c in coefs[i][b]]
            bits, run, late, lasts = "", 0, "", max([k for k in range(start, end + 1) if abs(row[k]) >> low == 1], default=0)
            for k in range(start, end + 1):
                size = abs(row[k]) >> low
                if not size:
                    run += 1
                    continue
                while run > 15 and k <= lasts:
                    bits, run, late = bits + w.code(0xF0) + late, run - 16, ""
                if size > 1:
                    late += str(size & 1)
                else:
                    bits, run, late = bits + w.code(run << 4 | 1) + ("1" if row[k] > 0 else "0") + late, 0, ""
            units.append(bits + (w.code(0) + late if run or late else ""))
        scan([i], start, end, low + 1, low, units)

    for i in range(len(parts)):
        ac(i, 1, 5, 0)
        ac(i, 6, 63, 1)
    for i in range(len(parts)):
        refine(i, 6, 63, 0)
    scan(range(len(parts)), 0, 0, 1, 0, ["".join(str(int(coefs[i][b, 0]) & 1) for i, b in m) for m in mcus])
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [((1, 1),), ((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("restart", [0, 2])
def test_files_made_symbol_by_symbol(sampling, restart):
    """Grey, 4:4:4, 4:2:0 and 4:2:2; with restarts; odd sizes. Pixels by the textbook sums."""
    r = np.random.default_rng(len(sampling) + restart)
    width, height = 27, 21
    ht, vt = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * ht)), -(-height // (8 * vt))
    coefs = []
    for h, v in sampling:
        c = r.integers(-9, 10, (across * h * down * v, 64)) * (r.random((across * h * down * v, 64)) < 0.15)
        c[:, 0] = r.integers(-200, 200, len(c))
        coefs.append(c)
    im = jpeg.decode(_write(coefs, sampling, width, height, restart))
    for part, c, (h, v) in zip(im.parts, coefs, sampling):
        inside = [y * part.stride + x for y in range(part.high) for x in range(part.wide)] if len(sampling) == 1 else range(len(c))
        assert np.array_equal(part.coef[list(inside), 0], c[list(inside), 0])
        seen = [y * part.stride + x for y in range(part.high) for x in range(part.wide)]
        assert np.array_equal(part.coef[seen], c[seen])
    # one pixel by the double sum over frequencies
    got = jpeg.rgb(im)
    assert got.shape == (height, width, 3)
    zig = jpeg.zigzag()

    def sample(i, y, x):
        h, v = sampling[i]
        py, px = y * v // vt, x * h // ht
        c = im.parts[i].coef[(py // 8) * im.parts[i].stride + px // 8]
        total = 0.0
        for z in range(64):
            fy, fx = divmod(int(zig[z]), 8)
            scale = (0.5**0.5 if fy == 0 else 1) * (0.5**0.5 if fx == 0 else 1) / 4
            total += scale * c[z] * (z + 1) * np.cos((2 * (py % 8) + 1) * fy * np.pi / 16) * np.cos((2 * (px % 8) + 1) * fx * np.pi / 16)
        return min(255, max(0, round(total + 128)))

    for y, x in ((0, 0), (20, 26), (9, 13), (16, 3)):
        p = [sample(i, y, x) for i in range(len(sampling))]
        want = [p[0]] * 3 if len(p) == 1 else [p[0] + 1.402 * (p[2] - 128), p[0] - 0.344136 * (p[1] - 128) - 0.714136 * (p[2] - 128), p[0] + 1.772 * (p[1] - 128)]
        assert all(abs(int(g) - min(255, max(0, e))) <= 2 for g, e in zip(got[y, x], want))
