"""Operators against brute force, and on null, empty, long, repeated, clashing and missing rows."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, licenses, media, mixing, neardup, quality, secrets, sharding, substrings

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "té", "so") for b in ("ra", "pen", "t", "zu", "é")]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = words(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("kara", "X", 1)), (4, words(90, 2)), (5, None), (6, ""), (6, ""), (7, "  \n\t "), (8, "one two"), (9, words(3000, 3)),
    (10, words(40, 4) + " " + BASE[100:420] + " " + words(40, 5)), (None, words(50, 6)), (11, "Released under the MIT License.\n" + words(30, 7)),
    (12, 'password = "abcdefgh12" x AKIA' + "A" * 16 + " " + "0a" * 20 + " token=short"), (13, BASE),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if k % 4 == 3 else f"s{k % 4}", len(t or ""), -1.0, "clash", "clash") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BASE[100:300]), (2, "one two"), (3, None), (4, "absent words here"), (None, "one two"), (1, BASE[100:300])], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)] + [(1, 1, 0), (2, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


EVERY = {
    "licenses": lambda d, b, l: licenses.scan(d),
    "neardup": lambda d, b, l: neardup.join(d),
    "substrings": lambda d, b, l: substrings.dedup(d),
    "quality": lambda d, b, l: quality.score(d, quality.fit(d, l)),
    "sharding": lambda d, b, l: sharding.shard(d),
    "decontaminate": lambda d, b, l: decontaminate.decontaminate(d, b),
    "secrets": lambda d, b, l: secrets.findings_by_path(d, secrets.scan_ledger(d)),
    "media": lambda d, b, l: media.load(media.store(d)),
    "mixing": lambda d, b, l: mixing.mix(d),
}


@pytest.mark.parametrize("name", EVERY)
def test_edge_rows_and_empty_tables(docs, bench, labels, name):
    assert EVERY[name](docs, bench, labels).count() == len(TEXTS)
    assert EVERY[name](docs.limit(0), bench, labels).count() == 0
    if name in ("decontaminate", "quality"):
        assert EVERY[name](docs, bench.limit(0), labels.limit(0)).count() == len(TEXTS)


def test_licenses_find_a_line(docs):
    got = {r["doc_id"]: r["best_license"] for r in licenses.scan(docs).collect()}
    assert {k for k, v in got.items() if v} == {11} and got[11] == "mit-line"


CC = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
LINES = {
    "Licensed under CC0 1.0.": "cc0-1.0-short", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.": "cc0-1.0-line",
    # the other licence lines of the documents table
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-line", "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "mit-line", "Licensed under the Apache License, Version 2.0.": "apache-2.0-line",
}
for _k, _v in CC.items():
    LINES |= {f"Licensed under CC {_k} 4.0.": f"cc-{_k.lower()}-4.0-short", f"This work is licensed under a Creative Commons {_v} 4.0 International License.": f"cc-{_k.lower()}-4.0-line"}


def test_licenses_report_every_line(spark):
    d = spark.createDataFrame([(i, words(30, i) + "\n" + t + "\n" + words(30, i + 1), t) for i, t in enumerate(LINES)], "doc_id bigint, text string, line string")
    got = {r["line"]: [x["name"] for x in r["licenses"]] for r in licenses.scan(d).collect()}
    assert got == {t: [name] for t, name in LINES.items()}


def test_licenses_are_found_wherever_they_stand(spark):
    mit = licenses.TEMPLATES["mit"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    wrapped = licenses.TEMPLATES["mpl-2.0-notice"].replace("Public License", "Public\n# License").replace("file, You", "file,\n# You")
    sa = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    rows = {
        1: (f"{words(300, 1)}\n\nCopyright (c) 2001 A\n\n{mit}\n\n{words(300, 2)}", ["mit"]), 2: (f"{words(40, 3)}\n# {wrapped}\n{words(40, 4)}", ["mpl-2.0-notice"]),
        3: (f"{words(20, 5)}. Released under the MIT License. More {words(20, 6)}", ["mit-line"]), 4: (f"{words(20, 7)} {sa} {words(20, 8)}", ["cc-by-sa-4.0-line"]),
        5: (f"{words(9, 9)} {licenses.TEMPLATES['apache-2.0-header']} {words(90, 9)} {licenses.TEMPLATES['mit']} {words(9, 8)}", ["apache-2.0-header", "mit"]),
        6: (f"{words(20, 5)} the licensed software was released under no permission {words(20, 6)}", []), 7: (f"{words(9, 5)} Licensed under CC BY-NC-SA 4.0. {words(9, 6)}", ["cc-by-nc-sa-4.0-short"]),
    }
    got = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: sorted(x["name"] for x in r["licenses"]) for r in got} == {k: names for k, (_, names) in rows.items()}
    assert all(r["best_dice"] == pytest.approx(1.0) for r in got if r["licenses"])


def test_license_anchors_leave_no_template_out():
    every = [licenses.grams_of(t) for t in licenses.TEMPLATES.values()]
    some = set(licenses.anchors(every, licenses.THRESHOLD))
    assert all(sum(not some.intersection(b.split(" ")) for b in g) < licenses.need(len(g), licenses.THRESHOLD) for g in every)


def test_neardup_links(docs):
    sets = []
    for _, t in TEXTS:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else frozenset())
    links = [0] * len(sets)
    for a, b in combinations(range(len(sets)), 2):
        either = len(sets[a] | sets[b])
        if not either or len(sets[a] & sets[b]) >= 0.8 * either:
            links[a] += 1
            links[b] += 1
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_links"]) for r in neardup.join(docs).collect())
    assert got == sorted((-1 if i is None else i, n) for (i, _), n in zip(TEXTS, links))


def test_neardup_large_groups_are_dealt_in_blocks(spark):
    rows = [(i, BASE + f" tail{i}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.join(d, block=8).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 29)}
    assert [r["doc_id"] for r in neardup.first_of_each(d).collect()] == [0]


def test_prefixes_shorten_until_the_recall_is_reached(spark, monkeypatch):
    # 100 pairs in all trees and 4 in the fewest that a link is expected in: those stand for more
    few = round(neardup.TREES * 0.8**neardup.DEPTH)
    assert neardup.measured({neardup.TREES: 100}, neardup.DEPTH, 0.8, neardup.TREES) == 1
    assert neardup.measured({few: 4, 1: 1000}, neardup.DEPTH, 0.8, neardup.TREES) == pytest.approx(neardup.found_with(few, neardup.TREES))
    asked = []

    def stars(classes, depth):
        asked.append(depth)
        return spark.createDataFrame([(0, 0, 1, 1, 24 - 4 * len(asked) if len(asked) < 3 else 24)], "u1 bigint, u2 bigint, v1 bigint, v2 bigint, m int")

    monkeypatch.setattr(neardup, "stars", stars)
    monkeypatch.setattr(neardup, "measured", lambda shared, *_: min(shared) / 24)
    assert neardup.forest(None, target=1.0)[1:] == (neardup.DEPTH - 2, 1.0) and asked == [neardup.DEPTH - k for k in range(3)]


def brute_removed(texts):
    seen, out = set(), []
    for raw in texts:
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(s)
        out.append(np.cumsum(cover)[:-1] > 0)
    return out


def test_substrings_match_brute_force(spark):
    r = random.Random(5)
    texts = [words(r.randrange(1, 120), k) for k in range(20)]
    texts += [texts[3] + "|" + texts[7], texts[5][:150] + "é" + texts[5][20:], "ab" * 200, words(30, 99) * 3, "", texts[2]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in substrings.dedup(d).collect()}
    for i, (raw, on) in enumerate(zip([t.encode() for t in texts], brute_removed([t.encode() for t in texts]))):
        kept = np.frombuffer(raw, np.uint8)[~on].tobytes()
        assert (got[i]["n_removed"], bytes(got[i]["kept"]), got[i]["kept_sha256"]) == (int(on.sum()), kept, hashlib.sha256(kept).hexdigest())


def test_spark_hash(spark):
    x = np.array([0, 1, -7, 1 << 62], dtype=np.int64)
    d = spark.createDataFrame([(int(v),) for v in x], "x bigint")
    assert [r[0] for r in d.select(F.xxhash64("x")).collect()] == substrings.spark_hash(x).tolist()


def test_quality_learns_and_keeps_the_fold(spark):
    good, bad = [(i, words(80, i)) for i in range(200)], [(i, " ".join(f"{w}$$$" for w in words(80, i).split())) for i in range(200, 300)]
    d = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    l = spark.createDataFrame([(i, int(i < 200)) for i in range(300)], "doc_id bigint, quality int")
    m = quality.fit(d, l)
    got = quality.score(d, m).withColumn("held", quality.held_out("doc_id")).collect()
    held = [r for r in got if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] < 200) for r in held]) > 0.95


@pytest.mark.parametrize("same", [False, True])
def test_shards_are_near_equal(spark, same):
    rows = [(i, "copy" if same and i % 3 == 0 else words(1 + i % 50, i)) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    sizes = got.groupby("_shard")["_size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * got["_size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("_shard")["_slot"])


def test_decontamination(docs, bench):
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert out[1]["items"] == ["1"] and out[8]["items"] == ["2", "null"] and out[8]["n_hit"] == 2
    assert out[4]["n_hit"] == 0 and out[5]["n_words"] == 0
    parts = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, block_words=20, shard_bytes=500).collect()}
    assert {k: (r["n_hit"], r["items"]) for k, r in out.items()} == {k: (r["n_hit"], r["items"]) for k, r in parts.items()}


def test_fm_index_counts_and_places():
    r = np.random.default_rng(1)
    seq = np.concatenate([r.integers(0, 4, 400), [0]])
    fm = decontaminate.FmIndex(seq, 3)
    for p in ([1], [2, 3], [1, 1, 2], [3, 3, 3, 3]):
        lo, hi = fm.search(np.array([p]))
        want = [i for i in range(len(seq) - len(p) + 1) if list(seq[i : i + len(p)]) == p]
        assert sorted(fm.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_secrets_ledger_is_incremental(docs):
    first = secrets.scan_ledger(docs)
    assert secrets.scan_ledger(docs, first).count() == 0
    newer = tuple(secrets.Rule(r.kind, 2, r.pattern, r.by_value, r.base) if r.kind == "hex" else r for r in secrets.RULES)
    again = secrets.scan_ledger(docs, first, newer)
    assert {(r["kind"], r["version"]) for r in again.select("kind", "version").distinct().collect()} == {("hex", 2)}
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.findings_by_path(docs, first).collect()}
    assert [k for k, _, _ in spans[12]] == ["assign", "access", "hex"] and spans[6] == []


def test_media_round_trip(docs):
    for r, (_, t) in zip(sorted(media.load(media.store(docs)).collect(), key=lambda r: r["n_bytes"]), sorted(TEXTS, key=lambda x: len((x[1] or "").encode()))):
        raw = (t or "").encode()
        assert r["payload_sha256"] == hashlib.sha256(raw + bytes(-len(raw) % 64 or 64 * (not raw))).hexdigest()
        assert len(r["rgb"]) == r["width"] * r["height"] * 3


def test_mix_meets_targets(spark):
    rows = [(i, words(20 + i % 60, i), f"s{i % 5}" if i % 5 else None) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    total = got["_size"].sum()
    by = got.assign(taken=got["_size"] * got["_copies"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("_target", "first"), size=("_source_size", "first"))
    assert by["target"].sum() == pytest.approx(1.5 * total) and (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"]).all() and got["_copies"].max() <= 2


def test_chat_links_orders_and_validates(spark):
    call = lambda *x: '{"tool_calls":[' + ",".join(f'{{"id":"{i}","name":"{n}","arguments":{a}}}' for i, n, a in x) + "]}"
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", call(("b", "fetch", '{"url":{"$ref":"a"}}'), ("a", "search", '{"query":"x","limit":2.0}'))),
        (1, 2, "tool", '{"tool_call_id":"b","content":1}'), (1, 3, "tool", '{"tool_call_id":"a","content":{"z":1,"a":2}}'), (1, 4, "tool", '{"tool_call_id":"zz"}'),
        (2, 0, "assistant", call(("x", "nope", "{}"), ("y", "fetch", '{"url":{"$ref":"z"}}'), ("z", "fetch", '{"url":{"$ref":"y"}}'))), (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.link(d).orderBy("conv", "position").collect()
    one = [(r["kind"], r["call_id"], r["status"], r["level"]) for r in got if r["conv"] == "1"]
    assert one == [("text", None, "text", 0), ("call", "a", "linked", 0), ("result", "a", "linked", 1), ("call", "b", "linked", 2), ("result", "b", "linked", 3), ("result", "zz", "orphan", 0)]
    assert [(r["call_id"], r["status"], r["problem"]) for r in got if r["conv"] == "2"] == [("x", "no_result", "unknown tool"), ("y", "cycle", None), ("z", "cycle", None)]
    assert next(r["json"] for r in got if r["call_id"] == "a" and r["kind"] == "result") == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"a"}'
    assert chat.link(d.limit(0)).count() == 0


def _call(i, refs):
    args = ",".join(f'"k{k}":{{"$ref":"{r}"}}' for k, r in enumerate(refs))
    return f'{{"tool_calls":[{{"id":"{i}","name":"fetch","arguments":{{{args}}}}}]}}'


def test_chat_levels_of_chains_of_any_length(spark):
    n = 1_100
    rows = [(1, k, "assistant", _call(k, [k - 1] if k else [])) for k in range(n)] + [(1, n, "assistant", _call(n, [n - 1, 3])), (1, n + 1, "assistant", _call("p", ["q"])), (1, n + 2, "assistant", _call("q", ["p"])), (1, n + 3, "assistant", _call("r", ["q"]))]
    got = {r["call_id"]: (r["status"], r["level"]) for r in chat.link(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {str(k): ("no_result", 2 * k) for k in range(n + 1)} | {k: ("cycle", None) for k in "pqr"}


def test_chat_levels_match_brute_force(spark):
    r = random.Random(4)
    refs = {k: r.sample([j for j in range(40) if j < k or r.random() < 0.02], r.choice([0, 1, 1, 1, 2]) if k > 2 else 0) for k in range(40)}
    turn = {k: r.randrange(100) for k in refs}
    answered = {k: r.randrange(100) for k in refs if k % 3}
    rows = [(1, turn[k], "assistant", _call(k, v)) for k, v in refs.items()] + [(1, t, "tool", f'{{"tool_call_id":"{k}","content":1}}') for k, t in answered.items()]
    want = {}
    for _ in refs:
        for k, v in refs.items():
            need = [x for x in v if x != k]
            if all(x in want for x in need):
                level = max([want[x][0] + 2 for x in need], default=0)
                due = max([turn[k]] + [want[x][2] for x in need])
                want[k] = (level, due, max(due, answered.get(k, turn[k])))
    got = chat.link(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).where("kind = 'call'").collect()
    assert {int(x["call_id"]): (x["level"], x["due"]) for x in got if x["status"] != "cycle"} == {k: v[:2] for k, v in want.items()}
    assert len(got) == 40


def test_word_vectors_are_made_from_all_documents(spark):
    texts = [words(50, k) for k in range(8)] + ["unlabelled zebra unlabelled"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    index, want = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM), dtype=np.int64)
    for t in texts:
        e, _ = quality.Entries().of(t)
        for i, j in ((i, j) for i in range(len(e)) for j in range(len(e)) if 0 < abs(i - j) <= quality.REACH):
            want[e[i]] += index[e[j]]
    assert (quality.contexts(d.select("text")) == want).all()
    model = quality.fit(d, spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id bigint, quality int"), sample=4)
    assert np.array_equal(model.vectors, quality.word_vectors(want))
