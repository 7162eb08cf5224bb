"""The pipeline against a brute-force version over the same decisions of the classifier."""

from collections import Counter

import corpus_pipeline as P
from tessera.llm import decontaminate, mixing, quality
from tessera.llm.common import read

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs, labels, bench = (read(spark, SF, n) for n in ("documents", "labels", "benchmark"))
    rows = [r for r in quality.score(docs, quality.fit(docs, labels)).orderBy("doc_id").collect() if r["score"] >= quality.CUT]
    sets, root = [], list(range(len(rows)))
    for r in rows:
        w = r["text"].split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    rows = [r for k, r in enumerate(rows) if top(k) == k]
    windows = set()
    for r in bench.collect():
        w = decontaminate.words_of(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(text):
        w = decontaminate.words_of(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    rows = [r for r in rows if clean(r["text"])]
    got = P.run(spark, SF).toPandas()
    kept = {r["doc_id"] for r in rows}
    assert set(got["doc_id"]) <= kept
    mixed = mixing.mix(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id bigint, text string, source string")).collect()
    want = Counter({r["doc_id"]: r["_copies"] for r in mixed if r["_copies"]})
    assert Counter(got["doc_id"].tolist()) == want
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
