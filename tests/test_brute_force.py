"""Operators without SQL against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import windows as X


def _texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice("a b c d e. f! g?".split()) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_rouge_l(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(_texts(40, 1), _texts(40, 2)))]
    got = {r["k"]: r for r in E.rouge_l(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b", ["k"]).collect()}
    for k, a, b in rows:
        x, y = ([w.strip(".!?") for w in t.split()] for t in (a, b))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        p, r = (best[-1][-1] / len(z) if z else 0.0 for z in (x, y))
        assert (got[k]["precision"], got[k]["recall"], got[k]["f1"]) == (pytest.approx(p), pytest.approx(r), pytest.approx(2 * p * r / (p + r) if p + r else 0.0))


def test_p_values(spark):
    # by tables of Student's t: |t| = 2.101 with 18 degrees of freedom and 2.228 with 10 are at five per cent
    rows = [(2.101 / (18 + 2.101**2) ** 0.5, 20, 0.05), (-2.228 / (10 + 2.228**2) ** 0.5, 12, 0.05), (0.0, 9, 1.0), (1.0, 5, 0.0)]
    got = spark.createDataFrame(rows, "r double, n int, want double").withColumn("p", E.r_p_value("r", "n")).collect()
    assert all(x["p"] == pytest.approx(x["want"], abs=1e-4) for x in got)


def test_prefix_and_sliding_coverage(spark):
    rows = list(enumerate(_texts(30, 3)))
    d = spark.createDataFrame(rows, "doc_id int, text string")
    tokens = X.token_spans(d)
    for mode in ("prefix", "sliding"):
        win = X.windows(d, cap=12, overlap=3, mode=mode)
        by = {}
        for w in win.collect():
            by.setdefault(w["doc"], []).append((w["start"], w["end"]))
        got = {r["doc"]: r["ratio"] for r in X.coverage(tokens, win).collect()}
        for k, t in rows:
            spans, at = [], 0
            for w in t.split():
                at = t.index(w, at)
                spans.append((at, at + len(w)))
                at += len(w)
            inside = [any(a <= s and e <= b for a, b in by[k]) for s, e in spans]
            assert got[k] == pytest.approx(sum(inside) / len(inside) if inside else 1.0)
            assert mode == "prefix" or all(inside)


def test_paragraph_chunks(spark):
    texts = ["\n".join(t.replace(". ", ".\n").split("\n")) for t in _texts(25, 4)]
    got = X.paragraph_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text", 7).collect()
    for k, t in enumerate(texts):
        own = [r["text"] for r in sorted((r for r in got if r["doc"] == k), key=lambda r: r["chunk"])]
        assert " ".join(" ".join(own).split()) == " ".join(t.split()) and all(len(c.split()) <= 7 for c in own)
        # no chunk could have taken the next one's first paragraph
        assert all(len(a.split()) + len(b.split("\n")[0].split()) > 7 for a, b in zip(own, own[1:]))


def test_windows_with_planted_faults(spark):
    d = spark.createDataFrame([(1, "ab cd ef gh")], "doc_id int, text string")
    w = spark.createDataFrame([(1, 0, 0, 5, 4, "ab cd"), (1, 1, 0, 5, 900, "ab cd"), (1, 2, 9, 11, 3, "xx")], "doc int, window_id int, start int, end int, tokens int, text string")
    got = sorted((r["window_id"], r["problem"]) for r in X.violations(w, d).collect())
    assert got == [(1, "no_advance"), (1, "over_cap"), (2, "not_a_slice"), (2, "uncovered")]
    assert X.violations(X.windows(d, cap=5, overlap=1), d, cap=5).count() == 0
    assert X.violations(w.where(F.col("window_id") == 0), d).first()["problem"] == "uncovered"


def test_coverages_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(X, "HELD", 50)
    d = spark.createDataFrame([*enumerate(_texts(30, 3)), (98, None), (99, "  x y  ")], "doc_id int, text string")
    tokens, rows = X.token_spans(d), X.coverages(d, cap=12, overlap=3).frame()
    for mode in ("prefix", "sliding"):
        win = X.windows(d, cap=12, overlap=3, mode=mode)
        want = sorted((r["doc"], r["n_tokens"], r["ratio"]) for r in X.coverage(tokens, win).collect())
        assert sorted((r["doc"], r["n_tokens"], r[mode]) for r in rows.collect()) == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_rouge_of_a_pair_in_its_row(spark):
    rng = random.Random(5)
    for _ in range(200):
        a, b = (["w%d" % rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for k, y in enumerate(b):
                row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
        assert E.common_words(a, b) == row[-1]
    p = spark.createDataFrame([(1, "a b a b C", "b a b"), (2, None, "x"), (3, "x", ""), (4, "a", "b c")], "k int, a string, b string")
    for r in (E.rouge_n(p, "a", "b", 2, ["k"]), E.rouge_l(p, "a", "b", ["k"])):
        plan = r._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    got = {r["k"]: tuple(r)[1:] for r in E.rouge_n(p, "a", "b", 2, ["k"]).collect()}
    assert got == {1: (0.5, 1.0, pytest.approx(2 / 3)), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
