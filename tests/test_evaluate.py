import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators import relational as R


def test_ties_are_errors(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (None, 1.0)], "c double, h double")
    r = E.pairwise_accuracy(d, "h", "c").first()
    assert (r["n"], r["n_correct"], r["n_tie"]) == (3, 1, 1) and r["fn_rate"] == pytest.approx(2 / 3)


def test_constant_and_short_inputs(spark):
    d = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert E.pearson(d, "x", "y").first()["status"] == "undefined_constant_input"
    assert E.pearson(d.limit(2), "x", "y").first()["status"] == "insufficient_data"


def test_ranks(spark):
    d = spark.createDataFrame([(10,), (10,), (8,)], "x int")
    assert sorted(r[0] for r in d.select(E.average_rank("x", descending=True)).collect()) == [1.5, 1.5, 3.0]


def test_p_value(spark):
    d = spark.createDataFrame([(0.5, 20)], "r double, n int")
    assert d.select(E.r_p_value("r", "n")).first()[0] == pytest.approx(0.0247, abs=2e-4)


def test_parsers(spark):
    d = spark.createDataFrame([("Yes",), ("Answer: no",), ("maybe",), ("4 stars",)], "x string")
    assert [tuple(r) for r in d.select(T.yes_no("x"), T.stars("x")).collect()] == [(1, None), (0, None), (None, None), (None, 4)]


def test_many_to_many_is_excluded(spark):
    a = spark.createDataFrame([("e", "s", 1.0, "ok"), ("e", "s", 2.0, "ok"), ("e", "t", 1.0, "ok")], "event string, system string, x double, status string")
    b = spark.createDataFrame([("e", "s", 1.0, "ok"), ("e", "t", float("nan"), "ok")], "event string, system string, y double, status string")
    got = {r["system"]: r["reason"] for r in R.guarded_join(a, b, ["event", "system"], "x", "y").collect()}
    assert got == {"s": "many_to_many", "t": "right_not_finite"}


def test_posts_sort_blank_times_last(spark):
    d = spark.createDataFrame([("e", "b", "2020-01-02 00:00:00", 0), ("e", "a", "2020-01-01 00:00:00", 1), ("e", "c", "", 2), ("e", "a", "2020-01-03 00:00:00", 3)], "k string, t string, ts string, pos int")
    r = R.ordered_text(d, "k", "t", "ts", "pos").first()
    assert (r["source_text"], r["n_raw"], r["n_kept"], r["sort_mode"]) == ("a\nb\nc", 4, 3, "timestamp")


def test_matching_is_one_to_one(spark):
    d = spark.createDataFrame([("u", 0, "abc abc abc"), ("u", 1, "abc abc abc")], "uid string, i int, text string")
    got = R.greedy_match(d, d.withColumnRenamed("i", "j"), "uid").collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(0, 1), (1, 0)]
    assert F is not None


def test_bootstrap_queries_take_all_replicates(spark, monkeypatch):
    from tessera.plans import queries as Q

    d = spark.createDataFrame([(f"s{k % 5}", f"e{k}", float(k % 7), float(k * k % 11)) for k in range(40)], "system string, event string, x double, y double")
    monkeypatch.setattr(Q, "_scores", lambda *_: d)
    for q in (Q.a14, Q.a15):
        r = q(spark, "").first()
        assert r["estimates"] + r["skipped"] == 10_000


def test_phrases_meet_their_best_sentence(spark):
    ph = spark.createDataFrame([(1, 0, "Red fox"), (1, 1, "red, fox"), (1, 2, "a fox ran home"), (1, 3, "qqq"), (2, 0, "alone")], "k int, p int, phrase string")
    se = spark.createDataFrame([(1, 0, "No match here."), (1, 1, "The Red fox sat."), (1, 2, "It was a red  fox, that fox ran.")], "k int, i int, sentence string")
    got = {(r["k"], r["p"]): (r["i"], r["how"]) for r in E.align_phrases(ph, se, ["k"]).collect()}
    assert got == {(1, 0): (1, "exact"), (1, 1): (2, "casefold"), (1, 2): (2, "overlap"), (1, 3): (0, "semantic"), (2, 0): (-1, "none")}


def test_wording_cases(spark):
    rows = [(None, 0.1, 0.2, "insufficient_stats"), (0.2, 0.1, 0.3, "A"), (0.2, -0.1, 0.3, "B"), (0.01, 0.005, 0.02, "B"), (-0.1, -0.2, -0.05, "C")]
    d = spark.createDataFrame(rows, "d double, low double, high double, want string")
    assert all(r["want"] == r["got"] for r in d.withColumn("got", E.wording(F.lit(True), F.col("d"), F.col("low"), F.col("high"))).collect())
    assert d.where(E.wording(F.lit(False), F.col("d"), F.col("low"), F.col("high")) == "C").count() == 4


def test_one_failing_row_leaves_the_others(spark):
    d = spark.createDataFrame([(1,), (0,), (4,)], "x int").withColumn("r", E.isolated(lambda x: 8.0 / x, "double")("x"))
    assert [(r["r"]["value"], r["r"]["error"] and r["r"]["error"].split(":")[0]) for r in d.collect()] == [(8.0, None), (None, "ZeroDivisionError"), (2.0, None)]


def test_a_metric_with_labels(spark):
    s = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.1)], "k string, x double")
    l = spark.createDataFrame([("a", "success", 0.2), ("b", "success", 0.3), ("c", "success", 1.0), ("d", "success", None), ("e", "failed", 0.1)], "k string, state string, y double")
    assert {r["k"]: r["why"] for r in R.scores_with_labels(s, l, "k", "state", "y", "x").collect()} == {"a": "used", "b": "missing_sim", "c": "skip_score1", "d": "missing_sim", "e": "skip_state"}


def test_matches_and_what_has_none(spark):
    left = spark.createDataFrame([(1, 0, "a b c d e f g h"), (1, 1, "quite another text"), (2, 0, "x")], "u int, i int, text string")
    right = spark.createDataFrame([(1, 0, "a  b c d e f g h"), (1, 1, "zzz")], "u int, j int, text string")
    m = R.greedy_match(left, right, "u")
    assert [(r["u"], r["i"], r["j"]) for r in m.collect()] == [(1, 0, 0)]
    assert {(r["u"], r["i"], r["reason"]) for r in R.match_ledger(left, right, m, "u").collect()} == {(1, 1, "below_threshold"), (2, 0, "no_label")}


def test_posts_are_cleaned(spark):
    x = spark.createDataFrame([("RT  hi\r\n@Ünal see HTTPS://a.b/ü #Größe \U0001F600 ﬁn ",), (None,)], "t string")
    assert [r[0] for r in x.select(T.clean_post("t")).collect()] == ["RT hi USER see URL Größe \U0001F600 fin", ""]
    assert x.select(T.clean_post("t", retweet=True, emoji=True, style="angle")).first()[0] == "hi <USER> see <URL> Größe fin"


def test_links_and_ids(spark):
    x = spark.createDataFrame([(" Q5 ", 7, "n"), ("none", 7, "n"), (" ", None, "n"), (None, -1, "n"), ("NIL", None, None)], "d string, w int, n string")
    assert [r[0] for r in x.select(T.kb_id("d", "w", "n")).collect()] == ["wd:Q5", "wiki:7", None, None, "wd:NIL"]
    assert [r[0] for r in x.select(T.kb_id("d", None, "n")).collect()] == ["wd:Q5", "wiki:n", "wiki:n", "wiki:n", "wd:NIL"]
    ids = spark.createDataFrame([("a_b_candidate",), ("a_humman_summary",), ("a_summary",)], "x string").select(T.split_id("x").alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in ids] == [("a_b", "candidate"), ("a", "human"), None]


def test_studentised_range():
    # published critical values of the five per cent level: (groups, degrees of freedom)
    for k, v, q in ((3, 20, 3.578), (2, 10, 3.151), (5, 30, 4.102), (4, 60, 3.737)):
        assert E._range_tail(q, k, v) == pytest.approx(0.05, abs=4e-4)


def test_ranks_over_ranges(spark):
    values = [float(k * 37 % 50) for k in range(400)] + [7.0] * 100
    d = spark.createDataFrame([(v,) for v in values], "x double")
    want = {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values}
    assert all(r["r"] == want[r["x"]] for r in E.ranked(d, "x", "r").collect())


def test_tables_of_a_step_go_with_it(spark, tmp_path):
    from tessera.sources import tables

    seen = []

    def make():
        seen.append(tables.settle(spark.range(3), "inner"))
        return seen[0].selectExpr("id + 1 as id")

    before = len(tables._written)
    out = tables.settled(make, "outer")
    assert sorted(r[0] for r in out.collect()) == [1, 2, 3] and len(tables._written) == before + 1
    with pytest.raises(Exception):
        spark.read.parquet(seen[0].inputFiles()[0]).count()
    with tables.scratch():
        tables.settle(spark.range(2))
    assert len(tables._written) == before + 1


def test_few_splits_are_dealt_out(spark):
    from tessera.sources.tables import dealt

    assert dealt(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert dealt(wide) is wide


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_pearson_gathers_no_key_in_one_task(spark, keys):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = 0.3 * x + rng.normal(size=400)
    d = spark.createDataFrame([("a", float(a + 1e8), float(b - 1e7)) for a, b in zip(x, y)], "k string, x double, y double")
    r = E.pearson(d, "x", "y", keys)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert r.first()["coefficient"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)
    m = d.select("k", F.lit(1.0).alias("t"), F.create_map(F.lit("m"), "x").alias("m"))
    assert tuple(E.metric_matrix(m, "m", "t", "k").first()) == ("a", "m", 400, None, "undefined_constant_input")
