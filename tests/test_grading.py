"""Literal cases of grading, records, safety, reports, comparison, routes, joins and token recursions."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import grading as G
from millrace.functions import records as R
from millrace.operators import advantage, batch, compare, components, custom, joins, reports


def values(spark, make, *rows, names="a b c"):
    """make(columns...) for literal rows, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names.split()[: len(rows[0])]))
    cols = [F.col(n) for n in names.split()[: len(rows[0])]]
    return [r.v for r in df.select("i", make(*cols).alias("v")).orderBy("i").collect()]


def test_boxes_of_any_depth(spark):
    texts = ["\\boxed{4}", "a \\boxed{\\frac{1}{\\sqrt{2}}} b \\boxed{{{{x}}}}", "\\boxed{1", "none", "\\boxed{" + "y" * 50_000 + "}", None]
    got = values(spark, A.boxed_all, *[(t,) for t in texts])
    assert got == [["4"], ["\\frac{1}{\\sqrt{2}}", "{{{x}}}"], [], [], ["y" * 50_000], None]


def test_latex_plain(spark):
    cases = {
        "\\frac12": "\\frac{1}{2}", "\\dfrac{3}{4}": "\\frac{3}{4}", "\\sqrt3": "\\sqrt{3}", "0.5": "\\frac{1}{2}", ".5": "\\frac{1}{2}", "x=7": "7", "\\left( 3,4 \\right)": "(3,4)", "50\\%": "50", "\\$12": "12",
        "5\\text{ cm}": "5", "5\\text{ cm}\\text{ x}": "5\\text{cm}\\text{x}", "90^\\circ": "90", "90^{\\circ}": "90", "3/4": "\\frac{3}{4}", "\\frac1{72}": "\\frac{1}{72}", "a\\!b\nc": "abc", "": "", "name=7": "name=7", "x" * 30_000: "x" * 30_000,
    }
    assert values(spark, A.latex_plain, *[(k,) for k in cases]) == list(cases.values())
    assert values(spark, A.latex_equal, ("\\frac12", "0.5"), ("1", "2"), (None, None), (None, "1")) == [True, False, True, False]


def test_final_form(spark):
    cases = {
        "x = 12,000": "12000", "$\\frac12$": "\\frac{1}{2}", "5 \\text{cm}": "5", "\\boxed{7}": "7", "12 dollars": "12", "\\sqrt2": "\\sqrt{2}", "90^\\circ": "90", "\\text{(A)}": "(A)", "the $x$ of it": "x", "1,2": "12", "": "",
    }
    assert values(spark, G.final_form, *[(k,) for k in cases]) == list(cases.values())
    assert values(spark, lambda t, g: G.final_line_score(t, g)["score"], ("So.\nAnswer: 12,000", "12000"), ("Answer: 3\nanswer : 4", "3"), ("nothing", "3"), (None, "3"), ("Answer: 3", None)) == [1.0, -1.0, -1.0, -1.0, -1.0]
    assert values(spark, lambda t, g: G.strict_box_score(t, g)["score"], ("\\boxed{3}", "3"), ("\\boxed{3}" + " x" * 60, "3"), (None, "3")) == [1, -1, -1]


def test_math_equal(spark):
    cases = [
        ("1,000", "1000", True), ("0.5", "50", True), ("50%", "0.5", True), ("50\\%", "50", True), ("$12", "12", True), ("3.00001", "3", True), ("3.1", "3", False), ("(1, 2)", "(1.0,2)", True), ("(1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False),
        ("x + 1", "x+1", True), ("X", "x", True), ("{x}", "x", True), ("1, 2", "1,2.0", True), ("1,2,3", "1,2", False), ("", "1", False), (None, "1", False), ("1", None, False), ("1e3", "1000", True), ("-2", "2", False), ("[0,1)", "[0,1]", False),
    ]
    assert values(spark, G.math_equal, *[c[:2] for c in cases]) == [c[2] for c in cases]


def test_grade(spark):
    cases = [
        ("1/2", "\\frac{1}{2}", True), ("\\text{yes}", "yes", True), ("3.0", "3", True), ("3.5", "3", False), ("2/4", "1/2", False), ("(1,2)", "(1,2)", True), ("(1, 2)", "(1,2.0)", True), ("(1,2)", "(1,3)", False), ("", "1", False), (None, "1", False), ("1,234", "1234", True),
    ]
    assert values(spark, G.grade, *[c[:2] for c in cases]) == [c[2] for c in cases]
    assert values(spark, G.elements, ("(1, 2)",), ("1,234",), ("[(1),2]",), ("",), (None,)) == [["1", "2"], ["1234"], ["[(1),2]"], [], None]
    assert values(spark, G.fuzzy_match, ("The answer is 5.", "5"), ("b it is", "b"), ("0.3333333", "1/3"), ("x", "y"), ("", "")) == [True, True, True, False, False]
    assert values(spark, G.output_equal, ("1\n2 ", "1\n2"), (" 1 \n\n 2", "1\n2"), ("1 2", "1\n2"), ("12", "1 2"), (None, "1")) == [True, True, True, False, False]


def test_scores_by_source(spark):
    one = F.lit(1.0)
    assert values(spark, lambda s: G.score_by_source(s, {"x": one}, F.lit(-1.0)), ("x",), ("y",), (None,)) == [1.0, -1.0, -1.0]
    with pytest.raises(Exception, match="no scorer for y"):
        values(spark, lambda s: G.score_by_source(s, {"x": one}), ("y",))
    assert values(spark, lambda t: G.penalty(a=(t == "x", -0.5), b=(t != "z", -0.25)), ("x",), ("y",), ("z",)) == [-0.75, -0.25, 0.0]


def test_records(spark):
    good = json.dumps({"step_index": 2, "score": 0.5, "confidence": 0.9, "critique": "ok", "tool_check": True})
    texts = [f"a {good} b", good + '{"step_index": 1}', '{"step_index": 1, broken}', "none", None]
    got = values(spark, R.verification, *[(t,) for t in texts])
    assert got[0].step_index == 2 and got[0].tool_check is True and got[1:] == [None, None, None, None]
    assert values(spark, lambda t: R.verification_format(t)["is_valid"], *[(t,) for t in texts]) == [True, True, False, False, False]
    fix = '{"action": "PATCH", "target_step": 1, "new_content": "x"}'
    got = values(spark, R.repair, (fix,), ('{"action": "DROP"}',), (f'{fix} {{"action": "NO_CHANGE"}}',), (None,))
    assert [g and g.action for g in got] == ["PATCH", None, "NO_CHANGE", None]
    assert values(spark, lambda t: R.repair_format(t)["valid_action"], (fix,), ('{"action": "DROP"}',), ("x",)) == [True, False, False]
    calls = values(spark, R.tool_calls, ('x {"tool_name": "sql", "tool_input": "1"} {"tool_name": } y',), ("",))
    assert [c.tool_name for c in calls[0]] == ["sql"] and calls[1] == []
    tagged = 'x<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>y<tool_call>no</tool_call>'
    assert [(c.name, c.arguments) for c in values(spark, R.tagged_calls, (tagged,))[0]] == [("f", '{"a":1}')] and values(spark, R.untagged, (tagged,)) == ["xy"]
    steps = values(spark, R.steps_with_calls, ('<think> a </think>{"tool_name":"sql","tool_input":{"q":"1"}}<THINK>b</THINK> end',), ("no",))
    assert [(s.step_index, s.reasoning, len(s.calls)) for s in steps[0]] == [(1, "a", 1), (2, "b", 0)] and steps[1] == []
    assert tuple(values(spark, R.before_and_after, ("a<interpreter> 4 </interpreter>b",))[0]) == ("4", "b")


def test_safety(spark):
    assert values(spark, R.is_safe, ("import socket", "Python"), ("import socket", "go"), ("system(1)", "cpp"), ("x", "python")) == [False, True, False, True]
    assert values(spark, R.refused_commands, ("SUDO ls",), ("chmod  777 x",), ("ls",), (None,)) == [["sudo "], ["chmod  777"], [], []]


def test_reports(spark):
    t = reports.timing(spark.createDataFrame([("gen", 0.5), ("ref", 0.3), ("other", 1.0)], "stage string, seconds double"), 6, 12).collect()
    assert {r.stage: r.ms_per_token and round(r.ms_per_token, 6) for r in t} == {"gen": round(500 / 6, 6), "ref": round(300 / 12, 6), "other": None}
    x = spark.createDataFrame([(100,), (200,), (300,)], "n int")
    assert [reports.throughput(x, F.col("n"), 2.0, k).first().per_second_worker for k in (1, 2)] == [300.0, 150.0]
    assert reports.throughput(x.limit(0), F.col("n"), 2.0, 1).first().tokens == 0
    d = spark.createDataFrame([([1.0, 2.0], [0.5, 1.0], [1, 1]), ([3.0, 4.0], [1.5, 2.0], [1, 1])], "s array<double>, r array<double>, m array<int>")
    got = {r.name: (r.mean, r.most, r.least) for r in reports.batch_statistics(d, ["s", "values"], "m", ["s", "r"]).collect()}
    assert got == {"length": (2.0, 2.0, 2.0), "s": (2.5, 4.0, 1.0), "s_sum": (5.0, 7.0, 3.0), "r_sum": (2.5, 3.5, 1.5)}
    b = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "b int, kept int")
    assert [tuple(r) for r in reports.accumulate(b, "b", "kept", 5).orderBy("b").collect()] == [(1, 3, 3), (2, 4, 2)]
    with pytest.raises(Exception, match="fewer than 9"):
        reports.accumulate(b, "b", "kept", 9, most=2).collect()
    assert reports.ratio_of_sums(x.limit(0), F.col("n"), F.col("n")).first().rate == 0.0 and reports.mean_or_zero(x.limit(0), F.col("n")).first().mean == 0.0


def test_covariance_clip(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, *(rnd.normal(size=(3, 50)) * [[1.0], [1.0], [3.0]]).tolist(), [1] * 40 + [0] * 10) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, l array<double>, o array<double>, a array<double>, m array<int>")
    few = [tuple(r) for r in reports.covariance_clip(df, "id", "l", "o", "a", "m", ratio=0.01).collect()]
    assert len(few) == len(set(few)) == 8 and all(p < 40 for _, p in few)
    assert few and sorted(few) == sorted(tuple(r) for r in reports.covariance_clip(df.repartition(5), "id", "l", "o", "a", "m", ratio=0.01).collect())
    assert reports.covariance_clip(df, "id", "l", "o", "a", "m", low=100, high=200).count() == 0


def test_results_equal(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "x", 2.0), (3, None, 4.0)], "p int, q string, r double")
    assert compare.results_equal(a, a.select("r", "p", "q")) and not compare.results_equal(a, a.distinct()) and not compare.results_equal(a, a.drop("r"))
    assert compare.results_equal(a.limit(0), a.limit(0)) and not compare.results_equal(a, a.limit(0))
    swapped = spark.createDataFrame([(1, 2), (2, 1)], "p int, q int")  # columns with equal values, rows that differ under one order only
    assert compare.results_equal(swapped, spark.createDataFrame([(2, 1), (1, 2)], "x int, y int"))
    assert not compare.results_equal(swapped, spark.createDataFrame([(1, 1), (2, 2)], "x int, y int"))
    n = spark.createDataFrame([(1, "x"), (2, "y")], "at int, v string")
    assert compare.results_equal(n, n, ordered="at") and not compare.results_equal(n, spark.createDataFrame([(2, "x"), (1, "y")], "at int, v string"), ordered="at")


def test_routes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, r string")
    got = batch.routed(df, "r", "i", {"a": lambda d: d.select("i", F.lit("A").alias("v"))}, lambda d: d.select("i", F.lit("-").alias("v")))
    assert sorted(map(tuple, got.collect())) == [(1, "A"), (2, "-"), (3, "-")]
    with pytest.raises(Exception, match="no handler for"):
        batch.routed(df, "r", "i", {"a": lambda d: d.select("i")}).collect()


def test_spread_join(spark):
    a = spark.createDataFrame([("h", i) for i in range(5)] + [("c", 9), (None, 1)], "k string, salt int")
    b = spark.createDataFrame([("h", i) for i in range(100)] + [("c", 7), ("d", 8), (None, 2)], "k string, y int")
    got = sorted(map(tuple, joins.spread_join(a, b, ["k"], rows=10).select("k", "salt", "y").collect()))
    assert got == sorted([("h", i, j) for i in range(5) for j in range(100)] + [("c", 9, 7)])


def test_first_match_groups(spark):
    rows = [("u", 1, "no way"), ("u", 2, "4"), ("u", 3, "there is No answer"), ("u", 4, "4"), ("u", 5, None), ("u", 6, ""), ("v", 1, "x")]
    got = custom.first_match_groups(spark.createDataFrame(rows, "k string, i int, a string"), "k", "i", "a").collect()
    assert {(r.k, r.i): r.representative for r in got} == {("u", 1): "no way", ("u", 2): "4", ("u", 3): "no way", ("u", 4): "4", ("v", 1): "x"}


def test_components_stop_loudly(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components.connected_components(links).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        components.connected_components(links, max_rounds=1)


def gae_by_force(r, v, m, g, lam):
    a = nv = 0.0
    out = []
    for x, y, k in zip(reversed(r), reversed(v), reversed(m)):
        new = x + g * nv - y + g * lam * a
        a, nv = k * new + (1 - k) * a, k * y + (1 - k) * nv
        out.append(a)
    return out[::-1]


def test_recursions_against_loops(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=n).tolist(), rnd.normal(size=n).tolist(), rnd.integers(0, 2, n).tolist()) for i, n in enumerate([0, 1, 7, 300, 5, 2])]
    df = spark.createDataFrame(rows + [(9, None, [1.0], [1])], "i int, r array<double>, v array<double>, m array<int>")
    c = [F.col(x) for x in "rvm"]
    got = {r.i: (r.x, r.s) for r in df.select("i", advantage.gae_carry(*c, 0.9, 0.95).alias("x"), advantage.running_sum(F.col("m")).alias("s")).collect()}
    for i, r, v, m in rows:
        assert np.allclose(got[i][0], gae_by_force(r, v, m, 0.9, 0.95)) and got[i][1] == np.cumsum(m).tolist()
    assert got[9][0] is None
    # values where the mask is 0 have no part in the result
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    v1, v2 = rnd.normal(size=11), rnd.normal(size=11)
    v2 = np.where(mask, v1, v2)
    rew = rnd.normal(size=11)
    two = spark.createDataFrame([(0, rew.tolist(), v1.tolist(), mask), (1, (rew * np.array(mask)).tolist(), v2.tolist(), mask)], "i int, r array<double>, v array<double>, m array<int>")
    x = [np.array(r.x)[np.array(mask) == 1] for r in two.select("i", advantage.gae_carry(*c, 0.9, 0.95).alias("x")).orderBy("i").collect()]
    assert np.allclose(*x)
    holes = spark.createDataFrame([([1, None, 2],), (None,), ([],)], "m array<int>").select(advantage.running_sum(F.col("m")).alias("s")).collect()
    assert [r.s for r in holes] == [[1, None, None], None, []]


def test_recursions_are_linear(spark):
    def seconds(n):
        df = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x * 0.001).alias("r"))
        start = time.time()
        df.select(advantage.gae_carry(F.col("r"), F.col("r"), F.transform("r", lambda x: F.lit(1)), 0.9, 0.9).alias("x")).agg(F.sum(F.element_at("x", 1))).collect()
        return time.time() - start

    seconds(100)
    assert seconds(60_000) < 12 * max(seconds(6_000), 0.5)


def test_written_tables_have_an_owner(spark):
    from millrace.session import tables_folder, written

    df = written(spark.range(3), "owned")
    assert spark.sparkContext.applicationId in tables_folder(spark) and all(tables_folder(spark).split("://")[-1] in f for f in df.inputFiles())


def test_roll_up_by_ranks(spark):
    """Expectations of the best and worst of n draws against all draws with replacement."""
    from itertools import product

    from millrace.operators import metrics

    x = [0.1, 0.9, 0.4, 0.4, 0.7]
    df = spark.createDataFrame([("s", "p", v) for v in x] + [("s", "q", 0.5), ("s", "q", None), ("t", "r", 1.0)], "s string, p string, v double")
    got = {(r.s, r.metric): r.value for r in metrics.validation_rollup(df, "s", "p", "v").collect()}
    for k in (2, 4, 5):
        draws = list(product(x, repeat=k))
        assert abs(got["s", f"best@{k}"] - sum(map(max, draws)) / len(draws)) < 1e-9 and abs(got["s", f"worst@{k}"] - sum(map(min, draws)) / len(draws)) < 1e-9
    assert abs(got["s", "mean@5"] - sum(x) / 5) < 1e-9 and got["s", "mean@1"] == 0.5 and got["t", "mean@1"] == 1.0 and ("t", "std@1") not in got
    assert metrics.validation_rollup(df.limit(0), "s", "p", "v").count() == 0


def test_dataset_records(spark):
    from millrace.operators import dataset as D

    m = spark.sql("SELECT array(struct('user' AS role, 'a' AS content), struct('assistant' AS role, 'b' AS content), struct('user' AS role, '#### 4' AS content)) AS p, array() AS e, CAST(null AS array<struct<role:string,content:string>>) AS n")
    assert m.select(D.last_user_answer(F.col("p"))).first()[0] == "#### 4" and m.select(D.last_user_answer(F.col("n"))).first()[0] == "#### "
    t = values(spark, D.alternating, ("a<interpreter>4</interpreter> b<interpreter> </interpreter>",), ("",))
    assert [(x.role, x.content) for x in t[0]] == [("assistant", "a"), ("tool", "4"), ("assistant", "b")] and t[1] == []
    one = values(spark, lambda w: D.counted_letters(w, F.lit("b")), ("abb",))[0]
    assert one == "a != b.\nb = b.\nb = b.\n\\boxed{2} b in a-b-b."
    q = [values(spark, lambda a: D.with_choices(F.lit("Q"), a, F.array(F.lit("x"), F.lit("y")), a, s), ("right",))[0] for s in (1, 1, 2, 3, 4, 5)]
    assert q[0] == q[1] and len({x.letter for x in q}) > 1 and all(f"{x.letter}) right" in x.prompt for x in q)
    df = spark.createDataFrame([(1, "x")], "rid long, uid string")
    assert D.checked(df, df.schema, "rid").count() == 1
    with pytest.raises(ValueError, match="score"):
        D.checked(df, spark.createDataFrame([(1, 0.5)], "rid long, score double").schema, "rid")
    with pytest.raises(Exception, match="null rid"):
        D.checked(spark.createDataFrame([(None, "x")], "rid long, uid string"), df.schema, "rid").collect()
    c = spark.createDataFrame([([1, 2, 3], [4, 5, 6])], "p array<int>, r array<int>").select(D.composed(F.col("p"), F.col("r"), 5, 2, 0).alias("x")).first().x
    assert (c.ids, c["mask"], c.positions) == ([0, 0, 1, 2, 3, 4, 5], [0, 0, 1, 1, 1, 1, 1], [0, 0, 0, 1, 2, 3, 4])


def test_dense_search_ties(spark):
    from millrace.operators import retrieval

    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0]), (10, None), (11, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = retrieval.dense_topk(df.where("vec_id = 3"), df, 4).orderBy("rank").collect()
    assert [(r.rank, r.key) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert retrieval.dense_topk(df.where("vec_id = 3"), df, 0).count() == 0 and retrieval.dense_topk(df.limit(0), df, 3).count() == 0
