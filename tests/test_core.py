"""Literal cases of the core operators."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import arrays as X
from millrace.operators import advantage, batch, components, custom, metrics, nested
from millrace.operators.delivery import latest_delivery


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# ---- nested records


def nodes(spark, records, extra=None):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "trajectory_id long, record string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in extra})
    n = nested.trajectory_nodes(df, ["trajectory_id"])
    return {tuple(r) for r in nested.trajectory_links(n).collect()}


def test_nested_layouts(spark):
    one = {"steps": {"step_index": "4", "tool_calls": {"tool_name": "a", "tool_input": '{"k": 1, "l": 2}'}, "tool_outputs": {"result": "r", "processed_images": "p.png"}, "repair": {"action": "PATCH"}}}
    two = {"version": 2, "trajectory": {"steps": [None, {"step_index": 7, "tool_calls": [None, {"tool_name": "b", "tool_input": "raw words"}], "tool_outputs": [{"processed_images": ["a", None, "a"]}]}], "verifications": [{"step_index": "7"}, {"step_index": 99}]}}
    got = nodes(spark, [json.dumps(one), json.dumps(two)])
    assert {(0, "step", 0, 0, ""), (0, "tool_call", 0, 0, ""), (0, "tool_arg", 0, 0, "k"), (0, "tool_arg", 0, 0, "l"), (0, "tool_output", 0, 0, ""), (0, "processed_image", 0, 0, "0"), (0, "repair", 0, 0, "")} == {g for g in got if g[0] == 0}
    assert {(1, "step", 1, 0, ""), (1, "tool_call", 1, 1, ""), (1, "tool_arg", 1, 1, "_raw"), (1, "tool_output", 1, 0, ""), (1, "processed_image", 1, 0, "0"), (1, "processed_image", 1, 0, "2"), (1, "verification", 1, 0, ""), (1, "verification", -1, 0, "")} == {g for g in got if g[0] == 1}


def test_nested_bad_and_empty(spark):
    got = nodes(spark, [None, "", "{", "[]", "5", '{"steps": []}', '{"steps": [{}]}', '{"a": NaN}', '{"steps": "text"}'], extra=["table", "place"])
    assert got == {(1, "unreadable", -1, 0, ""), (2, "unreadable", -1, 0, ""), (7, "unreadable", -1, 0, ""), (8, "step", 0, 0, "")}
    assert nodes(spark, []) == set()


def test_nested_very_long(spark):
    steps = [{"step_index": i, "content": "x" * 100, "tool_calls": [{"tool_name": "t", "tool_input": {"a": i}}]} for i in range(3_000)]
    assert len(nodes(spark, [json.dumps({"steps": steps})])) == 9_000


def test_shred_round_trip():
    """The tables rebuilt from the levels hold exactly what random records held."""
    rnd = random.Random(5)
    schema = nested.Group({"a": nested.Repeated(nested.Group({"x": nested.Leaf(), "b": nested.Repeated(nested.Group({"y": nested.Leaf(), "c": nested.Repeated(nested.Leaf())}))}))})
    records = [{"a": [None if rnd.random() < 0.2 else {"x": i, "b": [{"y": j, "c": [rnd.choice([None, "v"]) for _ in range(rnd.randrange(3))]} for j in range(rnd.randrange(4))]} for i in range(rnd.randrange(4))]} for _ in range(200)]
    cols = nested.shred(records, schema)
    want = [(r, (i, j, k)) for r, rec in enumerate(records) for i, a in enumerate(rec["a"]) if a for j, b in enumerate(a["b"]) for k, c in enumerate(b["c"]) if c]
    assert [(r, pl) for r, pl, _ in nested.rebuild(cols, "a[].b[].c[]")] == want
    assert [(r, pl, f["y"]) for r, pl, f in nested.rebuild(cols, "a[].b[]")] == [(r, (i, j), str(b["y"])) for r, rec in enumerate(records) for i, a in enumerate(rec["a"]) if a for j, b in enumerate(a["b"])]


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 1, "c"), (None, 1, "d"), (None, 2, "e"), (3, None, "f")], "k int, t int, hash string")
    got = sorted((r.k or 0, r.hash) for r in latest_delivery(df, "k", "t").collect())
    assert got == [(0, "d"), (0, "e"), (1, "b"), (2, "c"), (3, "f")]
    assert latest_delivery(df.limit(0), "k", "t").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- batches


def test_reorder_chunk_pad(spark):
    df = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate("abcdef")], "pos long, obs int, label string")
    ix = spark.createDataFrame([(i, x) for i, x in enumerate([3, 4, 2, 0, 1, 5])], "at long, idx long")
    got = [(r.obs, r.label) for r in batch.gather(df, ix).orderBy("at").collect()]
    assert got == [(4, "d"), (5, "e"), (3, "c"), (1, "a"), (2, "b"), (6, "f")]
    assert [r.p for r in df.select(batch.chunk_of(F.col("pos"), 6, 2).alias("p")).collect()] == [0, 0, 0, 1, 1, 1]
    padded = batch.pad_to_divisor(df, 4, 6)
    assert padded.count() == 8 and batch.unpad(padded, 8, 2).count() == 6
    assert [r.obs for r in batch.pad_to_divisor(df.where("pos < 2"), 7, 2).orderBy("pos").collect()] == [1, 2, 1, 2, 1, 2, 1]


def test_side_by_side_conflict(spark):
    a = spark.createDataFrame([(1, float("nan"), "x"), (2, None, "y")], "rid int, v double, s string")
    assert batch.side_by_side(a, a.select("rid", "v")).count() == 2
    with pytest.raises(Exception, match="differs"):
        batch.side_by_side(a, a.select("rid", F.lit(1.0).alias("v"))).collect()


def test_fold_round_trip(spark):
    df = spark.range(23).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    assert sorted(r.v for r in batch.unfold_rows(batch.fold_rows(df, 5, ["v"]), ["v"]).collect()) == [2 * i for i in range(23)]


def test_bags(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert batch.bags_equal(a, a.orderBy("a")) and not batch.bags_equal(a, a.distinct())


# ---- metrics and advantages


def test_majority_tie_goes_to_first(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "B", 0.7), (1, 3, "A", 0.6)], "k int, pos int, p string, v double")
    assert metrics.majority(df, ["k"], "p", "v", "pos").first().first_value == 0.9


def test_reduce_by_name(spark):
    f = lambda xs, n: value(spark, batch.reduce_by_name(F.array(*map(F.lit, xs)).cast("array<double>"), F.lit(n)))
    assert f([1.0, 2.0, 3.0], "loss") == 2.0 and f([1.0, 5.0], "x/max") == 5.0 and f([1.0, 5.0], "x/min") == 1.0 and math.isnan(f([], "loss"))


def test_validation_rollup(spark):
    df = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)], "s string, p string, v double")
    got = {(r.s, r.metric): r.value for r in metrics.validation_rollup(df, "s", "p", "v").collect()}
    assert got["s1", "mean@2"] == pytest.approx(0.85) and got["s2", "mean@1"] == 0.7 and got["s1", "best@2"] == pytest.approx(0.875)


def test_grpo_and_rloo(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 0.5), ("b", 0.7), (None, 0.2)], "uid string, score double")
    g = advantage.grpo(df).collect()
    assert sum(r.advantage for r in g if r.uid == "a") == pytest.approx(0, abs=1e-9)
    assert [r.advantage for r in g if r.uid == "b"] == [pytest.approx(0.7 / (1 + 1e-6))]
    assert sum(r.advantage for r in advantage.rloo(df).collect() if r.uid == "a") == pytest.approx(0, abs=1e-9)
    assert len(g) == 5
    with pytest.raises(ValueError):
        advantage.estimator("grpo")(lambda d: d)


def test_gae_ignores_masked_values(spark):
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rnd = random.Random(1)
    r = [rnd.random() for _ in mask]
    v1 = [rnd.random() for _ in mask]
    v2 = [x if m else rnd.random() for x, m in zip(v1, mask)]
    r = [x if m else 0.0 for x, m in zip(r, mask)]
    lit = lambda xs: F.array(*map(F.lit, xs))
    a, b = (value(spark, advantage.gae_carry(lit(r), lit(v), lit(mask), 0.9, 0.95)) for v in (v1, v2))
    assert [x for x, m in zip(a, mask) if m] == pytest.approx([x for x, m in zip(b, mask) if m])


def test_masks(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    assert value(spark, advantage.response_mask(lit([5, 2, 3, 2]), 2)) == [1, 1, 0, 0]
    assert value(spark, advantage.response_mask_before(lit([5, 2, 3, 2]), 2)) == [1, 0, 0, 0]
    assert value(spark, advantage.position_ids(lit([0, 0, 1, 1]))) == [0, 0, 0, 1]
    assert value(spark, advantage.n_actions(lit([1, 1, 0, 1]))) == 2
    assert value(spark, advantage.run_discount(lit([1, 0, 1, 1]), F.lit(1.0), 0.5)) == [0.5, 0.0, 1.0, 1.0]


# ---- text


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (A.boxed_last, r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (A.boxed_last, "none", None), (A.hash_answer, "x #### 1,234", "1234"), (A.hash_answer, "x", None),
        (A.number_flexible, "a 3 b . ", "3"), (A.plain_answer, "The  Cat, an A.", "cat"), (A.latex_plain, r"\dfrac12", r"\frac{1}{2}"), (A.latex_plain, "0.5", r"\frac{1}{2}"),
        (A.latex_plain, "x=3", "3"), (A.latex_plain, "3/4", r"\frac{3}{4}"), (A.answer_key, r"The answer is: $5$.", ": 5"), (A.choice_letter, "Answer: $b", "B"), (A.number_in, "50%", 0.5),
        (A.number_in, "3/4", 0.75), (A.number_in, "about 2.5e3", 2500.0), (A.sql_text, "```sql\nselect 1 > = 0\n```", "select 1 >= 0"), (A.final_answer, "FINAL_ANSWER: 7\nx", "7"), (A.answer_line, "no", "[INVALID]"),
    ],
)
def test_text(spark, make, text, want):
    assert value(spark, make(F.lit(text))) == want


def test_arrays(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    assert value(spark, X.pad_or_cut(lit([1, 2, 3, 4, 5]), 4, 0, cut="middle")) == [1, 2, 4, 5]
    assert value(spark, X.pad(lit([1]), 3, 0, left=True)) == [0, 0, 1]
    assert value(spark, X.move_padding(lit([1, 0, 2]), 0)) == [0, 1, 2]
    assert value(spark, X.entropy(lit([0.0, 0.0]))) == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        X.kl(F.lit(1.0), F.lit(1.0), "full")


# ---- sequential operators


def test_balanced_parts_inverse():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 300) for _ in range(40)]
    for parts in (custom.karmarkar_karp(sizes, 4), custom.karmarkar_karp(sizes, 4, equal=True), custom.greedy_parts(sizes, 4)):
        assert sorted(i for p in parts for i in p) == list(range(40))
    sums = [sum(sizes[i] for i in p) for p in custom.karmarkar_karp(sizes, 4)]
    assert max(sums) - min(sums) < 20
    assert {len(p) for p in custom.karmarkar_karp(sizes, 4, equal=True)} == {10}


def test_repetition_brute_force():
    for t in ("", "a", "abab", "aaaaaa", "abcabcabcx", "zażółć"):
        suffixes = sorted(t[i:] for i in range(len(t)))
        total = sum(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:]))
        assert custom.repetition(t) == pytest.approx(2 * total / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0)


def test_bleu_and_clusters(spark):
    assert custom.sentence_bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "x y z w v u"])], "b int, rid int, t string")
    assert sorted(r.share for r in custom.cluster_shares(df, "b", "rid", "t").collect()) == pytest.approx([1 / 3, 2 / 3, 2 / 3])


def test_registered_without_llm():
    """The core imports nothing from the subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['millrace.llm'] = None\nimport millrace.catalog as c; assert len(c.queries()) > 100"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1])).returncode == 0


def test_sequential_queries_cover_whole_tables(spark, sf):
    from millrace import catalog

    q = catalog.queries()
    texts = {r.rollout_id: r.responses for r in spark.read.parquet(f"{sf}/rollouts.parquet").where("rollout_id is not null").collect()}
    got = {r.rollout_id: r.value for r in q["custom_repetition"](spark, sf).collect()}
    assert set(got) == set(texts) and all(got[i] == pytest.approx(custom.repetition(x) if x else 0.0) for i, x in texts.items())
    uids = {r.uid for r in spark.read.parquet(f"{sf}/rl_records.parquet").where("uid is not null and extra_info.question is not null").collect()}
    shares = q["custom_cluster_shares"](spark, sf).collect()
    assert sorted(r.uid for r in shares) == sorted(uids)
    assert q["scan_normalised_all"](spark, sf).count() == spark.read.parquet(f"{sf}/eval_items.parquet").where("question <> ''").count() > 100


def test_first_deliveries_in_files(spark, tmp_path):
    """The rows of the stream do not go to the driver, and a key is an event with its type, as in the SQL; the table may be a folder of files."""
    import duckdb

    from millrace import catalog

    rows = [(i, f"2024-01-{d:02} 00:00:00", i % 7, k) for i in range(300) for d, k in [(1, "a"), (20, "a"), (20, "b")][: 1 + i % 3]]
    ev = spark.createDataFrame([*rows, (None, None, 1, "a"), (5, None, 1, None)], "event_id long, ts string, user_id long, event_type string")
    ev = ev.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    ev.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["stream_first_deliveries"](spark, str(tmp_path))
    assert got.inputFiles()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(c.execute(catalog.sql()["stream_first_deliveries"]).fetchall(), key=repr)


def test_opo_empty_responses(spark):
    """A group of empty responses has no weighted mean (NaN, as 0 / 0 in the SQL); alone in its group a response keeps its score."""
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 0.0, 1), ("b", 0.7, 0), ("c", 0.5, 0), ("c", 0.2, 0), ("d", 0.4, 0), ("d", 0.9, 2)], "uid string, score double, length int")
    got = sorted((r.uid, r.score, r.advantage) for r in advantage.opo(df).collect())
    assert [a for u, _, a in got if u != "c"] == pytest.approx([-0.75, 0.25, 0.7, -0.5, 0.0])
    assert [math.isnan(a) for u, _, a in got if u == "c"] == [True, True]
