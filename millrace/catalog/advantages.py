"""Queries of the advantage estimators and mask functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog.base import Book, r9, read
from millrace.operators import advantage as A

book = Book(globals(), r="r", v="v", m="m", ids="ids")

#: One row for each scored response.
BASE = "WITH b AS (SELECT DISTINCT rollout_id AS rid, uid, data_source, score, step, length(responses) AS length, length(prompts) % 5 AS n_actions FROM rollouts WHERE uid IS NOT NULL AND score IS NOT NULL AND responses IS NOT NULL)"
STATS = ", g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS std, stddev_pop(score) OVER w AS sdp, sum(score) OVER w AS total FROM b WINDOW w AS (PARTITION BY uid))"


def base(spark, sf) -> DataFrame:
    r = read(spark, sf, "rollouts").where("uid IS NOT NULL AND score IS NOT NULL AND responses IS NOT NULL")
    return r.select(
        F.col("rollout_id").alias("rid"), "uid", "data_source", "score", "step", F.length("responses").alias("length"), (F.length("prompts") % 5).alias("n_actions")
    ).distinct()


def est(name: str, run, sql: str) -> None:
    book.add(f"adv_{name}", lambda spark, sf: run(base(spark, sf)).select("rid", r9(F.col("advantage")).alias("advantage")), f"{BASE}{STATS} {sql}")


def sel(expr: str, frm: str = "g") -> str:
    return f"SELECT rid, round({expr}, 9) + 0.0 AS advantage FROM {frm}"


_GRPO = "CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (std + 1e-6) END"
est("grpo", A.grpo, sel(_GRPO))
est("grpo_no_std", A.grpo_no_std, sel("CASE WHEN n = 1 THEN score ELSE score - mean END"))
est("grpo_groups_only", A.grpo_groups_only, sel("CASE WHEN n > 1 THEN (score - mean) / (std + 1e-6) END"))
est("grpo_passk", A.grpo_passk, """, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid) AS r, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, rid) AS nxt FROM g) """ + sel("CASE WHEN n > 1 THEN CASE WHEN r = 1 THEN (score - nxt) / (std + 1e-6) ELSE 0.0 END END", "k"))
est("rloo", A.rloo, sel("CASE WHEN n > 1 THEN (score - mean) * n / (n - 1) ELSE score END"))
est("opo", A.opo, ", o AS (SELECT *, sum(score * length) OVER (PARTITION BY uid) / sum(length) OVER (PARTITION BY uid) AS base FROM g) " + sel("score - CASE WHEN n = 1 THEN 0.0 ELSE base END", "o"))
est("gpg", A.gpg, ", t AS (SELECT count(score) / greatest(count(*) FILTER (WHERE score <> 0), 1) AS alpha FROM b) " + sel("alpha * (score - CASE WHEN n = 1 THEN 0.0 ELSE mean END)", "g, t"))
est("reinforce_baseline", A.reinforce_baseline, ", d AS (SELECT *, score - CASE WHEN n = 1 THEN 0.0 ELSE mean END AS a FROM g), t AS (SELECT sum(length) AS c, sum(length * a) AS s1, sum(length * a * a) AS s2 FROM d) " + sel("(a - s1 / c) / sqrt((s2 - c * (s1 / c) * (s1 / c)) / (c - 1) + 1e-8)", "d, t"))
est("gapo", A.gapo, ", t AS (SELECT *, CAST(sum(n_actions) OVER w AS DOUBLE) AS c, sum(n_actions * score) OVER w AS s1, sum(n_actions * score * score) OVER w AS s2 FROM b WINDOW w AS (PARTITION BY uid)) " + sel("CASE WHEN c > 1 THEN (score - s1 / c) / (sqrt(greatest((s2 - c * (s1 / c) * (s1 / c)) / (c - 1), 0.0)) + 1e-6) WHEN c = 1 THEN score / (1 + 1e-6) ELSE score END", "t"))
est("adpo", lambda b: A.adpo(b.withColumn("difficulty", F.col("score"))), sel(f"({_GRPO}) * (0.5 + least(1.0, greatest(0.0, (score - 0.3) / 0.5)) * 0.5)"))
est("process_grpo", lambda b: A.process_grpo(b.withColumn("total_return", F.col("score"))), sel("(score - CASE WHEN n = 1 THEN 0.0 ELSE mean END) / CASE WHEN n = 1 OR sdp < 1e-6 THEN 1.0 ELSE sdp END"))
book.add(
    "adv_group_stats",
    lambda spark, sf: A.group_stats(base(spark, sf), "uid", "score").select("uid", "n", *[r9(F.col(c)).alias(c) for c in ("mean", "std", "std_pop", "total")]),
    BASE + " SELECT uid, count(*) AS n, round(avg(score), 9) + 0.0 AS mean, round(stddev_samp(score), 9) + 0.0 AS std, round(stddev_pop(score), 9) + 0.0 AS std_pop, round(sum(score), 9) + 0.0 AS total FROM b GROUP BY uid",
)
book.add(
    "adv_whiten",
    lambda spark, sf: A.whiten(base(spark, sf), "score").select("rid", r9(F.col("whitened")).alias("whitened")),
    BASE + ", t AS (SELECT avg(score) AS m, var_samp(score) AS v FROM b) SELECT rid, round((score - m) / sqrt(v + 1e-8), 9) + 0.0 AS whitened FROM b, t",
)
book.add(
    "adv_whiten_masked_keep_mean",
    lambda spark, sf: A.whiten(base(spark, sf).withColumn("m", (F.col("rid") % 2).cast("int")), "score", "m", shift_mean=False).select("rid", r9(F.col("whitened")).alias("whitened")),
    BASE + ", t AS (SELECT avg(score) AS m, var_samp(score) AS v FROM b WHERE rid % 2 = 1) SELECT rid, round((score - m) / sqrt(v + 1e-8) + m, 9) + 0.0 AS whitened FROM b, t",
)
# ---- preference of adjacent pairs
book.add(
    "adv_pair_preference",
    lambda spark, sf: _pairs(base(spark, sf)),
    BASE + ", p AS (SELECT rid, score, row_number() OVER (ORDER BY rid) - 1 AS i FROM b) SELECT rid, row_number() OVER (PARTITION BY i // 2 ORDER BY score DESC, i) = 1 AS preferred FROM p",
)


def _pairs(b: DataFrame) -> DataFrame:
    from millrace.operators.batch import positions
    from millrace.operators.dataset import pair_preference

    return pair_preference(positions(b, "rid"), "pos", "score").select("rid", "preferred")


# ---- token recursions over the sequences table: tokens give rewards and values, the attention mask the mask
TOK = """WITH s AS (SELECT DISTINCT seq_id, input_ids AS ids, attention_mask AS m, list_transform(input_ids, lambda x: (x % 11) / 10.0) AS r, list_transform(input_ids, lambda x: (x % 7) / 10.0) AS v
 FROM sequences WHERE attention_mask IS NOT NULL AND len(input_ids) > 0)"""


def tokens(spark, sf) -> DataFrame:
    s = read(spark, sf, "sequences").where("attention_mask IS NOT NULL AND size(input_ids) > 0").select("seq_id", F.col("input_ids").alias("ids"), F.col("attention_mask").alias("m")).distinct()
    return s.withColumn("r", F.transform("ids", lambda x: (x % 11) / 10.0)).withColumn("v", F.transform("ids", lambda x: (x % 7) / 10.0))


def _digest(c, sf=None):
    """First, last and sum of an array: enough to tell two arrays apart in a comparison."""
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return [F.size(c).cast("long").alias("n"), r9(F.try_element_at(c, F.lit(1)).cast("double")).alias("first"), r9(F.try_element_at(c, F.lit(-1)).cast("double")).alias("last"), F.round(total, 4).alias("total")]


def _dsql(expr: str, frm: str = "x") -> str:
    return f"SELECT seq_id, len({expr}) AS n, round(CAST({expr}[1] AS DOUBLE), 9) + 0.0 AS first, round(CAST({expr}[-1] AS DOUBLE), 9) + 0.0 AS last, round(CAST(list_sum({expr}) AS DOUBLE), 4) AS total FROM {frm}"


def tok(name: str, make, sql: str) -> None:
    book.add(f"tok_{name}", lambda spark, sf: tokens(spark, sf).select("seq_id", make().cast("array<double>").alias("z")).select("seq_id", *_digest(F.col("z"))), f"{TOK}, {sql}")


#: Window forms of the recursions on exploded tokens.
EXP = "e AS (SELECT seq_id, unnest(r) AS r, unnest(v) AS v, unnest(m) AS m, unnest(ids) AS id, unnest(range(len(r))) AS t FROM s)"
tok("reverse_cumsum", lambda: A.reverse_cumsum(r), EXP + ", w AS (SELECT seq_id, t, sum(r) OVER (PARTITION BY seq_id ORDER BY t DESC) AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
tok("remax", lambda: A.remax(r, F.lit(0.5), m), EXP + ", w AS (SELECT seq_id, t, (sum(r * m) OVER (PARTITION BY seq_id ORDER BY t DESC) - 0.5) * m AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
tok("remax_scalar", lambda: A.remax_scalar(r, F.lit(0.5), m), "x AS (SELECT seq_id, list_transform(m, lambda q: (list_sum(r) - 0.5) * q) AS y FROM s) " + _dsql("y"))
tok("response_mask", lambda: A.response_mask(F.transform(ids, lambda x: x % 50), 2), EXP + ", w AS (SELECT seq_id, t, CAST(sum(CAST(id % 50 = 2 AS INT)) OVER (PARTITION BY seq_id ORDER BY t) - CAST(id % 50 = 2 AS INT) = 0 AS INT) AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
tok("response_mask_before", lambda: A.response_mask_before(F.transform(ids, lambda x: x % 50), 2), EXP + ", w AS (SELECT seq_id, t, CAST(sum(CAST(id % 50 = 2 AS INT)) OVER (PARTITION BY seq_id ORDER BY t) = 0 AS INT) AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
tok("position_ids", lambda: A.position_ids(m), EXP + ", w AS (SELECT seq_id, t, greatest(sum(m) OVER (PARTITION BY seq_id ORDER BY t) - 1, 0) AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
tok("position_ids_masked", lambda: A.position_ids_masked(m), EXP + ", w AS (SELECT seq_id, t, (sum(m) OVER (PARTITION BY seq_id ORDER BY t) - 1) * m AS y FROM e), x AS (SELECT seq_id, list(y ORDER BY t) AS y FROM w GROUP BY seq_id) " + _dsql("y"))
bits = "list_transform(ids, lambda q: CAST(q % 3 = 0 AS INT))"
tok("run_ends", lambda: A.run_ends(F.transform(ids, lambda x: (x % 3 == 0).cast("int"))), f"z AS (SELECT seq_id, {bits} AS k FROM s), e AS (SELECT seq_id, unnest(k) AS k, unnest(range(len(k))) AS t FROM z), w AS (SELECT seq_id, t, k, lead(k, 1, 0) OVER (PARTITION BY seq_id ORDER BY t) AS nx FROM e), x AS (SELECT z.seq_id, coalesce(list(t ORDER BY t) FILTER (WHERE w.k = 1 AND nx = 0), []) AS y FROM z LEFT JOIN w ON z.seq_id = w.seq_id GROUP BY z.seq_id) SELECT seq_id, len(y) AS n, round(CAST(y[1] AS DOUBLE), 9) + 0.0 AS first, round(CAST(y[-1] AS DOUBLE), 9) + 0.0 AS last, round(coalesce(CAST(list_sum(y) AS DOUBLE), 0.0), 4) AS total FROM x")
RUNS = f"z AS (SELECT seq_id, {bits} AS k FROM s), e AS (SELECT seq_id, unnest(k) AS k, unnest(range(len(k))) AS t FROM z), w AS (SELECT seq_id, t, k, CAST(k = 1 AND lag(k, 1, 0) OVER (PARTITION BY seq_id ORDER BY t) = 0 AS INT) AS st FROM e), u AS (SELECT seq_id, t, k, sum(st) OVER (PARTITION BY seq_id ORDER BY t) AS run, sum(st) OVER (PARTITION BY seq_id) AS runs FROM w)"
tok("run_discount", lambda: A.run_discount(F.transform(ids, lambda x: (x % 3 == 0).cast("int")), F.lit(2.0), 0.9), RUNS + ", x AS (SELECT seq_id, list(CASE WHEN k = 1 THEN 2.0 * power(0.9, runs - run) ELSE 0.0 END ORDER BY t) AS y FROM u GROUP BY seq_id) " + _dsql("y"))
book.add("tok_n_actions", lambda spark, sf: tokens(spark, sf).select("seq_id", A.n_actions(F.transform("ids", lambda x: (x % 3 == 0).cast("int"))).alias("n")), f"{TOK}, {RUNS} SELECT seq_id, CAST(max(runs) AS BIGINT) AS n FROM u GROUP BY seq_id")


def fold(name: str, make, init: str, step: str, pick: str, arrays: str) -> None:
    """A backward recursion in SQL: list_reduce over reversed structs, the state keeps the running total of what comes out."""
    book.add(
        f"tok_{name}",
        lambda spark, sf: tokens(spark, sf).select("seq_id", make().alias("z")).select("seq_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), r9(F.element_at("z", 1)).alias("first")),
        f"""{TOK}, z AS (SELECT seq_id, list_prepend({init}, list_reverse({arrays})) AS q FROM s),
        y AS (SELECT seq_id, list_reduce(q, lambda s, x: {step}) AS st FROM z) SELECT seq_id, round(st.tot, 4) AS total, round(st.{pick}, 9) + 0.0 AS first FROM y""",
    )


Z = "list_transform(range(1, len(r) + 1), lambda i: {{'r': CAST(r[i] AS DOUBLE), 'v': CAST(v[i] AS DOUBLE), 'm': CAST(m[i] AS DOUBLE), 'a': 0.0::DOUBLE, 'tot': 0.0::DOUBLE}})".replace("{{", "{").replace("}}", "}")
I0 = "{'r': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'm': 1.0::DOUBLE, 'a': 0.0::DOUBLE, 'tot': 0.0::DOUBLE}"
fold("gae_plain", lambda: A.gae_plain(r, v, 0.9, 0.95), I0, "{'r': x.r, 'v': x.v, 'm': x.m, 'a': x.r + 0.9 * s.v - x.v + 0.9 * 0.95 * s.a, 'tot': s.tot + x.r + 0.9 * s.v - x.v + 0.9 * 0.95 * s.a}", "a", Z)
fold("gae_carry", lambda: A.gae_carry(r, v, m, 0.9, 0.95), I0, "{'r': x.r, 'v': x.m * x.v + (1 - x.m) * s.v, 'm': x.m, 'a': x.m * (x.r + 0.9 * s.v - x.v + 0.9 * 0.95 * s.a) + (1 - x.m) * s.a, 'tot': s.tot + x.m * (x.r + 0.9 * s.v - x.v + 0.9 * 0.95 * s.a) + (1 - x.m) * s.a}", "a", Z)
fold("gae_turns", lambda: A.gae_turns(r, v, m, 0.9, 0.95), I0, "{'r': x.r, 'v': x.v, 'm': x.m, 'a': x.r + 0.9 * s.v * s.m - x.v + 0.9 * 0.95 * s.a * s.m, 'tot': s.tot + x.r + 0.9 * s.v * s.m - x.v + 0.9 * 0.95 * s.a * s.m}", "a", Z)
fold("discounted_returns", lambda: A.discounted_returns(r, m, 0.9), I0, "{'r': x.r + 0.9 * s.a, 'v': x.v, 'm': x.m, 'a': (x.r + 0.9 * s.a) * x.m, 'tot': s.tot + x.r + 0.9 * s.a}", "r", Z)
fold("masked_returns", lambda: A.masked_returns(r, m, 0.9), I0, "{'r': x.r, 'v': x.v, 'm': x.m, 'a': (x.r + 0.9 * s.a) * x.m, 'tot': s.tot + (x.r + 0.9 * s.a) * x.m}", "a", Z)

QUERIES, SQL = book.queries, book.sql
