"""Queries of votes, roll-ups, rewards and token statistics, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.advantages import BASE, TOK, base, tokens
from millrace.catalog.base import Book, r9, read
from millrace.operators import dataset as D
from millrace.operators import metrics as M

book = Book(globals(), r="r", v="v", m="m", L="length")
add = book.add
VOTES = "WITH b AS (SELECT DISTINCT rollout_id AS rid, uid, data_source, pred, score, step FROM rollouts WHERE uid IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL)"


def votes(spark, sf):
    return read(spark, sf, "rollouts").where("uid IS NOT NULL AND pred IS NOT NULL AND score IS NOT NULL").select(F.col("rollout_id").alias("rid"), "uid", "data_source", "pred", "score", "step").distinct()


def rnd(c: str, alias: str | None = None) -> str:
    return f"round({c}, 9) + 0.0 AS {alias or c}"


add("metric_mean_of_means", lambda s, f: M.mean_of_means(base(s, f).where("data_source is not null"), "data_source", "uid", "score").select("data_source", r9(F.col("mean_score")).alias("mean_score")),
    f"{BASE}, m AS (SELECT data_source, uid, avg(score) AS m FROM b WHERE data_source IS NOT NULL GROUP BY ALL) SELECT data_source, {rnd('avg(m)', 'mean_score')} FROM m GROUP BY data_source")
MAJ = ", v AS (SELECT uid, pred, count(*) AS votes, min(rid) AS p, arg_min(score, rid) AS first_value FROM b GROUP BY uid, pred), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, p) AS k, sum(votes) OVER (PARTITION BY uid) AS n FROM v)"
add("metric_majority", lambda s, f: M.majority(votes(s, f), ["uid"], "pred", "score", "rid").select("uid", "pred", "votes", r9(F.col("first_value")).alias("first_value"), "n", r9(F.col("share")).alias("share")),
    f"{VOTES}{MAJ} SELECT uid, pred, votes, {rnd('first_value')}, CAST(n AS BIGINT) AS n, {rnd('votes / n', 'share')} FROM r WHERE k = 1")
add("metric_majority_of_turns", lambda s, f: M.majority(read(s, f, "events").withColumn("vote", F.expr("event_type")), ["user_id"], "vote", "value", "event_id").select("user_id", "vote", "votes", r9(F.col("first_value")).alias("first_value")),
    f"WITH v AS (SELECT user_id, event_type AS vote, count(*) AS votes, min(event_id) AS p, arg_min(value, event_id) AS first_value FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, p) AS k FROM v) SELECT user_id, vote, votes, {rnd('first_value')} FROM r WHERE k = 1")
J = ", j AS (SELECT *, CASE WHEN rid % 3 = 0 THEN 'correct' WHEN rid % 3 = 1 THEN 'wrong' END AS verdict, CASE WHEN rid % 7 <> 0 THEN (rid % 101) / 100.0 END AS prob FROM b)"


def judged(s, f):
    v = votes(s, f)
    return v.withColumn("verdict", F.when(F.col("rid") % 3 == 0, "correct").when(F.col("rid") % 3 == 1, "wrong")).withColumn("prob", F.when(F.col("rid") % 7 != 0, (F.col("rid") % 101) / 100.0))


add("metric_judged_mean", lambda s, f: M.judged_mean(judged(s, f), ["uid"], "score", "verdict").select("uid", r9(F.col("value")).alias("value")),
    f"{VOTES}{J} SELECT uid, {rnd(chr(99)+'oalesce(avg(score) FILTER (WHERE verdict = ' + repr('correct') + '), 0.0)', 'value')} FROM j GROUP BY uid")
add("metric_judged_best", lambda s, f: M.judged_best(judged(s, f), ["uid"], "score", "verdict", "prob", "rid").select("uid", r9(F.col("value")).alias("value")),
    f"""{VOTES}{J}, t AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY prob DESC, rid) AS k FROM j WHERE verdict = 'correct' AND prob IS NOT NULL),
    w AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY prob, rid) AS k FROM j WHERE verdict = 'wrong' AND prob IS NOT NULL), m AS (SELECT uid, avg(score) AS a FROM j GROUP BY uid)
    SELECT m.uid, {rnd('coalesce(t.score, w.score, a)', 'value')} FROM m LEFT JOIN t ON t.uid = m.uid AND t.k = 1 LEFT JOIN w ON w.uid = m.uid AND w.k = 1""")


def signed_prob():
    return F.when(F.col("verdict") == "correct", F.col("prob")).otherwise(-F.col("prob"))


add("metric_weighted_majority", lambda s, f: M.weighted_majority(judged(s, f).where("prob is not null"), ["uid"], "pred", "score", F.round(signed_prob() * 100).cast("long"), "rid").select("uid", "pred", "w", r9(F.col("first_value")).alias("first_value")),
    f"""{VOTES}{J}, v AS (SELECT uid, pred, CAST(sum(CAST(round(CASE WHEN verdict = 'correct' THEN prob ELSE -prob END * 100) AS BIGINT)) AS BIGINT) AS w, min(rid) AS p, arg_min(score, rid) AS first_value FROM j WHERE prob IS NOT NULL GROUP BY uid, pred),
    r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY w DESC, p) AS k FROM v) SELECT uid, pred, w, {rnd('first_value')} FROM r WHERE k = 1""")
add("metric_validation_rollup", lambda s, f: M.validation_rollup(base(s, f).where("data_source is not null"), "data_source", "uid", "score").select("data_source", "metric", F.round("value", 7).alias("value")),
    f"""{BASE}, g AS (SELECT data_source, uid, list_sort(list(score)) AS x, len(list(score)) AS n FROM b WHERE data_source IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, unnest(list_concat(list_filter(list_transform(range(1, 21), lambda i: CAST(power(2, i) AS BIGINT)), lambda q: q < n), [n])) AS k FROM g WHERE n > 1),
    m AS (SELECT data_source, uid, 'mean@' || n AS metric, list_sum(x) / n AS v FROM g
      UNION ALL SELECT data_source, uid, 'std@' || n, list_aggregate(x, 'stddev_pop') FROM g WHERE n > 1
      UNION ALL SELECT data_source, uid, 'best@' || k, list_sum(list_transform(range(1, n + 1), lambda i: x[i] * (power(i / n, k) - power((i - 1) / n, k)))) FROM k
      UNION ALL SELECT data_source, uid, 'worst@' || k, list_sum(list_transform(range(1, n + 1), lambda i: x[i] * (power((n - i + 1) / n, k) - power((n - i) / n, k)))) FROM k)
    SELECT data_source, metric, round(avg(v), 7) AS value FROM m GROUP BY ALL""")
add("metric_accuracy", lambda s, f: M.accuracy(base(s, f), F.col("score") >= 0.5, ["data_source"]).select("data_source", "correct", "total", r9(F.col("accuracy")).alias("accuracy")),
    f"{BASE} SELECT data_source, count(*) FILTER (WHERE score >= 0.5) AS correct, count(*) AS total, {rnd('count(*) FILTER (WHERE score >= 0.5) / count(*)', 'accuracy')} FROM b GROUP BY data_source")
add("metric_verification_f1", lambda s, f: M.verification_f1(base(s, f), F.col("score") > 0.6, F.col("rid") % 2 == 0, ["data_source"]).select("data_source", "tp", "fp", "fn", *[r9(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]),
    f"""{BASE}, c AS (SELECT data_source, count(*) FILTER (WHERE score > 0.6 AND rid % 2 = 0) AS tp, count(*) FILTER (WHERE score > 0.6 AND rid % 2 <> 0) AS fp, count(*) FILTER (WHERE score <= 0.6 AND rid % 2 = 0) AS fn FROM b GROUP BY data_source),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
    SELECT data_source, tp, fp, fn, {rnd('p', 'precision')}, {rnd('r', 'recall')}, {rnd('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END', 'f1')} FROM p""")
add("metric_rollup_sets", lambda s, f: M.rollup_sets(base(s, f), "data_source", {"n": F.count("*"), "mean_score": r9(F.avg("score"))}),
    f"{BASE} SELECT s AS data_source, count(*) AS n, {rnd('avg(score)', 'mean_score')} FROM (SELECT *, coalesce(data_source, 'unknown') AS s FROM b) GROUP BY ROLLUP (s)")
add("metric_tool_success", lambda s, f: D.success_rate(read(s, f, "tool_outputs").dropDuplicates(["output_id"]), F.col("status") == "success", "tool_name").withColumn("rate", r9(F.col("rate"))),
    f"WITH t AS (SELECT DISTINCT output_id, tool_name, status FROM tool_outputs) SELECT tool_name, count(*) AS calls, {rnd(chr(97) + 'vg(CAST(status = ' + repr('success') + ' AS DOUBLE))', 'rate')} FROM t GROUP BY tool_name")
add("metric_tool_success_by_rollout", lambda s, f: read(s, f, "tool_outputs").where("rollout_id is not null").select("output_id", "rollout_id", "status").distinct().join(base(s, f).select(F.col("rid").alias("rollout_id")), "rollout_id", "right").groupBy("rollout_id").agg(r9(F.coalesce(F.avg((F.col("status") == "success").cast("double")), F.lit(1.0))).alias("rate")),
    f"{BASE}, t AS (SELECT DISTINCT output_id, rollout_id, status FROM tool_outputs WHERE rollout_id IS NOT NULL) SELECT rid AS rollout_id, {rnd(chr(99)+'oalesce(avg(CAST(status = ' + repr('success') + ' AS DOUBLE)), 1.0)', 'rate')} FROM b LEFT JOIN t ON t.rollout_id = rid GROUP BY rid")
add("metric_score_spread", lambda s, f: M.spread(base(s, f), "score", ["data_source"]).select("data_source", "n", *[F.round(c, 7).alias(c) for c in ("total", "mean", "least", "most", "std", "median")]),
    f"{BASE} SELECT data_source, count(score) AS n, " + ", ".join(f"round({e}, 7) AS {a}" for e, a in (("sum(score)", "total"), ("avg(score)", "mean"), ("min(score)", "least"), ("max(score)", "most"), ("stddev_pop(score)", "std"), ("median(score)", "median"))) + " FROM b GROUP BY data_source")
add("metric_tool_time", lambda s, f: M.spread(read(s, f, "tool_outputs").where("execution_time_ms >= 0").select("output_id", "tool_name", "execution_time_ms").distinct(), "execution_time_ms", ["tool_name"]).select("tool_name", "n", *[F.round(c, 5).alias(c) for c in ("total", "mean", "least", "most", "median")]),
    "WITH t AS (SELECT DISTINCT output_id, tool_name, execution_time_ms AS x FROM tool_outputs WHERE execution_time_ms >= 0) SELECT tool_name, count(x) AS n, " + ", ".join(f"round({e}, 5) AS {a}" for e, a in (("sum(x)", "total"), ("avg(x)", "mean"), ("min(x)", "least"), ("max(x)", "most"), ("median(x)", "median"))) + " FROM t GROUP BY tool_name")
add("metric_slowest_call", lambda s, f: D.greatest_of(read(s, f, "tool_outputs").where("execution_time_ms >= 0"), "tool_name", "output_id", "execution_time_ms").withColumnRenamed("execution_time_ms", "ms"),
    "SELECT tool_name, output_id, execution_time_ms AS ms FROM (SELECT DISTINCT output_id, tool_name, execution_time_ms FROM tool_outputs WHERE execution_time_ms >= 0) QUALIFY row_number() OVER (PARTITION BY tool_name ORDER BY execution_time_ms DESC, output_id) = 1")
add("metric_explained_variance", lambda s, f: M.explained_variance(read(s, f, "lineitem").withColumn("v", F.col("l_quantity") * 1000), "v", "l_extendedprice").select(F.round("explained_variance", 7).alias("explained_variance")),
    "SELECT round(1 - var_samp(l_extendedprice - l_quantity * 1000) / (var_samp(l_extendedprice) + 1e-5), 7) AS explained_variance FROM lineitem")
# ---- token statistics
MS = "list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN m[i] = 1 THEN r[i] ELSE 0.0 END))"
MC = "list_sum(m)"
add("token_masked_sum", lambda s, f: tokens(s, f).select("seq_id", F.round(M.masked_sum(r, m), 6).alias("value")), f"{TOK} SELECT seq_id, round({MS}, 6) AS value FROM s")
add("token_masked_mean", lambda s, f: tokens(s, f).select("seq_id", r9(M.masked_mean(r, m)).alias("value")), f"{TOK} SELECT seq_id, {rnd(MS + ' / (' + MC + ' + 1e-8)', 'value')} FROM s")
add("token_masked_var", lambda s, f: tokens(s, f).select("seq_id", F.round(M.masked_var(r, m), 7).alias("value")),
    f"{TOK}, a AS (SELECT *, {MC} AS n, {MS} / ({MC} + 1e-8) AS mean FROM s) SELECT seq_id, round(CASE WHEN n > 1 THEN list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN m[i] = 1 THEN (r[i] - mean) * (r[i] - mean) ELSE 0.0 END)) / (n + 1e-8) * n / (n - 1) END, 7) AS value FROM a")
for mode, sql in (("token-mean", f"sum({MS}) / (sum({MC}) + 1e-8)"), ("seq-mean-token-sum", f"avg({MS})"), ("seq-mean-token-mean", f"avg({MS} / {MC})"), ("seq-mean-token-sum-norm", f"sum({MS}) / max(len(r))")):
    add(f"token_loss_{mode.replace('-', '_')}", lambda s, f, mode=mode: M.agg_loss(tokens(s, f).where(M.mask_count(m) > 0), "r", "m", mode).select(F.round("loss", 6).alias("loss")), f"{TOK} SELECT round({sql}, 6) AS loss FROM s WHERE {MC} > 0")
add("token_last_score", lambda s, f: tokens(s, f).select("seq_id", F.array_position(M.at_last_token(F.lit(2.5), m), F.lit(2.5)).cast("long").alias("place")), f"{TOK} SELECT seq_id, CASE WHEN {MC} > 0 THEN {MC} ELSE 0 END AS place FROM s")
add("token_lengths", lambda s, f: tokens(s, f).agg(F.count("*").alias("n"), r9(F.avg(M.mask_count(m))).alias("mean"), F.max(M.mask_count(m)).alias("most"), F.min(M.mask_count(m)).alias("least"), r9(F.avg((M.mask_count(m) >= 1024).cast("double"))).alias("clip_ratio")),
    f"{TOK} SELECT count(*) AS n, {rnd('avg(' + MC + ')', 'mean')}, CAST(max({MC}) AS BIGINT) AS most, CAST(min({MC}) AS BIGINT) AS least, {rnd('avg(CAST(' + MC + ' >= 1024 AS DOUBLE))', 'clip_ratio')} FROM s")
# ---- rewards
add("reward_overlong", lambda s, f: base(s, f).select("rid", r9(M.overlong_penalty(L, 600, 100)).alias("value"), (M.overlong_penalty(L, 600, 100) < 0).alias("overlong")), f"{BASE} SELECT rid, {rnd('least(-(length - 500) / 100.0 * 1.0, 0.0)', 'value')}, least(-(length - 500) / 100.0, 0.0) < 0 AS overlong FROM b")
TR = ", t AS (SELECT *, avg(CAST(n_actions > 0 AS DOUBLE)) OVER (PARTITION BY uid) AS rate FROM b)"


def rates(s, f):
    b = base(s, f)
    g = b.groupBy("uid").agg(F.avg((F.col("n_actions") > 0).cast("double")).alias("rate"))
    return b.join(g, "uid")


add("reward_curiosity", lambda s, f: rates(s, f).select("rid", r9(M.curiosity(F.col("n_actions") != 0, F.col("rate"), 0.9)).alias("bonus"), r9(M.redundancy(F.col("n_actions"))).alias("penalty")),
    f"{BASE}{TR} SELECT rid, {rnd('0.5 * CAST(n_actions <> 0 AS INT) * greatest(0.0, 0.9 - rate)', 'bonus')}, {rnd('0.05 * least(1 - n_actions, 0)', 'penalty')} FROM t")
add("reward_curriculum", lambda s, f: base(s, f).select("rid", r9(M.curriculum_score(F.col("score"), F.lit(0.1), F.lit(0.05), F.col("rid") % 5 != 0)).alias("value")), f"{BASE} SELECT rid, {rnd('CASE WHEN rid % 5 <> 0 THEN least(score, 1 - score) ELSE -1.0 END - 0.1 + 0.05', 'value')} FROM b")
add("reward_binary", lambda s, f: base(s, f).select("rid", F.when(F.col("score") >= 0.9, 1).otherwise(-1).alias("value")), f"{BASE} SELECT rid, CASE WHEN score >= 0.9 THEN 1 ELSE -1 END AS value FROM b")
# ---- turns
add("metric_turn_changes", lambda s, f: M.turn_changes(read(s, f, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_quantity") > 25).cast("int")).alias("c")), "l_orderkey", "l_linenumber", "c").select("l_linenumber", *[r9(F.col(c)).alias(c) for c in ("accuracy", "change", "lost", "won")]),
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity > 25 AS INT)) AS c FROM lineitem GROUP BY ALL), x AS (SELECT *, lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM d)
    SELECT l_linenumber, {rnd('avg(c)', 'accuracy')}, {rnd('avg(c - b)', 'change')}, {rnd('avg(CAST(b = 1 AND c = 0 AS INT)) FILTER (WHERE b IS NOT NULL)', 'lost')}, {rnd('avg(CAST(b = 0 AND c = 1 AS INT)) FILTER (WHERE b IS NOT NULL)', 'won')} FROM x GROUP BY l_linenumber""")
add("metric_pair_agreement", lambda s, f: M.pair_agreement(read(s, f, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").select(r9(F.col("accuracy")).alias("accuracy")),
    f"""WITH p AS (SELECT a.l_orderkey AS k, abs(a.l_quantity - b.l_quantity) AS w, sign(a.l_extendedprice - b.l_extendedprice) * sign(a.l_quantity - b.l_quantity) > 0 AS ok FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
    g AS (SELECT k, CASE WHEN sum(w) > 0 THEN sum(w * CAST(ok AS INT)) / sum(w) ELSE 0.5 END AS acc FROM p GROUP BY k) SELECT {rnd('avg(acc)', 'accuracy')} FROM g""")

QUERIES, SQL = book.queries, book.sql
