"""Queries of array, mask, loss and schedule expressions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.advantages import TOK, tokens
from millrace.catalog.base import Book, r9, read
from millrace.functions import arrays as X

book = Book(globals(), **{c: c for c in ("ids", "m", "a", "b", "adv", "v", "ret")})


def seq(name: str, make, sql: str) -> None:
    """An array of each sequence: its length, its sum and its ends."""

    def run(spark, sf):
        c = make().cast("array<bigint>")
        return tokens(spark, sf).select("seq_id", F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.try_element_at(c, F.lit(1)).alias("first"), F.try_element_at(c, F.lit(-1)).alias("last"))

    book.add(f"array_{name}", run, f"{TOK}, x AS (SELECT seq_id, {sql} AS y FROM s) SELECT seq_id, len(y) AS n, CAST(coalesce(list_sum(y), 0) AS BIGINT) AS total, CAST(y[1] AS BIGINT) AS first, CAST(y[-1] AS BIGINT) AS last FROM x")


PADS = "list_transform(range(greatest(600 - len(ids), 0)), lambda i: 7)"
seq("pad_right", lambda: X.pad(ids, 600, 7), f"list_concat(ids, {PADS})")
seq("pad_left", lambda: X.pad(ids, 600, 7, left=True), f"list_concat({PADS}, ids)")
PAD3 = "list_transform(range(greatest(300 - len(ids), 0)), lambda i: 7)"
seq("cut_right", lambda: X.pad_or_cut(ids, 300, 7, cut="right"), f"CASE WHEN len(ids) > 300 THEN ids[1:300] ELSE list_concat({PAD3}, ids) END")
seq("cut_left", lambda: X.pad_or_cut(ids, 300, 7, cut="left"), f"CASE WHEN len(ids) > 300 THEN ids[len(ids) - 299:len(ids)] ELSE list_concat({PAD3}, ids) END")
seq("cut_middle", lambda: X.pad_or_cut(ids, 300, 7, cut="middle"), f"CASE WHEN len(ids) > 300 THEN list_concat(ids[1:150], ids[len(ids) - 149:len(ids)]) ELSE list_concat({PAD3}, ids) END")
seq("without_padding", lambda: X.without_padding(ids, m), "list_transform(list_filter(range(1, len(ids) + 1), lambda i: m[i] = 1), lambda i: ids[i])")
seq("move_padding_left", lambda: X.move_padding(ids, 0), "list_concat(list_filter(ids, lambda q: q = 0), list_filter(ids, lambda q: q <> 0))")
seq("move_padding_right", lambda: X.move_padding(ids, 0, False), "list_concat(list_filter(ids, lambda q: q <> 0), list_filter(ids, lambda q: q = 0))")
seq("not_token", lambda: X.not_token(ids, 0), "list_transform(ids, lambda q: CAST(q <> 0 AS INT))")
seq("cut_to_length", lambda: X.cut_to(ids, F.lit(100)), "CASE WHEN len(ids) > 100 THEN ids[len(ids) - 99:len(ids)] ELSE ids END")
seq("clamp", lambda: F.transform(ids, lambda x: X.clamp(x.cast("double"), 100, 20000).cast("long")), "list_transform(ids, lambda q: CAST(least(greatest(q, 100), 20000) AS BIGINT))")
seq("unfold_first_half", lambda: F.slice(ids, 1, F.floor(F.size(ids) / 2).cast("int")), "ids[1:len(ids) // 2]")

# ---- token rows: lineitem lines are tokens with made-up log-probabilities
LP = "WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_discount * 2 AS a, l_tax * 3 AS b, l_quantity / 50 - 0.5 AS adv, l_extendedprice / 100000 AS v, l_discount * 10 AS ret FROM lineitem)"


def lp(spark, sf):
    L = read(spark, sf, "lineitem")
    return L.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_discount") * 2).alias("a"), (F.col("l_tax") * 3).alias("b"), (F.col("l_quantity") / 50 - 0.5).alias("adv"), (F.col("l_extendedprice") / 100000).alias("v"), (F.col("l_discount") * 10).alias("ret"))




def row(name: str, make, sql: str) -> None:
    book.add(f"loss_{name}", lambda spark, sf: lp(spark, sf).select("k", "i", r9(make()).alias("value")), f"{LP} SELECT k, i, round({sql}, 9) + 0.0 AS value FROM t")


row("kl", lambda: X.kl(a, b), "a - b")
row("kl_abs", lambda: X.kl(a, b, "abs"), "abs(a - b)")
row("kl_k2", lambda: X.kl(a, b, "mse"), "0.5 * (a - b) * (a - b)")
K3 = "least(greatest(exp({x}) - {x} - 1, -10), 10)"
row("kl_k3", lambda: X.kl(a, b, "low_var_kl"), K3.format(x="least(greatest(b - a, -20), 20)"))
row("kl_k3_unclamped", lambda: X.kl(a, b, "k3", clamp_input=False), K3.format(x="(b - a)"))
row("kl_reward", lambda: adv - 0.05 * X.kl(a, b), "adv - 0.05 * (a - b)")
RT = "exp(least(greatest(b - a, -20), 20))"
CL = f"greatest(-adv * {RT}, -adv * least(greatest({RT}, 0.8), 1.2))"
row("dual_clip", lambda: X.dual_clip_loss(a, b, adv), f"CASE WHEN adv < 0 THEN least(-adv * 3.0, {CL}) ELSE {CL} END")
row("is_clipped", lambda: X.is_clipped(a, b, adv).cast("double"), f"CAST(-adv * least(greatest({RT}, 0.8), 1.2) > -adv * {RT} AS DOUBLE)")
row("gpg", lambda: X.gpg_loss(b, adv), "-b * adv")
row("value_clip", lambda: X.value_loss(v, ret, adv, 0.2), "0.5 * greatest((v - adv) * (v - adv), (least(greatest(v, ret - 0.2), ret + 0.2) - adv) * (least(greatest(v, ret - 0.2), ret + 0.2) - adv))")
LS = "-(greatest(-({x}), 0.0) + ln(1 + exp(-abs({x}))))"
row("dpo", lambda: X.dpo_loss(a, b, v, ret, 0.1, 0.1), f"-({LS.format(x='0.1 * ((a - b) - (v - ret))')}) * 0.9 - ({LS.format(x='-0.1 * ((a - b) - (v - ret))')}) * 0.1")
row("ipo", lambda: X.dpo_loss(a, b, v, ret, 0.07, kind="ipo"), "((a - b) - (v - ret) - 1 / (2 * 0.07::DOUBLE)) * ((a - b) - (v - ret) - 1 / (2 * 0.07::DOUBLE))")
row("bce", lambda: X.bce(0.1 + a, F.lit(1.0)), "-ln(0.1 + a)")
row("repair_cost", lambda: X.repair_cost(a), "0.05 / (1 + exp(-5.0 * (0.7 - a)))")
row("step_score", lambda: X.step_score(adv, a, b > 0.1, v > 0.3), "least(greatest(adv * a * CASE WHEN b > 0.1 AND NOT v > 0.3 THEN 0.5 ELSE 1.0 END, -1), 1)")
row("adaptive_scale", lambda: 0.5 + X.clamp((a - 0.3) / 0.5, 0, 1) * 0.5, "0.5 + least(greatest((a - 0.3) / 0.5, 0), 1) * 0.5")
book.add("loss_sequence_ratio", lambda spark, sf: lp(spark, sf).groupBy("k").agg(F.avg(b - a).alias("x")).select("k", r9(X.sequence_ratio(F.col("x"), F.lit(0.0))).alias("value")), f"{LP} SELECT k, round(exp(least(avg(b - a), 10.0)), 9) + 0.0 AS value FROM t GROUP BY k")
LG = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS x, abs(label) % 8 AS label FROM embeddings)"


def logits(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.abs("label") % 8).alias("label"))


Z = "(list_max(x) + ln(list_sum(list_transform(x, lambda q: exp(q - list_max(x))))))"
book.add("dist_entropy", lambda s, f: logits(s, f).select("vec_id", F.round(X.entropy(F.col("x")), 7).alias("value")), f"{LG}, z AS (SELECT vec_id, x, {Z} AS z FROM e) SELECT vec_id, round(z - list_sum(list_transform(x, lambda q: exp(q - z) * q)), 7) AS value FROM z")
book.add("dist_log_prob", lambda s, f: logits(s, f).select("vec_id", F.round(X.log_prob(F.col("x"), F.col("label")), 7).alias("value")), f"{LG} SELECT vec_id, round(x[label + 1] - {Z}, 7) AS value FROM e")
book.add("dist_full_kl", lambda s, f: logits(s, f).select("vec_id", F.round(X.full_kl(X.let(X.log_sum_exp(F.col("x")), lambda z: F.transform(F.col("x"), lambda q: q - z)), F.transform("x", lambda q: F.lit(-4.0))), 7).alias("value")),
         f"{LG}, z AS (SELECT vec_id, x, {Z} AS z FROM e) SELECT vec_id, round(list_sum(list_transform(x, lambda q: exp(q - z) * (q - z + 4.0))), 7) AS value FROM z")
# ---- schedules over order keys as steps
ST = "SELECT o_orderkey, round({x}, 9) + 0.0 AS value FROM (SELECT o_orderkey, o_orderkey % 1000 AS t FROM orders)"


def sched(name: str, make, sql: str) -> None:
    book.add(f"schedule_{name}", lambda s, f: read(s, f, "orders").select("o_orderkey", r9(make(F.col("o_orderkey") % 1000)).alias("value")), ST.format(x=sql))


sched("cosine", lambda t: X.cosine_schedule(t, 100, 900, 0.1), "CASE WHEN t < 100 THEN 0.1 + 0.9 * t / 100 ELSE greatest(0.1, cos(pi() * ((t - 100) / 800)) * 0.45 + 0.55) END")
sched("wsd", lambda t: X.wsd_schedule(t, 100, 900, 0.1), "CASE WHEN t < 100 THEN t / 100 WHEN t < 820 THEN 1.0 WHEN t < 900 THEN 0.9 * greatest(0.0, 0.5 * (1 + cos(pi() * ((t - 820) / 80)))) + 0.1 ELSE 0.1 END")
# ---- media arithmetic over parts
P = "SELECT p_partkey, p_size * 40 + 10 AS h, p_partkey % 900 + 20 AS w FROM part"


def parts(s, f):
    return read(s, f, "part").select("p_partkey", (F.col("p_size") * 40 + 10).alias("h"), (F.col("p_partkey") % 900 + 20).cast("int").alias("w"))


book.add("media_frame_count", lambda s, f: parts(s, f).select("p_partkey", X.frame_count(F.col("h"), F.lit(25.0)).alias("value")), f"SELECT p_partkey, CAST(floor(least(least(greatest(h / 25.0 * 2.0, 4.0), 768.0), h) / 2) * 2 AS INT) AS value FROM ({P})")
R = "greatest(28, CAST(round_even({x} / 28, 0) * 28 AS INT))"
book.add("media_smart_resize", lambda s, f: parts(s, f).select("p_partkey", X.smart_resize(F.col("h"), F.col("w")).alias("z")).select("p_partkey", "z.*"),
         f"""WITH p AS ({P}), r AS (SELECT *, {R.format(x='h')} AS hh, {R.format(x='w')} AS ww FROM p)
         SELECT p_partkey, CAST(CASE WHEN hh * ww < 3136 THEN ceil(h * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE hh END AS INT) AS height, CAST(CASE WHEN hh * ww < 3136 THEN ceil(w * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE ww END AS INT) AS width FROM r""")
book.add("reward_discounted_total", lambda s, f: read(s, f, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))).alias("z")).select("l_orderkey", F.round(X.discounted_total(F.col("z.l_quantity"), F.col("z.l_discount"), F.lit(1.0)), 6).alias("value")),
         """WITH z AS (SELECT l_orderkey, l_quantity - l_discount AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) - 1 AS t FROM lineitem)
         SELECT l_orderkey, round(1.0 + sum(x * power(0.99, t)), 6) AS value FROM z GROUP BY l_orderkey""")

QUERIES, SQL = book.queries, book.sql
