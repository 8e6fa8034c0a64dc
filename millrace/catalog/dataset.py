"""Queries of records, messages, choices, batches and losses of training sets, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.catalog.advantages import BASE, TOK, base, tokens
from millrace.catalog.base import Book, r9, read
from millrace.functions import arrays as X
from millrace.operators import batch as B
from millrace.operators import dataset as D

book = Book()
add = book.add

add("data_last_user_answer", lambda s, f: read(s, f, "rl_records").select("uid", D.last_user_answer(F.col("prompt")).alias("value")),
    "SELECT uid, CASE WHEN starts_with(c, '#### ') THEN c ELSE '#### ' || c END AS value FROM (SELECT uid, coalesce(list_filter(prompt, lambda m: m.role = 'user')[-1].content, '') AS c FROM rl_records)")
TOOL = "responses || '<interpreter> 4 </interpreter>then'"
add("data_alternating_messages", lambda s, f: read(s, f, "rollouts").where("trim(responses) <> ''").selectExpr("rollout_id", f"{TOOL} AS t").select("rollout_id", F.explode(D.alternating(F.col("t"))).alias("m")).select("rollout_id", "m.role", F.when(F.col("m.role") == "tool", F.col("m.content")).alias("said")),
    "SELECT rollout_id, role, CASE WHEN role = 'tool' THEN '4' END AS said FROM (SELECT rollout_id, unnest(['assistant', 'tool', 'assistant']) AS role FROM rollouts WHERE trim(responses) <> '')")
add("data_first_given", lambda s, f: read(s, f, "tool_outputs").select("output_id", D.first_given([F.col("error"), F.col("status")], "none").alias("value")), "SELECT output_id, coalesce(CASE WHEN trim(error) <> '' THEN error END, CASE WHEN trim(status) <> '' THEN status END, 'none') AS value FROM tool_outputs")
add("data_choices", lambda s, f: read(s, f, "eval_items").where("question is not null and answer is not null").select("item_id", D.with_choices(F.col("question"), F.col("answer"), F.array(F.lit("w1"), F.lit("w2"), F.lit("w3")), F.col("item_id"), 7).alias("x"), "answer")
    .select("item_id", F.contains(F.col("x.prompt"), F.concat(F.col("x.letter"), F.lit(") "), F.col("answer"))).alias("right"), F.col("x.letter").isin("A", "B", "C", "D").alias("known"), F.regexp_count("x.prompt", F.lit(r"\n[A-D]\) ")).alias("lines")),
    "SELECT item_id, true AS right, true AS known, CAST(4 + len(regexp_extract_all(question || answer, '\\n[A-D]\\) ')) AS INT) AS lines FROM eval_items WHERE question IS NOT NULL AND answer IS NOT NULL")
add("data_counted_letters", lambda s, f: read(s, f, "nation").select("n_nationkey", D.counted_letters(F.col("n_name"), F.lit("A")).alias("value")),
    "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: c || CASE WHEN c = 'A' THEN ' = ' ELSE ' != ' END || 'A.'), chr(10)) || chr(10) || '\\boxed{' || len(list_filter(string_split(n_name, ''), lambda c: c = 'A')) || '} A in ' || array_to_string(string_split(n_name, ''), '-') || '.' AS value FROM nation")
add("data_padded", lambda s, f: (lambda d, n: D.padded(d, "pos", n, 5).select("o_orderkey", "pos"))(B.positions(read(s, f, "orders"), "o_orderkey").select("o_orderkey", "pos"), read(s, f, "orders").count()),
    "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, pos FROM o UNION ALL SELECT o_orderkey, n + i AS pos FROM o, n, (SELECT unnest(range(5)) AS i) WHERE pos = 0")
add("data_ranks", lambda s, f: base(s, f).select("rid", F.explode(D.rank_of(F.col("rid"), 4, 2)).alias("rank")), f"{BASE} SELECT rid, (rid % 4) * 2 + c AS rank FROM b, (SELECT unnest([0, 1]) AS c)")
add("data_composed", lambda s, f: tokens(s, f).select("seq_id", D.composed(F.slice("ids", 1, 20), F.slice("ids", 21, 1000), 16, 24, 0).alias("x")).select("seq_id", F.concat_ws(",", F.col("x.ids").cast("array<string>")).alias("ids"), F.aggregate("x.mask", F.lit(0), lambda a, m: a + m).alias("kept"), F.array_max("x.positions").cast("int").alias("last")),
    f"""{TOK}, p AS (SELECT seq_id, ids[1:20] AS p, ids[21:1020] AS r FROM s), c AS (SELECT seq_id, p[greatest(len(p) - 15, 1):len(p)] AS p, r[1:24] AS r FROM p)
    SELECT seq_id, array_to_string(list_concat(list_concat(list_transform(range(16 - len(p)), lambda i: 0), p), list_concat(r, list_transform(range(24 - len(r)), lambda i: 0))), ',') AS ids, CAST(len(p) + len(r) AS INT) AS kept, CAST(len(p) + len(r) - 1 AS INT) AS last FROM c""")
SCHEMA = StructType([StructField("rid", LongType()), StructField("uid", StringType()), StructField("score", DoubleType())])
add("data_checked", lambda s, f: D.checked(base(s, f), SCHEMA, "rid").select("rid", "score"), f"{BASE} SELECT rid, score FROM b")
add("data_rows_to_columns", lambda s, f: read(s, f, "rl_records").select("uid", D.columns_of(F.col("prompt"), ["role", "content"]).alias("x")).select("uid", F.array_join("x.role", ",").alias("roles"), F.size("x.content").alias("n")), "SELECT uid, array_to_string(list_transform(prompt, lambda m: m.role), ',') AS roles, CAST(len(prompt) AS INT) AS n FROM rl_records")
add("data_columns_to_rows", lambda s, f: tokens(s, f).select("seq_id", D.stacked([F.col("ids"), F.col("m")], ["id", "m"]).alias("x")).select("seq_id", F.size(F.filter("x", lambda r: (r["m"] == 1) & (r["id"] % 2 == 0))).alias("n")),
    f"{TOK} SELECT seq_id, CAST(len(list_filter(range(1, len(ids) + 1), lambda i: m[i] = 1 AND ids[i] % 2 = 0)) AS INT) AS n FROM s")
add("data_difficulty", lambda s, f: D.difficulty(base(s, f), "uid", F.col("score") > 0.5).select("rid", r9(F.col("difficulty")).alias("difficulty")), f"{BASE} SELECT rid, round(1 - avg(CAST(score > 0.5 AS DOUBLE)) OVER (PARTITION BY uid), 9) + 0.0 AS difficulty FROM b")
add("loss_score_clip", lambda s, f: read(s, f, "lineitem").select("l_orderkey", "l_linenumber", r9(X.score_clip_loss(F.lit(-1.0), -F.col("l_discount") * 10, F.col("l_quantity") / 25 - 1, F.col("l_tax") * 10)).alias("value")),
    """SELECT l_orderkey, l_linenumber, round(greatest(-a * q, -a * greatest(0.8, least(1.2 + least(1.0, greatest(0.0, (0.8 - l_tax * 10) / 0.5)) * 0.1, q))), 9) + 0.0 AS value
    FROM (SELECT *, l_quantity / 25 - 1 AS a, exp(-l_discount * 10 + 1.0) AS q FROM lineitem)""")
add("report_flops", lambda s, f: tokens(s, f).select(F.size("ids").cast("double").alias("n")).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q")).select(X.dense_flops(F.col("t"), F.col("q"), 7_000_000, 28, 16, 64).alias("flops")),
    f"{TOK} SELECT 6.0 * 7000000 * sum(CAST(len(ids) AS DOUBLE)) + 12.0 * 28 * 16 * 64 * sum(CAST(len(ids) AS DOUBLE) * len(ids)) AS flops FROM s")

QUERIES, SQL = book.queries, book.sql
