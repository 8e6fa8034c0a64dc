"""Queries of batch algebra, filters, joins, sampling and partitioning, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.advantages import BASE, base
from millrace.catalog.base import Book, r9, read
from millrace.operators import batch as B
from millrace.operators import dataset as D
from millrace.operators import retrieval

book = Book()
add = book.add
OP = "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM orders)"


def orders(s, f):
    return read(s, f, "orders")


def numbered(s, f):
    return B.positions(orders(s, f), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice", "pos")


# ---- columns
add("batch_select", lambda s, f: orders(s, f).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders")
add("batch_pop_taken", lambda s, f: B.pop(orders(s, f), ["o_totalprice"], "o_orderkey")[0], "SELECT o_orderkey, o_totalprice FROM orders")
add("batch_pop_left", lambda s, f: B.pop(orders(s, f), ["o_totalprice", "o_orderdate"], "o_orderkey")[1], "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
add("batch_rename", lambda s, f: B.rename(orders(s, f).select("o_orderkey", "o_custkey"), ["o_custkey"], ["customer"]), "SELECT o_orderkey, o_custkey AS customer FROM orders")
add("batch_positions", lambda s, f: numbered(s, f).select("o_orderkey", "pos"), f"{OP} SELECT o_orderkey, pos FROM o")
add("batch_unfold_chunks", lambda s, f: B.unfold_chunks(read(s, f, "sequences").where("size(input_ids) >= 2 and rollout_id is not null").select("seq_id", "input_ids").distinct(), 2, ["input_ids"], "seq_id").select("seq_id", "chunk", F.size("input_ids").cast("long").alias("n"), F.try_element_at("input_ids", F.lit(1)).alias("first")),
    "WITH s AS (SELECT DISTINCT seq_id, input_ids AS x FROM sequences WHERE len(input_ids) >= 2 AND rollout_id IS NOT NULL) SELECT seq_id, c AS chunk, len(x[c * (len(x) // 2) + 1:(c + 1) * (len(x) // 2)]) AS n, x[c * (len(x) // 2) + 1] AS first FROM s, (SELECT unnest([0, 1]) AS c)")
add("batch_fold_rows", lambda s, f: B.fold_rows(numbered(s, f), 5, ["o_orderkey"]).select("fold", F.concat_ws(",", F.col("o_orderkey").cast("array<string>")).alias("keys")), f"{OP} SELECT CAST(floor(pos / 5) AS BIGINT) AS fold, string_agg(o_orderkey, ',' ORDER BY pos) AS keys FROM o GROUP BY 1")
add("batch_unfold_rows", lambda s, f: B.unfold_rows(B.fold_rows(numbered(s, f), 5, ["o_orderkey"]), ["o_orderkey"]), f"{OP} SELECT CAST(floor(pos / 5) AS BIGINT) AS fold, CAST(pos % 5 AS INT) AS at, o_orderkey FROM o")
add("batch_reduce_by_name", lambda s, f: read(s, f, "events").groupBy("user_id").agg(F.collect_list("value").alias("x")).select("user_id", *[F.round(B.reduce_by_name(F.col("x"), F.lit(n)), 7).alias(n.replace("/", "_")) for n in ("loss/max", "loss/min", "loss/mean")]),
    "SELECT user_id, round(max(value), 7) AS loss_max, round(min(value), 7) AS loss_min, round(avg(value), 7) AS loss_mean FROM events GROUP BY user_id")
add("batch_record_map", lambda s, f: D.prompt_records(read(s, f, "rl_records")),
    "SELECT uid, coalesce(extra_info.index, 0) AS index, extra_info.split AS split, reward_model.ground_truth AS truth, CAST(len(prompt) AS INT) AS turns, prompt[-1].content AS last_message FROM rl_records")
add("batch_unpivot", lambda s, f: orders(s, f).unpivot("o_orderkey", ["o_orderstatus", "o_orderpriority"], "field", "value"), "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
add("batch_first_three_quarters", lambda s, f: (lambda n: numbered(s, f).select("o_orderkey", D.train_part(F.col("pos"), n).alias("split")))(orders(s, f).count()), f"{OP} SELECT o_orderkey, CASE WHEN pos < CAST(floor(n * 0.75) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM o, n")
add("batch_union_slices", lambda s, f: B.concat([read(s, f, "documents").where(F.col("lang") == x).select("doc_id", F.lit(f"corpus_{x}").alias("data_source")) for x in ("en", "zh")]), "SELECT doc_id, 'corpus_' || lang AS data_source FROM documents WHERE lang IN ('en', 'zh')")
add("batch_date_range_text", lambda s, f: D.in_period(read(s, f, "rollouts"), "created_at", "2025-06-01T00:00:00", "2025-07-01T00:00:00").select("rollout_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created")), "SELECT * FROM (SELECT rollout_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM rollouts) WHERE created >= '2025-06-01T00:00:00' AND created < '2025-07-01T00:00:00'")
add("batch_column_aliases", lambda s, f: read(s, f, "rollouts").select("rollout_id", D.first_given([F.col("pred"), F.when(F.col("score") > 0.5, "unknown")], "none").alias("answer")), "SELECT rollout_id, coalesce(CASE WHEN trim(pred) <> '' THEN pred END, CASE WHEN score > 0.5 THEN 'unknown' END, 'none') AS answer FROM rollouts")
add("batch_message_segments", lambda s, f: read(s, f, "documents").where("text is not null").select("doc_id", D.segments(F.col("text"), "<image>").alias("seg"), F.regexp_count("text", F.lit("<image>")).cast("long").alias("images")).select("doc_id", "images", F.size("seg").cast("long").alias("texts"), F.try_element_at("seg", F.lit(1)).alias("first_text")),
    "SELECT doc_id, len(regexp_extract_all(text, '<image>')) AS images, len(list_filter(string_split(text, '<image>'), lambda x: x <> '')) AS texts, list_filter(string_split(text, '<image>'), lambda x: x <> '')[1] AS first_text FROM documents WHERE text IS NOT NULL")
# ---- filters
add("filter_score_band", lambda s, f: read(s, f, "rollouts").where(F.coalesce("score", F.lit(0.0)).between(0.3, 0.7) & (F.col("pred") != "")).select("rollout_id", F.col("prompts").alias("problem"), F.col("pred").alias("answer"), "score"), "SELECT rollout_id, prompts AS problem, pred AS answer, score FROM rollouts WHERE coalesce(score, 0) BETWEEN 0.3 AND 0.7 AND pred <> ''")
add("filter_parsed", lambda s, f: D.parsed(read(s, f, "rollouts"), "pred", "prompts", 400).select("rollout_id"), "SELECT rollout_id FROM rollouts WHERE pred IS NOT NULL AND length(prompts) <= 400")
add("filter_groups_varied", lambda s, f: D.varied_groups(base(s, f), "uid", "score").select("rid", "uid"), f"{BASE}, g AS (SELECT rid, uid, stddev_pop(score) OVER (PARTITION BY uid) AS sd, count(*) OVER (PARTITION BY uid) AS n FROM b) SELECT rid, uid FROM g WHERE sd > 0 OR n = 1")
add("filter_group_ratio", lambda s, f: D.varied_groups(base(s, f), "uid", "score").agg(F.count("*").alias("kept")), f"{BASE}, g AS (SELECT stddev_pop(score) OVER (PARTITION BY uid) AS sd, count(*) OVER (PARTITION BY uid) AS n FROM b) SELECT count(*) AS kept FROM g WHERE sd > 0 OR n = 1")
add("filter_accuracy_band", lambda s, f: D.accuracy_band(base(s, f), "uid", F.col("score") > 0.5, 0.2, 0.8, "length", 1500).select("rid"),
    f"{BASE} SELECT rid FROM b WHERE uid IN (SELECT uid FROM b GROUP BY uid HAVING avg(CAST(score > 0.5 AS INT)) BETWEEN 0.2 AND 0.8 AND max(length) < 1500)")


# ---- rows
add("rows_slice", lambda s, f: B.slice_rows(numbered(s, f), 100, 1000, 7).select("o_orderkey"), f"{OP} SELECT o_orderkey FROM o WHERE pos >= 100 AND pos < 1000 AND (pos - 100) % 7 = 0")
add("rows_gather", lambda s, f: B.gather(numbered(s, f), numbered(s, f).select(F.col("pos").alias("at"), F.floor(F.col("pos") / 2).alias("idx"))).select("at", "o_orderkey"), f"{OP} SELECT a.pos AS at, b.o_orderkey FROM o a JOIN o b ON b.pos = a.pos // 2")
add("rows_inverse_permutation", lambda s, f: B.inverse_permutation(numbered(s, f).select(F.col("pos").alias("at"), F.col("o_orderkey").alias("idx"))), f"{OP} SELECT o_orderkey AS at, pos AS idx FROM o")
add("rows_repeat_interleaved", lambda s, f: B.repeat(numbered(s, f), 3).select("at", "copy", "o_orderkey"), f"{OP} SELECT pos * 3 + c AS at, c AS copy, o_orderkey FROM o, (SELECT unnest([0, 1, 2]) AS c)")
add("rows_repeat_tiled", lambda s, f: B.repeat(numbered(s, f), 2, False, size=orders(s, f).count()).select("at", "o_orderkey"), f"{OP} SELECT c * n + pos AS at, o_orderkey FROM o, n, (SELECT unnest([0, 1]) AS c)")
add("rows_repeat_each", lambda s, f: B.repeat_each(read(s, f, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 4).cast("int").alias("times")), "times").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("copy").alias("copies")),
    "SELECT l_orderkey, CAST(sum(t) AS BIGINT) AS n, CAST(sum(t * (t - 1) / 2) AS BIGINT) AS copies FROM (SELECT l_orderkey, CAST(l_quantity AS INT) % 4 AS t FROM lineitem) WHERE t > 0 GROUP BY l_orderkey")
add("rows_suffixed", lambda s, f: B.suffixed(read(s, f, "nation").select(F.col("n_name")), "n_name", 4).select("n_name"), "SELECT n_name || '_' || c AS n_name FROM nation, (SELECT unnest([0, 1, 2, 3]) AS c)")
add("rows_pad", lambda s, f: (lambda n: B.pad_to_divisor(numbered(s, f).select("pos", "o_orderkey"), 64, n))(orders(s, f).count()), f"{OP}, p AS (SELECT (64 - n % 64) % 64 AS k, n FROM n) SELECT pos, o_orderkey FROM o UNION ALL SELECT n + pos AS pos, o_orderkey FROM o, p WHERE pos < k")
add("rows_unpad", lambda s, f: (lambda n: B.unpad(numbered(s, f).select("pos", "o_orderkey"), n, 10))(orders(s, f).count()), f"{OP} SELECT pos, o_orderkey FROM o, n WHERE pos < n - 10")
add("rows_concat", lambda s, f: B.concat([read(s, f, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), read(s, f, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))]), "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
add("rows_count", lambda s, f: read(s, f, "rollouts").agg(F.count("*").alias("n"), F.countDistinct("rollout_id").alias("ids")), "SELECT count(*) AS n, count(DISTINCT rollout_id) AS ids FROM rollouts")
add("rows_latest_delivery", lambda s, f: _latest(s, f), "SELECT rollout_id, ingested_at FROM (SELECT rollout_id, max(ingested_at) AS ingested_at FROM rollouts GROUP BY rollout_id)")


def _latest(s, f):
    from millrace.operators.delivery import latest_delivery

    return latest_delivery(read(s, f, "rollouts"), "rollout_id", "ingested_at").select("rollout_id", "ingested_at")


# ---- partitioning
add("part_chunks", lambda s, f: (lambda n: numbered(s, f).select("o_orderkey", B.chunk_of(F.col("pos"), n, 8).alias("part")))(orders(s, f).count()), f"{OP} SELECT o_orderkey, CAST(floor(pos * 8 / n) AS INT) AS part FROM o, n")
add("part_near_equal", lambda s, f: (lambda n: numbered(s, f).select("o_orderkey", B.near_equal_part(F.col("pos"), F.lit(n), 7).alias("part")))(orders(s, f).count()), f"{OP} SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY pos) - 1 AS INT) AS part FROM o")
add("part_batches", lambda s, f: numbered(s, f).select("o_orderkey", B.batches(F.col("pos"), 32).alias("batch")), f"{OP} SELECT o_orderkey, CAST(pos // 32 AS INT) AS batch FROM o")
add("part_batches_full", lambda s, f: (lambda n: numbered(s, f).where(F.col("pos") < n - n % 32).select("o_orderkey", B.batches(F.col("pos"), 32).alias("batch")))(orders(s, f).count()), f"{OP} SELECT o_orderkey, CAST(pos // 32 AS INT) AS batch FROM o, n WHERE pos < n - n % 32")
add("part_epochs", lambda s, f: B.repeat(numbered(s, f), 2, False, size=orders(s, f).count()).select("copy", "o_orderkey", B.batches(F.col("pos"), 100).alias("batch")), f"{OP} SELECT c AS copy, o_orderkey, CAST(pos // 100 AS INT) AS batch FROM o, (SELECT unnest([0, 1]) AS c)")
add("part_micro_batches", lambda s, f: D.micro_batches(read(s, f, "sequences").select("seq_id", F.size("input_ids").alias("n")).distinct(), F.col("n"), 4096), "SELECT CAST(least(count(*), ceil(sum(n) / 4096)) AS BIGINT) AS micro_batches FROM (SELECT DISTINCT seq_id, len(input_ids) AS n FROM sequences)")
add("part_tool_routes", lambda s, f: B.routed(read(s, f, "tool_outputs").select("output_id", "tool_name", "status", "result"), "tool_name", "output_id",
    {"sql": lambda d: d.select("output_id", F.lit("rows").alias("kind"), F.length("result").alias("size")), "python_code": lambda d: d.select("output_id", F.upper("status").alias("kind"), F.lit(0).alias("size"))},
    lambda d: d.select("output_id", F.lit("other").alias("kind"), F.lit(None).cast("int").alias("size"))),
    "SELECT output_id, CASE tool_name WHEN 'sql' THEN 'rows' WHEN 'python_code' THEN upper(status) ELSE 'other' END AS kind, CAST(CASE tool_name WHEN 'sql' THEN length(result) WHEN 'python_code' THEN 0 END AS INT) AS size FROM tool_outputs")
# ---- joins
add("join_side_by_side", lambda s, f: B.side_by_side(orders(s, f).select("o_orderkey", "o_custkey", "o_totalprice"), orders(s, f).select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey"), "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
add("join_merge_maps", lambda s, f: orders(s, f).select("o_orderkey", B.merge_maps(F.create_map(F.lit("a"), F.col("o_orderstatus")), F.create_map(F.lit("b"), F.col("o_orderpriority"))).alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")), "SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders")
add("join_kept_semi", lambda s, f: D.kept(read(s, f, "rollouts"), read(s, f, "rl_records"), "uid").select("rollout_id"), "SELECT rollout_id FROM rollouts WHERE uid IN (SELECT uid FROM rl_records)")
add("join_resume_anti", lambda s, f: D.not_done(read(s, f, "rl_records").select("uid").distinct(), read(s, f, "rollouts"), "uid"), "SELECT DISTINCT uid FROM rl_records WHERE uid NOT IN (SELECT uid FROM rollouts WHERE uid IS NOT NULL)")
add("join_records", lambda s, f: D.with_truth(read(s, f, "rollouts").select("rollout_id", "uid", "pred"), read(s, f, "rl_records"), "uid", F.col("reward_model.ground_truth")).select("rollout_id", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).alias("correct")),
    "SELECT rollout_id, coalesce(pred = truth, false) AS correct FROM rollouts r JOIN (SELECT uid, max(reward_model.ground_truth) AS truth FROM rl_records GROUP BY uid) t ON r.uid = t.uid")
add("join_dense_topk", lambda s, f: (lambda e: retrieval.dense_topk(e.where("vec_id % 50 = 0"), e, 5).select("query_id", "rank", "key", F.round("score", 7).alias("score")))(read(s, f, "embeddings")),
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS key, list_dot_product(q.v, d.v) / (q.n * d.n) AS score FROM u q, u d WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank, key, round(score, 7) AS score FROM s QUALIFY rank <= 5""")
add("join_bm25_topk", lambda s, f: retrieval.bm25_topk(read(s, f, "eval_items").where("item_id % 50 = 0"), read(s, f, "documents"), 5, "item_id", "question", "doc_id", "text").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score")),
    """WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(question), '([a-z0-9]+)', 1))) AS term FROM eval_items WHERE item_id % 50 = 0 AND question IS NOT NULL),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / avgdl)) AS w FROM tf JOIN df ON tf.term = df.term, n),
    s AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM q JOIN w ON q.term = w.term GROUP BY ALL)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 5""")
# ---- sampling
add("sample_weights_pow", lambda s, f: base(s, f).select("rid", r9(D.power_weight(F.col("score"), 2.0)).alias("weight")), f"{BASE} SELECT rid, round(greatest(power(abs(score), 2.0), 1e-8), 9) + 0.0 AS weight FROM b")
add("sample_weights_extreme", lambda s, f: D.extreme_weights(base(s, f), "score").select("rid", "weight"), f"{BASE}, e AS (SELECT max(score) AS hi, min(score) AS lo FROM b) SELECT rid, CASE WHEN score = hi OR score = lo THEN 1.0 ELSE 1e-8 END AS weight FROM b, e")
add("sample_seeded_order", lambda s, f: base(s, f).select("rid", F.pmod(B.hash_order(F.col("rid"), 42), F.lit(10)).cast("int").alias("bucket")))
add("sample_covariance_top", lambda s, f: _cov(s, f), """WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_discount * 2 AS x, l_quantity / 50 AS y FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM t),
    c AS (SELECT k, i, round((x - mx) * (y - my), 9) AS cov FROM t, m) SELECT k, i, cov FROM c QUALIFY row_number() OVER (ORDER BY cov DESC, k, i) <= (SELECT greatest(1, CAST(floor(n * 0.002) AS BIGINT)) FROM m)""")


def _cov(s, f):
    t = read(s, f, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_discount") * 2).alias("x"), (F.col("l_quantity") / 50).alias("y"))
    m = t.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).first()
    c = t.select("k", "i", F.round((F.col("x") - m.mx) * (F.col("y") - m.my), 9).alias("cov"))
    return c.orderBy(F.desc("cov"), "k", "i").limit(max(1, int(m.n * 0.002)))


add("set_bag_difference", lambda s, f: orders(s, f).select("o_custkey").exceptAll(orders(s, f).where("o_orderkey % 2 = 0").select("o_custkey")), "SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0")

QUERIES, SQL = book.queries, book.sql
