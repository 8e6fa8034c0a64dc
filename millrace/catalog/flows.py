"""Queries of plans, sources, sinks, turn state and sequential operators, over whole tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.catalog.advantages import BASE, base
from millrace.catalog.base import Book, r9, read
from millrace.functions import answers as A
from millrace.operators import custom
from millrace.operators import dataset as D
from millrace.plans import curation
from millrace.session import shared_folder, tables_folder
from millrace.sources import readers, sinks
from millrace.streaming import turns as T

book = Book()
add = book.add

# ---- plans
BOXQ = f"regexp_extract_all(responses, '{A.BOX}', 1)[-1]"
CUR = f"""WITH a AS (SELECT DISTINCT rollout_id AS rid, prompts AS question, coalesce({BOXQ}, pred) AS answer FROM rollouts WHERE prompts IS NOT NULL),
 v AS (SELECT question, answer, count(*) AS votes, min(rid) AS p FROM a WHERE answer IS NOT NULL AND answer <> '' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY votes DESC, p) AS k, CAST(sum(votes) OVER (PARTITION BY question) AS BIGINT) AS n FROM v)
 SELECT question AS problem, answer, round(votes / n, 9) + 0.0 AS score, votes, n FROM r WHERE k = 1 AND votes / n BETWEEN {{{{lo}}}} AND {{{{hi}}}} AND NOT (contains(question, '证明') OR contains(lower(question), 'box') OR contains(lower(answer), 'text'))"""


def _curate(s, f, lo, hi):
    a = read(s, f, "rollouts").where("prompts is not null").select(F.col("rollout_id").alias("rid"), F.col("prompts").alias("question"), F.coalesce(A.boxed_last(F.col("responses")), F.col("pred")).alias("answer")).distinct()
    return curation.curate(a, low=lo, high=hi).withColumn("score", r9(F.col("score")))


add("flow_curate", lambda s, f: _curate(s, f, 0.3, 0.7), CUR.replace('{{lo}}', '0.3').replace('{{hi}}', '0.7'))
add("flow_curate_wide", lambda s, f: _curate(s, f, 0.0, 1.0), CUR.replace('{{lo}}', '0.0').replace('{{hi}}', '1.0'))
add("flow_advantage_step", lambda s, f: curation.advantage_step(base(s, f)).select("rid", r9(F.col("advantage")).alias("advantage")),
    f"{BASE}, g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS std, stddev_pop(score) OVER w AS sdp FROM b WINDOW w AS (PARTITION BY uid)) SELECT rid, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mean) / (std + 1e-6) END, 9) + 0.0 AS advantage FROM g WHERE sdp > 0 OR n = 1")
add("flow_score_by_source", lambda s, f: base(s, f).groupBy("data_source", "step").agg(F.count("*").alias("n"), r9(F.avg("score")).alias("mean_score")), f"{BASE} SELECT data_source, step, count(*) AS n, round(avg(score), 9) + 0.0 AS mean_score FROM b GROUP BY ALL")
# ---- sources
add("scan_files_in_order", lambda s, f: readers.parquet_files(s, [f"{f}/{t}.parquet" for t in ("region", "nation")]).groupBy("file_idx").agg(F.count("*").alias("n"), F.max("row_idx").alias("last_row")), "SELECT CAST(0 AS INT) AS file_idx, count(*) AS n, count(*) - 1 AS last_row FROM region UNION ALL SELECT 1, count(*), count(*) - 1 FROM nation")
add("scan_normalised_samples", lambda s, f: readers.normalised_samples(read(s, f, "eval_items").withColumn("idx", F.col("item_id")), "heldout", "idx", 100), "SELECT 'heldout_' || item_id AS id, question, answer FROM (SELECT * FROM eval_items ORDER BY item_id LIMIT 100) WHERE question <> ''")
add("scan_normalised_all", lambda s, f: readers.normalised_samples(read(s, f, "eval_items").withColumn("idx", F.col("item_id")), "heldout", "idx"), "SELECT 'heldout_' || item_id AS id, question, answer FROM eval_items WHERE question <> ''")
add("scan_lifted", lambda s, f: readers.lifted(read(s, f, "rl_records")).select("uid", "index", "score"), "SELECT uid, coalesce(extra_info.index, 0) AS index, 0.6::DOUBLE AS score FROM rl_records")
add("scan_short_prompts", lambda s, f: readers.short_prompts(read(s, f, "rollouts").where("prompts is not null"), "prompts", 40).select("rollout_id"), r"SELECT rollout_id FROM rollouts WHERE prompts IS NOT NULL AND len(regexp_split_to_array(trim(prompts, ' '), '\s+')) <= 40")
add("scan_messages", lambda s, f: D.messages(read(s, f, "rl_records")), "SELECT uid, CAST(unnest(range(len(prompt))) AS INT) AS turn, unnest(prompt).role AS role, unnest(prompt).content AS content FROM rl_records")
add("scan_page_texts", lambda s, f: readers.page_texts(read(s, f, "documents"), "doc_id", "text"))
add("scan_generation", lambda s, f: D.generations(read(s, f, "rollouts"), "uid", "responses"), "SELECT uid, count(*) AS n, min(responses) AS first_response FROM rollouts WHERE uid IS NOT NULL GROUP BY uid")


def _jsonl(s, f):
    path = f"{shared_folder(s)}/millrace/corpus-{uuid.uuid4().hex}.jsonl"
    read(s, f, "documents").select("doc_id", "text").write.json(path)
    return readers.resolve(s, path).select("doc_id", "text")


add("scan_jsonl_corpus", _jsonl, "SELECT doc_id, text FROM documents")
# ---- sinks
add("sink_four_places", lambda s, f: sinks.four_places(base(s, f).groupBy("data_source").agg(F.avg("score").alias("score")).where("data_source is not null"), ["score"]), f"{BASE} SELECT data_source, printf('%.4f', avg(score)) AS score FROM b WHERE data_source IS NOT NULL GROUP BY data_source")
add("sink_flat_columns", lambda s, f: sinks.flat_columns(read(s, f, "rl_records").select("uid", "reward_model", "extra_info")), 'SELECT uid, reward_model.style AS "reward_model/style", reward_model.ground_truth AS "reward_model/ground_truth", extra_info.split AS "extra_info/split", extra_info.index AS "extra_info/index", extra_info.answer AS "extra_info/answer", extra_info.question AS "extra_info/question" FROM rl_records')
add("sink_metric_rows", lambda s, f: sinks.metric_rows(read(s, f, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey"), "SELECT o_orderkey, 'o_totalprice' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders")
add("sink_nested_validation", lambda s, f: sinks.nested_validation(base(s, f).withColumn("pred", F.col("rid")), "data_source", "uid", "score", "pred").select("data_source", "uid", F.size("samples").cast("long").alias("n"), r9(F.col("samples")[0]["score"]).alias("least"), F.size(F.filter("samples", lambda x: x["is_correct"])).cast("long").alias("correct")), f"{BASE} SELECT data_source, uid, count(*) AS n, round(min(score), 9) + 0.0 AS least, count(*) FILTER (WHERE score >= 0.5) AS correct FROM b GROUP BY ALL")
add("sink_list_to_map", lambda s, f: read(s, f, "tool_outputs").where("processed_images is not null").select("output_id", sinks.list_to_map(F.col("processed_images")).alias("m")).select("output_id", F.col("m")["list_len"].alias("n"), F.col("m")["0"].alias("first")), "SELECT output_id, CAST(len(processed_images) AS VARCHAR) AS n, processed_images[1] AS first FROM tool_outputs WHERE processed_images IS NOT NULL")


def _generations(s, f):
    path = f"{shared_folder(s)}/millrace/generations-{uuid.uuid4().hex}"
    sinks.write_generations(read(s, f, "rollouts").where("responses is not null").select("rollout_id", "responses", "score", "step"), path)
    return s.read.schema("rollout_id long, responses string, score double, step int").json(path).select("rollout_id", "responses", "step")


add("sink_generations", _generations, "SELECT rollout_id, responses, step FROM rollouts WHERE responses IS NOT NULL")
# ---- turns, batch forms over the events table
EV = "events"
add("turn_active", lambda s, f: T.active_turns(read(s, f, EV).withColumn("done", F.col("event_type") == "purchase"), "user_id", "event_id", "done").select("event_id", "active"),
    "SELECT event_id, NOT coalesce(max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS active FROM events")
add("turn_budget", lambda s, f: T.context_budget(read(s, f, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("len")), "l_orderkey", "l_linenumber", "len", 100).select("l_linenumber", F.col("budget").cast("long").alias("budget")),
    "WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, max(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY ALL), r AS (SELECT i, sum(q) OVER (PARTITION BY k ORDER BY i) AS s FROM t) SELECT i AS l_linenumber, CAST(greatest(100 - min(s), 0) AS BIGINT) AS budget FROM r GROUP BY i")
add("turn_submission_rewards", lambda s, f: T.submission_rewards(read(s, f, EV), "user_id", "event_id", "value").select("event_id", "reward"), "SELECT event_id, CASE WHEN value > lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0.0 ELSE -0.05 END AS reward FROM events")
add("turn_last_write", lambda s, f: T.last_write(read(s, f, EV).withColumn("key", F.concat_ws("-", "user_id", "event_type")), "key", "value", "event_id").select("key", r9(F.col("value")).alias("value")), "SELECT user_id || '-' || event_type AS key, round(arg_max(value, event_id), 9) + 0.0 AS value FROM events GROUP BY ALL")
add("turn_sticky_routes", lambda s, f: T.sticky_routes(read(s, f, EV), "user_id", "event_id", 4), "WITH f AS (SELECT user_id, min(event_id) AS p FROM events GROUP BY user_id) SELECT user_id, CAST((row_number() OVER (ORDER BY p) - 1) % 4 AS INT) AS server FROM f")
add("turn_adaptive_coefficient", lambda s, f: T.adaptive_coefficient(base(s, f).groupBy("step").agg(F.avg("score").alias("kl"), F.count("*").alias("n")), "step", "kl", "n", 0.001, 0.5, 10_000).select("step", F.round(F.col("coefficient") * 1000, 7).alias("coefficient")),
    f"{BASE}, t AS (SELECT step, avg(score) AS kl, count(*) AS n FROM b GROUP BY step) SELECT step, round(1000 * 0.001 * exp(sum(ln(1 + least(greatest(kl / 0.5 - 1, -0.2), 0.2) * n / 10000)) OVER (ORDER BY step)), 7) AS coefficient FROM t")
add("turn_repair_gate", lambda s, f: T.repair_gate(read(s, f, EV).withColumn("c", F.col("value") / 100), "user_id", "event_id", "c").select("event_id", "repair"),
    "WITH t AS (SELECT event_id, user_id, CAST(coalesce(value / 100, 0.5) < 0.7 AS INT) AS low FROM events) SELECT event_id, low = 1 AND coalesce(sum(low) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS repair FROM t")
add("turn_routes", lambda s, f: read(s, f, "rollouts").where("responses is not null").select("rollout_id", T.route_action(F.col("responses"), F.col("responses").contains("</answer>")).alias("tool")),
    "SELECT rollout_id, CASE WHEN contains(responses, '</answer>') THEN 'finish' WHEN contains(responses, '```sql') THEN 'sql' WHEN contains(responses, '```python') THEN 'python_code' WHEN contains(responses, '<search>') THEN 'search' WHEN contains(responses, '<tool_call>') THEN 'mcp' END AS tool FROM rollouts WHERE responses IS NOT NULL")


# ---- streams: driven to completion over the whole table
def _stream(s, f, make, mode):
    """What the stream gave: an append stream, up to a row for each event, goes to files; the others, a row for each key or window, to the driver."""
    name = f"s{uuid.uuid4().hex}"
    ev = s.readStream.schema(read(s, f, EV).schema).parquet(f"{f}/{EV}[.]parquet").withColumn("ts", F.col("ts").cast("timestamp"))  # as a pattern it may be a file or a folder
    out = make(ev)
    w = out.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{shared_folder(s)}/millrace/{name}").trigger(availableNow=True)
    path = f"{tables_folder(s)}/{name}"
    q = w.format("parquet").start(path) if mode == "append" else w.format("memory").start()
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(path) if mode == "append" else s.table(name)


add("stream_turn_states", lambda s, f: _stream(s, f, T.turn_states, "update").groupBy("user_id").agg(F.max("turns").alias("turns"), F.max("finished").alias("finished")))
add("stream_window_counts", lambda s, f: _stream(s, f, T.windowed_counts, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
add("stream_first_deliveries", lambda s, f: _stream(s, f, lambda e: T.first_deliveries(e, ["event_id", "event_type"], "ts").select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
# ---- sequential operators
SIZED = "WITH q AS (SELECT DISTINCT seq_id, seq_id % 20 AS batch, len(input_ids) AS n FROM sequences WHERE input_ids IS NOT NULL)"


def _parts(s, f, method):
    q = read(s, f, "sequences").where("input_ids is not null").select("seq_id", F.size("input_ids").alias("n")).distinct().withColumn("batch", F.pmod("seq_id", F.lit(20)))
    parts = custom.balanced_parts(q, "batch", "seq_id", "n", 4, method)
    return custom.part_report(parts.join(q, ["batch", "seq_id"]), "batch", "part", "n")


for method, name in (("kk", "balanced"), ("greedy", "greedy")):
    add(f"custom_{name}_parts", lambda s, f, method=method: _parts(s, f, method), f"{SIZED} SELECT batch, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, true AS fair FROM q GROUP BY batch")
#: Questions of a training batch, in the mean; the number of batches follows the table.
BATCH = 128


def _cluster_shares(s, f):
    q = read(s, f, "rl_records").where("uid is not null").groupBy("uid").agg(F.max("extra_info.question").alias("question"))
    batches = max(1, -(-q.count() // BATCH))
    return custom.cluster_shares(q.withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches))), "batch", "uid", "question")


add("custom_cluster_shares", _cluster_shares)
NEGATIVE = "CASE rollout_id % 7 WHEN 0 THEN 'no solution' WHEN 1 THEN 'There is no answer' ELSE pred END"
add("custom_first_match_groups", lambda s, f: custom.first_match_groups(read(s, f, "rollouts").where("uid is not null").selectExpr("uid", "rollout_id", f"{NEGATIVE} AS answer").distinct(), "uid", "rollout_id", "answer"),
    f"""WITH x AS (SELECT DISTINCT uid, rollout_id, {NEGATIVE} AS answer FROM rollouts WHERE uid IS NOT NULL)
    SELECT uid, rollout_id, CASE WHEN contains(lower(answer), 'no ') THEN first_value(answer) OVER (PARTITION BY uid, contains(lower(answer), 'no ') ORDER BY rollout_id, answer) ELSE answer END AS representative FROM x WHERE answer <> ''""")


@F.pandas_udf(DoubleType())
def _repetition(x: pd.Series) -> pd.Series:
    return x.map(lambda t: custom.repetition(t) if t else 0.0)


add("custom_repetition", lambda s, f: read(s, f, "rollouts").where("rollout_id is not null").groupBy("rollout_id").agg(F.max("responses").alias("responses")).select("rollout_id", _repetition("responses").alias("value")))
add("custom_sql_text", lambda s, f: _sql(s, f), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")


def _sql(s, f):
    """A query given as text, run on registered views."""
    view = f"v{uuid.uuid4().hex}"
    read(s, f, "orders").createOrReplaceTempView(view)
    return s.sql(f"SELECT o_orderstatus, count(*) AS n FROM {view} GROUP BY o_orderstatus")


QUERIES, SQL = book.queries, book.sql
