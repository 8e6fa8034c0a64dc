"""Queries of grading, records inside texts, safety, run reports and result comparison, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.advantages import BASE, TOK, base, tokens
from millrace.catalog.base import Book, r9, read
from millrace.functions import answers as A
from millrace.functions import grading as G
from millrace.functions import records as R
from millrace.operators import compare as C
from millrace.operators import metrics as M
from millrace.operators import reports as P

book = Book(globals(), T="responses", pred="pred")
add = book.add
BOXED = f"regexp_extract_all(responses, '{A.BOX}', 1)[-1]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def grep(t: str, p: str, r: str = "", g: bool = True) -> str:
    return f"regexp_replace({t}, {q(p)}, {q(r)}" + (", 'g')" if g else ")")


# ---- normal forms in SQL
def plain_sql(t: str) -> str:
    x = grep(t, r"\n|\\!")
    x = f"replace({x}, {q(chr(92) * 2)}, {q(chr(92))})"
    x = grep(grep(grep(grep(x, "[td]frac", "frac"), r"\\(?:left|right)"), r"\^(?:\{\\circ\}|\\circ)"), r"\\\$")
    unit = "\\text{ "
    x = f"list_transform([{x}], lambda u: CASE WHEN len(string_split(u, {q(unit)})) = 2 THEN string_split(u, {q(unit)})[1] ELSE u END)[1]"
    x = grep(grep(grep(x, r"\\?%"), r"([ {])\.", r"\10."), r"^\.", "0.")
    x = grep(grep(x, r"(?s)^[^=]{1,2}=([^=]*)$", r"\1"), r"\\sqrt([0-9a-z])", r"\\sqrt{\1}")
    x = f"replace({x}, ' ', '')"
    x = grep(grep(x, r"\\frac([0-9a-z])\{", r"\\frac{\1}{"), r"\\frac([0-9a-z])([0-9a-z])", r"\\frac{\1}{\2}")
    return grep(grep(x, r"^0\.5$", r"\\frac{1}{2}"), r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{\1}{\2}")


def final_sql(t: str) -> str:
    x = f"string_split({t}, '=')[-1]"
    for a, b in G.FINAL_REPLACED + [(e, "") for e in G.FINAL_DROPPED]:
        x = f"replace({x}, {q(a)}, {q(b)})"
    for p, r in G.FINAL_PATTERNS:
        x = grep(x, p, r.replace("\\$", "§").replace("$", "\\").replace("§", "$"))
    x = f"replace({x}, '$', '')"
    return f"list_transform([{x}], lambda u: regexp_replace(CASE WHEN regexp_full_match(replace(u, ',', ''), '[0-9]+') THEN replace(u, ',', '') ELSE u END, '^\\s+|\\s+$', '', 'g'))[1]"


LINE = r"coalesce(regexp_extract_all({t}, '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]')"
book.column("grade_final_form", "rollouts", "rollout_id", lambda: G.final_form(A.answer_line(T)), final_sql(LINE.format(t="responses")))
book.column("grade_final_line", "rollouts", "rollout_id", lambda: G.final_line_score(T, pred)["score"], f"CASE WHEN coalesce({final_sql(LINE.format(t='right(responses, 300)'))} = {final_sql('pred')}, false) THEN 1.0 ELSE -1.0 END")
book.column("grade_strict_box", "rollouts", "rollout_id", lambda: G.strict_box_score(T, pred)["score"], f"CASE WHEN coalesce({BOXED.replace('responses', 'right(responses, 100)')} = pred, false) THEN 1 ELSE -1 END")
book.column("grade_tool_turns", "rollouts", "rollout_id", lambda: r9(G.tool_turn_score(T, pred, F.col("step") % 6)), f"CASE WHEN coalesce({BOXED.replace('responses', 'right(responses, 100)')} = pred, false) THEN 1.0 ELSE round(least(0.0, -1.0 + (step % 6 - 2) / 2 * 0.1), 9) + 0.0 END")
book.column("grade_latex_plain", "rollouts", "rollout_id", lambda: A.latex_plain(F.coalesce(A.boxed_last(T), pred)), plain_sql(f"coalesce({BOXED}, pred)"))
book.column("grade_latex_equal", "rollouts", "rollout_id", lambda: A.latex_equal(A.boxed_last(T), pred), f"CASE WHEN {BOXED} IS NULL AND pred IS NULL THEN true WHEN {BOXED} IS NULL OR pred IS NULL THEN false ELSE {plain_sql(BOXED)} = {plain_sql('pred')} END")
book.column("grade_geometry", "rollouts", "rollout_id", lambda: r9(G.geometry_score(T, pred, A.think_box_format(T))), rf"round(0.9 * CAST(coalesce({plain_sql(BOXED)} = {plain_sql('pred')}, false) AS DOUBLE) + 0.1 * CAST(regexp_matches(responses, '(?s)^<think>.*</think>.*\\boxed\{{.*\}}.*$') AS DOUBLE), 9) + 0.0")
book.column("grade_choice", "rollouts", "rollout_id", lambda: G.choice_score(T, pred), r"CAST(coalesce(upper(regexp_extract(responses, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1)) = pred, false) AS DOUBLE)")
book.column("grade_count", "rollouts", "rollout_id", lambda: G.count_score(T, pred), f"CAST(coalesce({BOXED} = pred, false) AS INT)")

# ---- numbers and elements in SQL
NUM = r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*"


def number_sql(t: str) -> str:
    bare = f"replace(replace({t}, '{{,}}', ''), ',', '')"
    return f"CASE WHEN regexp_full_match({bare}, {q(NUM)}) THEN TRY_CAST(trim({bare}) AS DOUBLE) END"


def amount_sql(t: str) -> str:
    x = f"CASE WHEN regexp_matches({t}, '^\\$[0-9]') THEN substr({t}, 2) ELSE {t} END"
    return f"list_transform([{x}], lambda v: CASE WHEN regexp_matches(v, '^[0-9]+(\\.[0-9]+)?\\\\?%$') THEN regexp_replace(v, '[\\\\%]', '', 'g') ELSE v END)[1]"


def close_sql(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 1e-4 * greatest(abs({a}), abs({b}))"


def one_sql(a: str, b: str) -> str:
    """Of two columns that are trimmed and without signs of amounts."""
    x, y = number_sql(a), number_sql(b)
    return f"(lower({a}) = lower({b}) OR replace({a}, ' ', '') = replace({b}, ' ', '') OR coalesce({close_sql(x, y)} OR {close_sql(x, f'({y}) / 100')} OR {close_sql(x, f'({y}) * 100')}, translate({a}, '(){{}}', '') = translate({b}, '(){{}}', '') AND {a} <> ''))"


#: Answers written in other ways: a percentage, a dollar amount, a tuple, a number with another last digit.
ODD = "CASE rollout_id % 6 WHEN 0 THEN pred || '%' WHEN 1 THEN '$' || pred WHEN 2 THEN '(' || pred || ', 1.0)' WHEN 3 THEN '0' || pred WHEN 4 THEN pred || ' ' ELSE coalesce(pred, '') || '1' END"
GOLD = "CASE WHEN rollout_id % 6 = 2 THEN '(' || pred || ',1)' ELSE pred END"


def odd(spark, sf):
    return read(spark, sf, "rollouts").selectExpr("rollout_id", f"{ODD} AS a", f"{GOLD} AS b")


ODDS = f"WITH o AS (SELECT rollout_id, {ODD} AS a, {GOLD} AS b FROM rollouts), x AS (SELECT rollout_id, a, b, {amount_sql('trim(a)')} AS p, {amount_sql('trim(b)')} AS t FROM o)"
PARTS = "string_split(regexp_replace(trim({x}), '^[(\\[]|[)\\]]$', '', 'g'), ',')"
add("grade_math_equal", lambda s, f: odd(s, f).select("rollout_id", G.math_equal(F.col("a"), F.col("b")).alias("value")),
    f"""{ODDS}, y AS (SELECT *, list_transform({PARTS.format(x='a')}, lambda e: trim(e)) AS pa, list_transform({PARTS.format(x='b')}, lambda e: trim(e)) AS pb FROM x)
    SELECT rollout_id, coalesce({one_sql('p', 't')} OR (rollout_id % 6 = 2 AND len(pa) = len(pb) AND {one_sql('pa[1]', 'pb[1]')} AND {one_sql('pa[2]', 'pb[2]')}), false) AS value FROM y""")
add("grade_answers", lambda s, f: odd(s, f).where("rollout_id % 6 <> 2").select("rollout_id", G.grade(F.col("a"), F.col("b")).alias("value")),
    f"""WITH o AS (SELECT rollout_id, {ODD} AS a, {GOLD} AS b FROM rollouts WHERE rollout_id % 6 <> 2), x AS (SELECT rollout_id, {plain_sql('trim(a)')} AS a, {plain_sql('trim(b)')} AS b FROM o),
    n AS (SELECT *, {number_sql('a')} AS na, {number_sql('b')} AS nb FROM x)
    SELECT rollout_id, coalesce(a = b OR (a <> '' AND coalesce(na = round(na), false) = coalesce(nb = round(nb), false) AND coalesce(na = nb, false)), false) AS value FROM n""")
add("grade_elements", lambda s, f: odd(s, f).select("rollout_id", F.array_join(G.elements(F.col("a")), "|").alias("value")), f"""WITH o AS (SELECT rollout_id, {ODD} AS a FROM rollouts)
    SELECT rollout_id, CASE WHEN rollout_id % 6 = 2 THEN array_to_string(list_transform(string_split(substr(a, 2, length(a) - 2), ','), lambda e: trim(e)), '|') ELSE a END AS value FROM o""")
add("grade_number_match", lambda s, f: read(s, f, "rollouts").select("rollout_id", A.number_match(F.col("pred"), F.format_number(F.col("score") * 0 + F.col("rollout_id") % 9, 1)).alias("value")),
    r"SELECT rollout_id, coalesce(abs(CAST(nullif(regexp_extract(replace(trim(pred), ',', ''), '-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?'), '') AS DOUBLE) - rollout_id % 9) / CASE WHEN rollout_id % 9 = 0 THEN 1 ELSE rollout_id % 9 END < 1e-5, false) AND score IS NOT NULL AS value FROM rollouts")
add("grade_fuzzy_accuracy", lambda s, f: M.accuracy(base(s, f).join(read(s, f, "rollouts").select(F.col("rollout_id").alias("rid"), "responses", "pred").distinct(), "rid").where("pred is not null and responses is not null"), G.fuzzy_match(F.coalesce(A.boxed_last(T), F.lit("")), pred), ["data_source"]).select("data_source", "total"),
    f"{BASE} SELECT b.data_source, count(*) AS total FROM b JOIN (SELECT DISTINCT rollout_id, responses, pred FROM rollouts WHERE pred IS NOT NULL AND responses IS NOT NULL) ON rollout_id = rid GROUP BY 1")
SCORERS = ["arith_word", "geo_figures", "code_math"]
add("grade_by_source", lambda s, f: read(s, f, "rollouts").select("rollout_id", G.score_by_source(F.col("data_source"), {"arith_word": A.latex_equal(A.hash_answer(T), pred).cast("double"), "geo_figures": G.box_score(T, pred), "code_math": F.lit(1.0) * G.count_score(T, pred)}, F.lit(-1.0)).alias("value")),
    f"""SELECT rollout_id, CASE data_source WHEN 'arith_word' THEN CAST(CASE WHEN h IS NULL AND pred IS NULL THEN true WHEN h IS NULL OR pred IS NULL THEN false ELSE {plain_sql('h')} = {plain_sql('pred')} END AS DOUBLE)
      WHEN 'geo_figures' THEN CAST(coalesce({plain_sql(BOXED)} = {plain_sql('pred')}, false) AS DOUBLE) WHEN 'code_math' THEN CAST(coalesce({BOXED} = pred, false) AS DOUBLE) ELSE -1.0 END AS value
    FROM (SELECT *, regexp_replace(regexp_extract_all(responses, '#### (-?[0-9.,$]*[0-9])', 1)[-1], '[,$]', '', 'g') AS h FROM rollouts)""")
add("grade_best_of_gold", lambda s, f: base(s, f).select("rid", G.best_of_gold(F.array(F.col("score") - 0.5, -F.col("score"))).alias("value")), f"{BASE} SELECT rid, greatest(0.0, score - 0.5, -score) AS value FROM b")
add("grade_output_equal", lambda s, f: read(s, f, "tool_outputs").select("output_id", G.output_equal(F.col("result"), F.concat(F.lit("  "), F.regexp_replace("result", " ", "  "))).alias("value")),
    r"SELECT output_id, coalesce(list_filter(regexp_split_to_array(result, '\s+'), lambda w: w <> '') = list_filter(regexp_split_to_array('  ' || replace(result, ' ', '  '), '\s+'), lambda w: w <> ''), false) AS value FROM tool_outputs")
add("reward_penalties", lambda s, f: base(s, f).select("rid", G.penalty(short=(F.col("length") < 200, -0.5), no_tool=(F.col("n_actions") == 0, -0.25)).alias("value")), f"{BASE} SELECT rid, CASE WHEN length < 200 THEN -0.5 ELSE 0.0 END + CASE WHEN n_actions = 0 THEN -0.25 ELSE 0.0 END AS value FROM b")

# ---- records inside texts
OBJ = r"regexp_extract_all(record, '(?s)\{{[^{{}}]*\"{k}\"[^{{}}]*\}}')"
TJ = "SELECT trajectory_id, record FROM trajectories"
VALID = "json_valid({x}) AND list_has_all(json_keys({x}), [" + ", ".join(q(k) for k in R.VERIFICATION_KEYS) + "])"


def record(name: str, make, sql: str) -> None:
    add(f"record_{name}", lambda s, f: read(s, f, "trajectories").select("trajectory_id", make().alias("value")), f"SELECT trajectory_id, {sql} AS value FROM trajectories")


rec = lambda: F.col("record")
record("verification", lambda: R.verification(rec())["critique"].isNotNull(), f"list_transform([{OBJ.format(k='step_index')}[-1]], lambda x: x IS NOT NULL AND coalesce({VALID.format(x='x')}, false) AND json_extract_string(x, '$.critique') IS NOT NULL)[1]")
record("verification_format", lambda: R.verification_format(rec())["is_valid"], f"list_transform([{OBJ.format(k='step_index')}[1]], lambda x: x IS NOT NULL AND coalesce({VALID.format(x='x')}, false))[1]")
record("repair", lambda: R.repair(rec())["action"], f"list_transform([{OBJ.format(k='action')}[-1]], lambda x: CASE WHEN json_valid(x) AND json_extract_string(x, '$.action') IN ('PATCH', 'NO_CHANGE') THEN json_extract_string(x, '$.action') END)[1]")
record("repair_format", lambda: R.repair_format(rec())["valid_action"], f"list_transform([{OBJ.format(k='action')}[1]], lambda x: coalesce(json_valid(x) AND json_extract_string(x, '$.action') IN ('PATCH', 'NO_CHANGE'), false))[1]")
record("tool_calls", lambda: F.array_join(F.transform(R.tool_calls(rec()), lambda c: c["tool_name"]), "|"), f"array_to_string(list_transform(list_filter({OBJ.format(k='tool_name')}, lambda x: json_valid(x) AND list_contains(json_keys(x), 'tool_name')), lambda x: json_extract_string(x, '$.tool_name')), '|')")
STEPS = r"regexp_extract_all(responses, '(?is)<think>.*?</think>')"
add("record_steps", lambda s, f: read(s, f, "rollouts").where("responses is not null").select("rollout_id", F.size(R.steps_with_calls(T)).alias("n"), F.try_element_at(F.transform(R.steps_with_calls(T), lambda x: x["reasoning"]), F.lit(1)).alias("first")),
    rf"SELECT rollout_id, CAST(len({STEPS}) AS INT) AS n, regexp_replace(regexp_extract_all(responses, '(?is)<think>(.*?)</think>', 1)[1], '^\s+|\s+$', '', 'g') AS first FROM rollouts WHERE responses IS NOT NULL")
TAGGED = "responses || '<tool_call> {\"name\": \"sql\", \"arguments\": ' || rollout_id || '}</tool_call>' || '<tool_call>{\"name\": </tool_call>'"
add("record_tagged_calls", lambda s, f: read(s, f, "rollouts").where("responses is not null").selectExpr("rollout_id", f"{TAGGED} AS responses").select("rollout_id", F.array_join(F.transform(R.tagged_calls(T), lambda c: F.concat_ws(":", c["name"], c["arguments"])), "|").alias("value"), F.length(R.untagged(T)).alias("rest")),
    "SELECT rollout_id, 'sql:' || rollout_id AS value, CAST(length(responses) AS INT) AS rest FROM rollouts WHERE responses IS NOT NULL")
add("record_interpreter", lambda s, f: read(s, f, "rollouts").where("responses is not null").select("rollout_id", R.before_and_after(F.concat(T, F.lit("<interpreter> 4 </interpreter>tail"))).alias("x")).select("rollout_id", "x.inside", "x.rest"), "SELECT rollout_id, '4' AS inside, 'tail' AS rest FROM rollouts WHERE responses IS NOT NULL")
add("record_sql_solution", lambda s, f: read(s, f, "rollouts").where("responses is not null").select("rollout_id", R.sql_solution(F.concat(T, F.lit("<solution> SELECT 1 </solution>")), F.array(T)).alias("x")).select("rollout_id", "x.valid", "x.sql"),
    r"SELECT rollout_id, regexp_matches(responses, '(?s)^\s*<think>.*?</think>') AS valid, 'SELECT 1' AS sql FROM rollouts WHERE responses IS NOT NULL")
add("record_passages", lambda s, f: read(s, f, "documents").where("text is not null and source is not null").groupBy("source").agg(F.min_by(F.struct("site", "text"), "doc_id").alias("a"), F.max_by(F.struct("site", "text"), "doc_id").alias("b")).select("source", A.passages_to_text(F.array(F.coalesce("a.site", F.lit("")), F.coalesce("b.site", F.lit(""))), F.array("a.text", "b.text")).alias("value")),
    "WITH d AS (SELECT source, arg_min(coalesce(site, ''), doc_id) AS s, arg_min(text, doc_id) AS t, arg_max(coalesce(site, ''), doc_id) AS u, arg_max(text, doc_id) AS v FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source) SELECT source, 'Doc 1(Title: ' || s || ') ' || t || chr(10) || 'Doc 2(Title: ' || u || ') ' || v || chr(10) AS value FROM d")

# ---- safety
SAFE = "true"
for lang, parts in R.UNSAFE.items():
    SAFE = f"CASE WHEN lang = {q(lang)} THEN NOT (" + " OR ".join(f"contains(code, {q(p)})" for p in parts) + f") ELSE {SAFE} END"
CODE = "coalesce(result, '') || CASE output_id % 5 WHEN 0 THEN ' import socket' WHEN 1 THEN ' fs.write' WHEN 2 THEN ' system(' ELSE '' END AS code, CASE output_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'cpp' ELSE 'go' END AS lang"
add("safety_code", lambda s, f: read(s, f, "tool_outputs").selectExpr("output_id", *[x.strip() for x in CODE.replace("END AS code,", "END AS code§").split("§")]).select("output_id", R.is_safe(F.col("code"), F.upper("lang")).alias("value")), f"SELECT output_id, {SAFE} AS value FROM (SELECT output_id, {CODE} FROM tool_outputs)")
COMMAND = "coalesce(result, '') || CASE output_id % 4 WHEN 0 THEN ' SUDO ls' WHEN 1 THEN ' chmod  777 x' WHEN 2 THEN ' echo > /etc/hosts' ELSE '' END"
FOUND = "coalesce(" + ", ".join(f"CASE WHEN len(regexp_extract_all(c, {q(p)})) > 0 THEN regexp_extract_all(c, {q(p)}) END" for p in R.REFUSED_PATTERNS) + ", [])"
add("safety_commands", lambda s, f: read(s, f, "tool_outputs").selectExpr("output_id", f"{COMMAND} AS c").select("output_id", F.array_join(R.refused_commands(F.col("c")), "|").alias("value")),
    f"SELECT output_id, array_to_string(CASE WHEN len(p) > 0 THEN [p[1]] ELSE {FOUND} END, '|') AS value FROM (SELECT output_id, c, list_filter([{', '.join(map(q, R.REFUSED_PARTS))}], lambda x: contains(c, x)) AS p FROM (SELECT output_id, lower({COMMAND}) AS c FROM tool_outputs))")

# ---- reports
STAGE = "SELECT tool_name AS stage, sum(execution_time_ms) / 1000 AS seconds FROM (SELECT DISTINCT output_id, tool_name, execution_time_ms FROM tool_outputs WHERE execution_time_ms >= 0) GROUP BY 1"


def stages(s, f):
    return read(s, f, "tool_outputs").where("execution_time_ms >= 0").select("output_id", "tool_name", "execution_time_ms").distinct().select(F.col("tool_name").alias("stage"), (F.col("execution_time_ms") / 1000).alias("seconds"))


add("report_timing", lambda s, f: P.timing(stages(s, f), 1_000, 5_000, ("python_code",), ("sql", "calculator")).select("stage", F.round("seconds", 6).alias("seconds"), F.round("ms_per_token", 6).alias("ms_per_token")),
    f"SELECT stage, round(seconds, 6) AS seconds, round(seconds * 1000 / CASE WHEN stage = 'python_code' THEN 1000 WHEN stage IN ('sql', 'calculator') THEN 5000 END, 6) AS ms_per_token FROM ({STAGE})")
add("report_throughput", lambda s, f: P.throughput(tokens(s, f), M.mask_count(F.col("m")), 2.0, 8).select("tokens", "seconds", r9(F.col("per_second_worker")).alias("per_second_worker")), f"{TOK} SELECT CAST(sum(list_sum(m)) AS BIGINT) AS tokens, 2.0::DOUBLE AS seconds, round(sum(list_sum(m)) / 16, 9) AS per_second_worker FROM s")
STAT = "SELECT {n} AS name, round({mean}, 6) AS mean, round(CAST({most} AS DOUBLE), 6) AS most, round(CAST({least} AS DOUBLE), 6) AS least"
add("report_batch_statistics", lambda s, f: P.batch_statistics(tokens(s, f), ["r", "v", "absent"], "m", ["r"]).select("name", *[F.round(c, 6).alias(c) for c in ("mean", "most", "least")]),
    f"{TOK}, e AS (SELECT unnest(r) AS r, unnest(v) AS v, unnest(m) AS m FROM s) SELECT 'length' AS name, round(avg(list_sum(m)), 6) AS mean, round(CAST(max(list_sum(m)) AS DOUBLE), 6) AS most, round(CAST(min(list_sum(m)) AS DOUBLE), 6) AS least FROM s"
    + "".join(f" UNION ALL SELECT '{c}', round(avg({c}), 6), round(max({c}), 6), round(min({c}), 6) FROM e WHERE m = 1" for c in "rv") + " UNION ALL SELECT 'r_sum', round(avg(list_sum(r)), 6), round(max(list_sum(r)), 6), round(min(list_sum(r)), 6) FROM s")
add("report_part_balance", lambda s, f: P.part_balance(base(s, f).withColumn("part", F.col("rid") % 8), "part", "length", ["data_source"]).select("data_source", "least", "most", "gap", r9(F.col("mean")).alias("mean")),
    f"{BASE}, t AS (SELECT data_source, rid % 8 AS part, sum(length) AS t FROM b GROUP BY ALL) SELECT data_source, CAST(min(t) AS BIGINT) AS least, CAST(max(t) AS BIGINT) AS most, CAST(max(t) - min(t) AS BIGINT) AS gap, round(avg(t), 9) + 0.0 AS mean FROM t GROUP BY data_source")
add("report_repair_rate", lambda s, f: P.ratio_of_sums(base(s, f), F.col("rid") % 3, F.col("n_actions"), ["data_source"]).select("data_source", r9(F.col("rate")).alias("rate")), f"{BASE} SELECT data_source, round(CASE WHEN sum(n_actions) <> 0 THEN sum(rid % 3) / sum(n_actions) ELSE 0.0 END, 9) + 0.0 AS rate FROM b GROUP BY data_source")
add("report_average_steps", lambda s, f: P.mean_or_zero(read(s, f, "rollouts").where("responses is not null"), A.n_steps(T), ["data_source"]).select("data_source", r9(F.col("mean")).alias("mean")), "SELECT data_source, round(avg(greatest(len(regexp_extract_all(responses, '(?s)<think>(.*?)</think>', 1)), 1)), 9) + 0.0 AS mean FROM rollouts WHERE responses IS NOT NULL GROUP BY data_source")
add("report_completion_rate", lambda s, f: P.mean_or_zero(base(s, f), F.col("score") > 0.5).select(r9(F.col("mean")).alias("mean")), f"{BASE} SELECT round(avg(CAST(score > 0.5 AS DOUBLE)), 9) + 0.0 AS mean FROM b")
BY_STEP = ", k AS (SELECT step, count(*) FILTER (WHERE score > 0.5) AS kept FROM b GROUP BY step)"
add("report_accumulate", lambda s, f: P.accumulate(_steps(s, f), "step", "kept", 500), f"""WITH b AS (SELECT DISTINCT rollout_id, step, score FROM rollouts WHERE step IS NOT NULL){BY_STEP}, c AS (SELECT *, sum(kept) OVER (ORDER BY step) AS c FROM k)
    SELECT step, kept, CAST(least(kept, 500 - (c - kept)) AS BIGINT) AS taken FROM c WHERE c - kept < 500""")


def _steps(s, f):
    return read(s, f, "rollouts").where("step is not null").select("rollout_id", "step", "score").distinct().groupBy("step").agg(F.count_if(F.col("score") > 0.5).alias("kept"))


LP = "list_transform(ids, lambda x: -((x % 13) / 4.0))"
OLD = "list_transform(ids, lambda x: -((x % 17) / 4.0))"
ADV = "list_transform(ids, lambda x: (x % 7) - 3.0)"


def clipped(s, f):
    t = tokens(s, f)
    i = F.col("ids")
    t = t.select("seq_id", "m", F.transform(i, lambda x: -((x % 13) / 4.0)).alias("l"), F.transform(i, lambda x: -((x % 17) / 4.0)).alias("o"), F.transform(i, lambda x: (x % 7) - 3.0).alias("a"))
    return P.covariance_clip(t, "seq_id", "l", "o", "a", "m", ratio=0.002).agg(F.count("*").alias("n"), F.count_distinct("seq_id", "place").alias("places"))


add("loss_covariance_clip", clipped,
    f"""{TOK}, e AS (SELECT seq_id, unnest({LP}) AS l, unnest({OLD}) AS o, unnest({ADV}) AS a, unnest(m) AS m FROM s), k AS (SELECT * FROM e WHERE m = 1), g AS (SELECT avg(a) AS ma, avg(l) AS ml, count(*) AS n FROM k),
    c AS (SELECT count(*) AS c FROM k, g WHERE -a * greatest(0.8, least(1.2, exp(l - o))) <= -a * exp(l - o) AND (a - ma) * (l - ml) > 1 AND (a - ma) * (l - ml) < 5)
    SELECT least(c, greatest(CAST(floor(n * 0.002) AS BIGINT), 1)) AS n, least(c, greatest(CAST(floor(n * 0.002) AS BIGINT), 1)) AS places FROM c, g""")


# ---- result comparison
def _compared(s, f):
    a = read(s, f, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))
    cases = {
        "columns in another order": a.select("n", "l_linestatus", "most", "l_returnflag"), "one row twice": a.unionByName(a.limit(1)), "a value changed": a.withColumn("n", F.col("n") + (F.col("l_linestatus") == "O").cast("int")),
        "numbers of another type": a.withColumn("n", F.col("n").cast("double")), "a column less": a.drop("most"), "flags exchanged": a.select(F.col("l_linestatus").alias("l_returnflag"), F.col("l_returnflag").alias("l_linestatus"), "most", "n"),
    }
    return s.createDataFrame([(k, C.results_equal(a, b)) for k, b in cases.items()], "name string, equal boolean")


add("compare_results", _compared, "SELECT * FROM (VALUES ('columns in another order', true), ('one row twice', false), ('a value changed', false), ('numbers of another type', true), ('a column less', false), ('flags exchanged', true)) AS t(name, equal)")

QUERIES, SQL = book.queries, book.sql
