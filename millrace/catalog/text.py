"""Queries of text extraction and comparison, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import Book, r9, read
from millrace.functions import answers as A

book = Book(globals(), T="responses")
R, K = "rollouts", "rollout_id"


def col(name: str, make, sql: str, table: str = R, key: str = K, where: str | None = None) -> None:
    book.column(f"text_{name}", table, key, make, sql, where)


def _all(p: str, g: int = 1, t: str = "responses") -> str:
    return f"regexp_extract_all({t}, '{p}', {g})"


BOX = A.BOX
col("boxed_all", lambda: F.array_join(A.boxed_all(T), "|"), f"array_to_string({_all(BOX)}, '|')")
col("boxed_last", lambda: A.boxed_last(T), f"{_all(BOX)}[-1]")
col("hash_answer", lambda: A.hash_answer(T), "regexp_replace(regexp_extract_all(responses, '#### (-?[0-9.,$]*[0-9])', 1)[-1], '[,$]', '', 'g')")
col("hash_answer_first", lambda: A.hash_answer_first(T), "replace(regexp_extract_all(responses, '#### (-?[0-9.,]+)', 1)[1], ',', '')")
col("number_flexible", lambda: A.number_flexible(T), """coalesce(list_filter(regexp_extract_all(responses, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1], regexp_extract_all(responses, '(-?[0-9.,]+)', 1)[1])""")
col("answer_tag", lambda: A.tagged_last(T, "answer"), r"regexp_replace(regexp_extract_all(responses, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\s+|\s+$', '', 'g')")
col("answer_tags_open", lambda: A.answer_tags(T)["opening"].cast("long"), "len(regexp_extract_all(responses, '<answer>'))")
col("answer_tags_close", lambda: A.answer_tags(T)["closing"].cast("long"), "len(regexp_extract_all(responses, '</answer>'))")
col("answer_line", lambda: A.answer_line(T), r"coalesce(regexp_extract_all(responses, '(?i)Answer\s*:\s*([^\n]+)', 1)[-1], '[INVALID]')")
col("choice_letter", lambda: A.choice_letter(T), r"upper(regexp_extract(responses, '(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?', 1))")
col("final_answer", lambda: A.final_answer(T), r"coalesce(trim(regexp_extract_all(responses, 'FINAL_ANSWER:\s*([^\n]+)', 1)[-1]), regexp_extract_all(responses, '\\boxed\{([^{}]*)\}', 1)[-1], trim(string_split(trim(responses, ' '), chr(10))[-1], ' '))")
col("confidence", lambda: A.confidence(T, 0.5), r"(SELECT CASE WHEN x IS NULL THEN 0.5 WHEN x < 0 THEN 0.0 WHEN x > 1 THEN 1.0 ELSE x END FROM (SELECT TRY_CAST(regexp_extract_all(responses, 'CONFIDENCE:\s*(-?[0-9]*\.?[0-9]+)', 1)[-1] AS DOUBLE) AS x))")
col("think_blocks", lambda: F.array_join(A.think_blocks(T), "|"), "array_to_string(regexp_extract_all(responses, '(?s)<think>(.*?)</think>', 1), '|')")
col("n_steps", lambda: A.n_steps(T).cast("long"), "greatest(len(regexp_extract_all(responses, '(?s)<think>(.*?)</think>', 1)), 1)", where="responses IS NOT NULL")
col("code_blocks", lambda: F.array_join(A.code_blocks(T), "|"), r"array_to_string(list_filter(list_transform(regexp_extract_all(responses, '(?s)```(?:python)?\n(.*?)```', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')", where="responses IS NOT NULL")
col("sql_text", lambda: A.sql_text(T), r"replace(replace(replace(regexp_replace(coalesce(regexp_extract_all(responses, '(?s)```sql\s*(.*?)```', 1)[-1], regexp_extract_all(responses, '(?s)<sql>(.*?)</sql>', 1)[-1], regexp_extract_all(responses, '(?s)<solution>(.*?)</solution>', 1)[-1], responses), '^\s+|\s+$', '', 'g'), '> =', '>='), '< =', '<='), '! =', '!=')")
col("current_year", lambda: A.current_year(F.concat(T, F.lit(" YEAR(CURDATE())"))), r"regexp_replace(responses || ' YEAR(CURDATE())', '(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)', '2020', 'g')")
_PUNCT = "regexp_replace({t}, '[[:punct:]]', '', 'g')"
_PLAIN = r"array_to_string(list_filter(regexp_split_to_array(" + _PUNCT.format(t="lower({t})") + r", '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _plain(t: str) -> str:
    return _PLAIN.replace("{t}", t)


ascii_only = r"regexp_full_match(responses, '[\x00-\x7F]*')"
col("without_punctuation", lambda: A.without_punctuation(T), _PUNCT.format(t="responses"))
col("plain_answer", lambda: A.plain_answer(T), _plain("responses"))
book.column("text_exact_any", R, K, lambda: A.exact_any(F.coalesce(A.boxed_last(T), F.lit("")), F.array("pred", F.lit("none"))).cast("int"), f"CAST(coalesce({_plain(f'coalesce({_all(BOX)}[-1], {chr(39)*2})')} = {_plain('pred')}, false) OR {_plain(f'coalesce({_all(BOX)}[-1], {chr(39)*2})')} = 'none' AS INT)", "pred IS NOT NULL")
book.column("text_contains_any", R, K, lambda: A.contains_any(T, F.array("pred")).cast("int"), f"CAST(contains({_plain('responses')}, {_plain('pred')}) AS INT)", "pred IS NOT NULL AND responses IS NOT NULL")
col("mend_fractions", lambda: A.mend_fractions(T), r"regexp_replace(regexp_replace(responses, '\\frac([0-9a-z])\{', '\\frac{\1}{', 'g'), '\\frac([0-9a-z])([0-9a-z])', '\\frac{\1}{\2}', 'g')")
book.column("text_mend_slash", "tool_outputs", "output_id", lambda: A.mend_slash(F.col("result")), r"regexp_replace(result, '^(-?[0-9]+)/(-?[0-9]+)$', '\\frac{\1}{\2}', 'g')")
col("mend_roots", lambda: A.mend_roots(F.concat(F.lit("\\sqrt"), T)), r"regexp_replace('\sqrt' || responses, '\\sqrt([0-9a-z])', '\\sqrt{\1}', 'g')")
col("without_units", lambda: A.without_units(F.concat(T, F.lit("\\text{ cm}"))), r"CASE WHEN len(regexp_extract_all(responses || '\text{ cm}', '\\text\{ ')) = 1 THEN string_split(responses || '\text{ cm}', '\text{ ')[1] ELSE responses || '\text{ cm}' END")
col("key", lambda: A.answer_key(F.col("pred")), r"regexp_replace(trim(regexp_replace(replace(trim(lower(pred)), '$', ''), '\s+', ' ', 'g')), '[.,;:]+$', '', 'g')")
book.column("text_number_in", "tool_outputs", "output_id", lambda: r9(A.number_in(F.col("result"))), r"""round(CASE
  WHEN regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*%', 1) <> '' THEN CAST(regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*%', 1) AS DOUBLE) / 100.0 END, 9)""".replace("round(CASE", "(SELECT round(CASE").replace("END, 9)", r"""WHEN regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*/\s*(-?[0-9]+\.?[0-9]*)', 2) <> '' AND coalesce(TRY_CAST(regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*/\s*(-?[0-9]+\.?[0-9]*)', 2) AS DOUBLE), 0) <> 0
    THEN TRY_CAST(regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*/\s*(-?[0-9]+\.?[0-9]*)', 1) AS DOUBLE) / TRY_CAST(regexp_extract(t, '(-?[0-9]+\.?[0-9]*)\s*/\s*(-?[0-9]+\.?[0-9]*)', 2) AS DOUBLE)
  WHEN regexp_extract(t, '-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?') <> '' THEN CAST(regexp_extract(t, '-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?') AS DOUBLE) END, 9) FROM (SELECT replace(trim(result), ',', '') AS t))"""), "tool_name = 'calculator'")
col("think_box_format", lambda: A.think_box_format(T), r"CAST(regexp_matches(responses, '(?s)^<think>.*</think>.*\\boxed\{.*\}.*$') AS DOUBLE)")
col("closes_think", lambda: A.closes_think(T), "CAST(contains(responses, '</think>') AS INT)")
col("solver_format", lambda: A.solver_format(T), r"regexp_matches(responses, '(?s)<think>.*</think>') AND regexp_matches(responses, 'CONFIDENCE:\s*[0-9.]+') AND contains(responses, 'FINAL_ANSWER:')")
_BAD = " OR ".join(f"contains(responses, '{w} {m}')" for m in A.FORBIDDEN_MODULES for w in ("import", "from")) + " OR " + " OR ".join(f"contains(responses, '{m}')" for m in A.FORBIDDEN_CALLS)
col("forbidden_code", lambda: A.has_forbidden_code(T), f"({_BAD})")
col("tool_reward", lambda: r9(A.tool_reward(T)), "round(least(len(regexp_extract_all(responses, '```output')), 4) * 0.05, 9)", where="responses IS NOT NULL")
book.column("text_is_provable", R, K, lambda: A.is_provable(F.col("prompts"), T), "NOT (contains(prompts, '证明') OR contains(lower(prompts), 'box') OR contains(lower(responses), 'text'))")
for _w in A.REFLECTION:
    book.column(f"text_reflection_{_w.replace(' ', '_')}", "documents", "doc_id", lambda w=_w: F.element_at(A.reflection_counts(F.col("text")), w).cast("long"), rf"len(regexp_extract_all(lower(text), '\b{_w}\b'))", "text IS NOT NULL")
book.column("text_sha256", R, K, lambda: F.sha2(T, 256), "sha256(responses)")
book.column("text_md5", R, K, lambda: F.md5(T), "md5(responses)")
book.column("text_match_answer_pred", R, K, lambda: A.key_match(F.coalesce(A.boxed_last(T), F.lit("")), F.col("pred")), f"coalesce({_all(BOX)}[-1] <> '' AND pred <> '' AND lower(trim({_all(BOX)}[-1])) = lower(trim(pred)), false)", "coalesce(pred, '0') NOT LIKE '%.%'")


def _set_f1(spark, sf):
    return read(spark, sf, R).where("prompts IS NOT NULL AND responses IS NOT NULL").select(K, r9(A.set_f1(A.token_set(F.col("prompts")), A.token_set(T))).alias("value"))


_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(" + _PUNCT.format(t="{t}") + r"), '\s+'), lambda x: x <> ''))"
book.add("text_set_f1", _set_f1, f"""WITH t AS (SELECT rollout_id, {_TOK.replace('{t}', 'prompts')} AS a, {_TOK.replace('{t}', 'responses')} AS b FROM rollouts WHERE prompts IS NOT NULL AND responses IS NOT NULL),
  n AS (SELECT rollout_id, a, b, len(list_intersect(a, b)) AS n FROM t)
  SELECT rollout_id, round(CASE WHEN n > 0 THEN 2.0 * n / (len(a) + len(b)) ELSE 0.0 END, 9) AS value FROM n""")

QUERIES, SQL = book.queries, book.sql
