"""Queries of the operators in millrace.llm, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, mixing, neardup, packing, pairs, residue, truncation


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.broken_pairs(_read(spark, sf, "rollouts")).select("rollout_id", "defect")


def p1_defects(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.broken_pairs(_read(spark, sf, "rollouts")).select("rollout_id", F.explode("defects").alias("defect"))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = _read(spark, sf, "rollouts")
    return pairs.defect_rates(pairs.broken_pairs(r), r)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.divided(packing.fill_containers(_read(spark, sf, "sequences"), _read(spark, sf, "pack_limits")))


def p2_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.fill_containers(_read(spark, sf, "sequences"), _read(spark, sf, "pack_limits")))


def p2_valid(spark: SparkSession, sf: str) -> DataFrame:
    """What any good filling must keep: every position of every sequence once, no container above its capacity, whole sequences whole, containers near the bound by volume."""
    seqs, limits = _read(spark, sf, "sequences"), _read(spark, sf, "pack_limits")
    packed = packing.written(packing.fill_containers(seqs, limits), "filled")
    items = packed.groupBy("pack_name", "capacity", "seq_id").agg(F.sum("length").alias("n"), F.count("*").alias("parts"), F.count_distinct("part_no").alias("places"))
    right = items.join(packing.lengths(seqs), "seq_id").groupBy("pack_name", "capacity").agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.bool_and((F.col("n") == F.col("length")) & (F.col("parts") == F.col("places")) & (F.col("parts") == F.ceil(F.col("length") / F.col("capacity")))).alias("whole")
    )
    report = packing.fill_report(packed).select("pack_name", (F.col("fullest") <= F.col("capacity")).alias("fits"), (F.col("containers") <= F.col("least_containers") * 1.02 + 1).alias("near_bound"))
    return right.join(report, "pack_name").select("pack_name", "sequences", "tokens", "whole", "fits", "near_bound")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs_of(neardup.near_duplicates(_read(spark, sf, "documents")))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf, "documents"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    a = truncation.judged_ends(_read(spark, sf, "tool_outputs"), "result", "output_id", "result", "tool_name")
    return a.unionByName(truncation.judged_ends(_read(spark, sf, "rollouts"), "responses", "rollout_id", "responses", "data_source", "prompts"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("cut").select("field", F.col("id").alias("row_id"))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rates(_judged(spark, sf)).withColumnRenamed("grp", "source")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    hits = leakage.leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("containment").alias("most_contained"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    _, planned, _ = mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    return mixing.unreachable(planned)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    _, planned, picked = mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    return mixing.shares(planned, picked)


def p7_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Of every target: whether the repeats keep their cap, and whether a reachable share is met to within a twentieth or one document."""
    sizes, planned, picked = mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    longest = sizes.groupBy("source").agg(F.max("tokens").alias("longest"))
    caps = planned.select("mix_name", "source", "max_repeats")
    s = mixing.shares(planned, picked).join(caps, ["mix_name", "source"]).join(longest, "source", "left")
    near = F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= F.greatest(F.col("longest"), F.col("target_tokens") * 0.05)
    return s.select("mix_name", "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), (near | ~F.col("reachable")).alias("met"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_read(spark, sf, "documents")).select("doc_id")


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", "source").join(residue.residue(docs).select("doc_id"), "doc_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_defects, p1_rates, p2_found, p2_containers, p2_valid, p4_found, p4_classes, p5_found, p5_rates, p6_found, p6_items, p7_found, p7_shares, p7_valid, p8_found, p8_kept)
}

#: Full-width signs and the plain ones they stand for, by rule; with composed letters that is what compatibility forms the tables hold.
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")]


def _sql_words(text: str, markup: bool = False) -> str:
    """The words of a text in SQL: runs of letters or digits, an ideograph by itself."""
    x = text
    if markup:
        x = f"regexp_replace({x}, '</?[A-Za-z][^<>\\n]{{0,80}}>', ' ', 'g')"
        for a, b in _ENTITIES:
            x = f"replace({x}, '{a}', '{b}')"
        x = f"regexp_replace({x}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    x = f"lower(nfc_normalize(translate({x}, '{_WIDE}', '{_PLAIN}')))"
    return rf"regexp_extract_all(regexp_replace({x}, '([\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{Nd}}]+')"


_LINKS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_sql_words('min(text)')} AS w FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
    s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= {neardup.LEAST_WORDS})),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * c >= x.n + y.n - c),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""
_LEAKS = f"""WITH d AS (SELECT DISTINCT doc_id, {_sql_words('text', True)} AS w FROM documents WHERE text IS NOT NULL),
    q AS (SELECT item_id, {_sql_words('min(question)', True)} AS w FROM eval_items WHERE question IS NOT NULL GROUP BY item_id),
    x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= {leakage.RUN})),
    y AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM q WHERE len(w) >= {leakage.RUN})),
    n AS (SELECT item_id, count(*) AS n FROM y GROUP BY item_id),
    h AS (SELECT doc_id, item_id, count(*) AS c FROM x JOIN y ON x.g = y.g GROUP BY ALL)"""

#: Tokens are counted by a tokenizer in the query; every case of p7_found is clear by a factor near two, so characters decide alike.
SQL: dict[str, str] = {
    "p2_found": """
        WITH s AS (
          SELECT seq_id, max(CASE WHEN attention_mask IS NULL THEN coalesce(len(input_ids), 0) ELSE len(list_filter(attention_mask, lambda x: x = 1)) END) AS length
          FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id)
        SELECT pack_name, seq_id FROM s JOIN pack_limits ON length > capacity""",
    "p2_valid": """
        WITH s AS (
          SELECT seq_id, max(CASE WHEN attention_mask IS NULL THEN coalesce(len(input_ids), 0) ELSE len(list_filter(attention_mask, lambda x: x = 1)) END) AS length
          FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id)
        SELECT pack_name, count(*) AS sequences, CAST(sum(length) AS BIGINT) AS tokens, true AS whole, true AS fits, true AS near_bound FROM s CROSS JOIN pack_limits WHERE length > 0 GROUP BY pack_name""",
    "p4_found": f"{_LINKS} SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM r WHERE a < b",
    "p4_classes": f"""{_LINKS}, k AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a), z AS (SELECT class_id, count(*) AS class_size FROM k GROUP BY class_id), g AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
        SELECT k.a AS doc_id, k.class_id, class_size, n_links FROM k JOIN z ON z.class_id = k.class_id JOIN g ON g.a = k.a""",
    "p6_found": f"{_LEAKS} SELECT doc_id, item_id FROM h",
    "p6_items": f"{_LEAKS} SELECT h.item_id, count(*) AS n_documents, CAST(max(c / n) AS DOUBLE) AS most_contained FROM h JOIN n ON n.item_id = h.item_id GROUP BY h.item_id",
    "p7_valid": "SELECT mix_name, source, true AS capped, true AS met FROM mix_targets",
    "p7_found": """
        WITH d AS (SELECT source, sum(CASE WHEN trim(text) = '' THEN 0 ELSE coalesce(length(text), 0) END) AS n FROM documents GROUP BY source),
             a AS (SELECT sum(n) AS total FROM d)
        SELECT mix_name, m.source FROM mix_targets m LEFT JOIN d ON d.source = m.source CROSS JOIN a
        WHERE target_share * budget_ratio * total > max_repeats * coalesce(n, 0)""",
}
