"""Extraction and comparison of answers: Column in, Column out, evaluated in the JVM.

Patterns are stated once here; all are plain enough to mean the same in Java and
RE2.  Null text gives null unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
#: Levels of braces inside a box.
BOX_DEPTH = 6


def box_pattern(depth: int) -> str:
    """A box with up to `depth` levels of balanced braces inside."""
    inner = "[^{}]*"
    for _ in range(depth):
        inner = rf"[^{{}}]*(?:\{{{inner}\}}[^{{}}]*)*"
    return rf"\\boxed\{{({inner})\}}"


BOX = box_pattern(BOX_DEPTH)


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# ---- marked answers -----------------------------------------------------------------------------------------------


def boxed_all(text: Column) -> Column:
    """All closed boxes in order, with up to BOX_DEPTH levels of braces inside."""
    return every(text, BOX)


def boxed_last(text: Column) -> Column:
    return last(boxed_all(text))


def hash_answer(text: Column) -> Column:
    """Last `#### number` without commas and currency signs; null if none."""
    return F.regexp_replace(last(every(text, r"#### (-?[0-9.,$]*[0-9])")), r"[,$]", "")


def hash_answer_first(text: Column) -> Column:
    """First `#### number` without commas."""
    return F.replace(F.try_element_at(every(text, r"#### (-?[0-9.,]+)"), F.lit(1)), F.lit(","), F.lit(""))


def number_flexible(text: Column) -> Column:
    """The last number-like run; where all are '.' or empty, the first one."""
    runs = every(text, r"(-?[0-9.,]+)")
    good = F.filter(runs, lambda x: ~x.isin("", "."))
    return F.coalesce(last(good), F.try_element_at(runs, F.lit(1)))


def tagged_last(text: Column, tag: str) -> Column:
    """Last <tag>...</tag>, stripped."""
    return strip(last(every(text, rf"(?s)<{tag}>(.*?)</{tag}>")))


def answer_tags(text: Column) -> Column:
    """struct(opening, closing) counts of answer tags."""
    return F.struct(count_of(text, "<answer>").alias("opening"), count_of(text, "</answer>").alias("closing"))


def answer_line(text: Column, pattern: str = r"(?i)Answer\s*:\s*([^\n]+)") -> Column:
    """Last `Answer: ...` line, `[INVALID]` if there is none."""
    return F.coalesce(last(every(text, pattern)), F.lit("[INVALID]"))


def choice_letter(text: Column) -> Column:
    """First `Answer: X`, X in A-D, upper case; empty if none."""
    return F.upper(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1))


def final_answer(text: Column) -> Column:
    """Last FINAL_ANSWER line, else the last flat box, else the last line."""
    line = F.trim(last(every(text, r"FINAL_ANSWER:\s*([^\n]+)")))
    flat = last(every(text, r"\\boxed\{([^{}]*)\}"))
    return F.coalesce(line, flat, F.trim(F.element_at(F.split(F.trim(text), "\n"), -1)))


def confidence(text: Column, default: float | None = None) -> Column:
    """Last CONFIDENCE number clamped to [0, 1]."""
    x = last(every(text, r"CONFIDENCE:\s*(-?[0-9]*\.?[0-9]+)")).cast("double")
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    c = F.when(x.isNotNull(), c)
    return c if default is None else F.coalesce(c, F.lit(default))


def think_blocks(text: Column) -> Column:
    return every(text, r"(?s)<think>(.*?)</think>")


def n_steps(text: Column) -> Column:
    return F.greatest(F.size(think_blocks(text)), F.lit(1))


def code_blocks(text: Column) -> Column:
    """Non-empty fenced code blocks, stripped."""
    return F.filter(F.transform(every(text, r"(?s)```(?:python)?\n(.*?)```"), strip), lambda x: x != "")


def sql_text(text: Column) -> Column:
    """Last ```sql block, else last <sql>, else last <solution>, else the text; split comparison signs are mended."""
    found = F.coalesce(*[last(every(text, p)) for p in (r"(?s)```sql\s*(.*?)```", r"(?s)<sql>(.*?)</sql>", r"(?s)<solution>(.*?)</solution>")], text)
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ((">" + " =", ">="), ("<" + " =", "<="), ("!" + " =", "!=")), strip(found))


def current_year(query: Column, year: int = 2020) -> Column:
    return F.regexp_replace(query, r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)", str(year))


# ---- normalisation ------------------------------------------------------------------------------------------------

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def without_punctuation(text: Column) -> Column:
    return F.translate(text, ASCII_PUNCTUATION, "")


def plain_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    words = F.split(without_punctuation(F.lower(text)), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def exact_any(prediction: Column, gold: Column) -> Column:
    """Whether any gold answer equals the prediction after normalisation."""
    return F.exists(gold, lambda g: plain_answer(g) == plain_answer(prediction))


def contains_any(prediction: Column, gold: Column) -> Column:
    return F.exists(gold, lambda g: F.contains(plain_answer(prediction), plain_answer(g)))


def mend_fractions(text: Column) -> Column:
    r"""\frac12 -> \frac{1}{2}, \frac1{72} -> \frac{1}{72}."""
    x = F.regexp_replace(text, r"\\frac([0-9a-z])\{", r"\\frac{$1}{")
    return F.regexp_replace(x, r"\\frac([0-9a-z])([0-9a-z])", r"\\frac{$1}{$2}")


def mend_slash(text: Column) -> Column:
    r"""a/b -> \frac{a}{b} where the whole text is two integers."""
    return F.regexp_replace(text, r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{$1}{$2}")


def mend_roots(text: Column) -> Column:
    r"""\sqrt3 -> \sqrt{3}."""
    return F.regexp_replace(text, r"\\sqrt([0-9a-z])", r"\\sqrt{$1}")


def without_units(text: Column) -> Column:
    r"""Cuts at `\text{ `; more than one occurrence leaves the text as it is."""
    n = count_of(text, r"\\text\{ ")
    return F.when(n == 1, F.substring_index(text, "\\text{ ", 1)).otherwise(text)


#: The plain LaTeX form as rules (pattern, replacement), applied from top to bottom; the comment says what a rule is for.
LATEX_RULES = [
    (r"\n|\\!", ""),  # line breaks and negative spaces carry no meaning
    (r"\\\\", r"\\"),  # a backslash written twice
    (r"[td]frac", "frac"),  # fraction sizes
    (r"\\(?:left|right)", ""),  # bracket sizes
    (r"\^(?:\{\\circ\}|\\circ)", ""),  # degrees
    (r"\\\$", ""),  # currency
    (r"(?s)^(?!.*\\text\{ .*\\text\{ )(.*?)\\text\{ .*$", "$1"),  # a unit, if there is just one
    (r"\\?%", ""),  # percent
    (r"([ {])\.", "$10."),  # .5 is 0.5, after a space or a brace
    (r"^\.", "0."),  # and at the beginning
    (r"(?s)^[^=]{1,2}=([^=]*)$", "$1"),  # "k = 3" answers 3
    (r"\\sqrt([0-9a-z])", r"\\sqrt{$1}"),  # roots without braces
    (" ", ""),
    (r"\\frac([0-9a-z])\{", r"\\frac{$1}{"),  # fractions without braces
    (r"\\frac([0-9a-z])([0-9a-z])", r"\\frac{$1}{$2}"),
    (r"^0\.5$", r"\\frac{1}{2}"),
    (r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{$1}{$2}"),
]


def latex_plain(text: Column) -> Column:
    """The plain form of a LaTeX answer: LATEX_RULES in their order."""
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), LATEX_RULES, text)


def latex_equal(a: Column, b: Column) -> Column:
    """Both null: true; one null: false; else equal after latex_plain."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(latex_plain(a) == latex_plain(b))


#: Prefixes an answer may carry, tried in this order (fixed values).
ANSWER_PREFIXES = ["the answer is", "answer:", "answer is", "final answer:", "final answer is", "final_answer:"]


def answer_key(text: Column) -> Column:
    """Lower case, known prefixes off, LaTeX unwrapped, single spaces, no closing `.,;:`."""
    x = F.trim(F.lower(text))
    for p in ANSWER_PREFIXES:
        x = F.when(F.startswith(x, F.lit(p)), F.trim(F.substr(x, F.lit(len(p) + 1)))).otherwise(x)
    x = F.regexp_replace(x, r"\\boxed\{([^{}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\text\{([^{}]*)\}", "$1")
    x = F.regexp_replace(F.replace(x, F.lit("$"), F.lit("")), r"\s+", " ")
    return F.regexp_replace(F.trim(x), r"[.,;:]+$", "")


def key_match(prediction: Column, truth: Column) -> Column:
    """Normalised equality; an empty answer never matches."""
    p, t = answer_key(prediction), answer_key(truth)
    return F.coalesce((p != "") & (t != "") & (p == t), F.lit(False))


def number_in(text: Column) -> Column:
    """A percentage over 100, else a fraction a/b, else the first number."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    percent = F.regexp_extract(t, r"(-?[0-9]+\.?[0-9]*)\s*%", 1)
    top, bottom = (F.regexp_extract(t, r"(-?[0-9]+\.?[0-9]*)\s*/\s*(-?[0-9]+\.?[0-9]*)", i) for i in (1, 2))
    first = F.regexp_extract(t, r"-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?", 0)
    d = F.expr("try_cast(null as double)")
    return (
        F.when(percent != "", F.try_to_number(F.lit("0"), F.lit("9")) * 0 + percent.cast("double") / 100.0)
        .when((bottom != "") & (F.when(bottom != "", bottom).cast("double") != 0), F.when(top != "", top).cast("double") / F.when(bottom != "", bottom).cast("double"))
        .when(first != "", F.when(first != "", first).cast("double"))
        .otherwise(d)
    )


def number_match(prediction: Column, truth: Column, tolerance: float = 1e-5) -> Column:
    """Relative tolerance, absolute where the truth is 0."""
    p, t = number_in(prediction), number_in(truth)
    return F.coalesce(F.when(t == 0, F.abs(p) < tolerance).otherwise(F.abs(p - t) / F.abs(t) < tolerance), F.lit(False))


# ---- format and safety --------------------------------------------------------------------------------------------


def think_box_format(text: Column) -> Column:
    r"""1.0 where the whole text is <think>...</think> ... \boxed{...} ..., else 0.0."""
    return F.regexp_like(text, F.lit(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")).cast("double")


def closes_think(text: Column) -> Column:
    return F.contains(text, F.lit("</think>")).cast("int")


def solver_format(text: Column) -> Column:
    """A think block, a CONFIDENCE number and FINAL_ANSWER."""
    return F.regexp_like(text, F.lit(r"(?s)<think>.*</think>")) & F.regexp_like(text, F.lit(r"CONFIDENCE:\s*[0-9.]+")) & F.contains(text, F.lit("FINAL_ANSWER:"))


#: Modules and calls that a code sandbox refuses (fixed values).
FORBIDDEN_MODULES = ["subprocess", "multiprocessing", "threading", "socket", "psutil", "resource", "ctypes"]
FORBIDDEN_CALLS = ["os.system", "os.popen", "os.spawn", "os.fork", "os.exec", "sys.exit", "os._exit", "os.kill"]


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def has_forbidden_code(text: Column) -> Column:
    parts = [f"{w} {m}" for m in FORBIDDEN_MODULES for w in ("import", "from")] + FORBIDDEN_CALLS
    return any_of(text, parts)


def tool_reward(text: Column, weight: float = 0.05, cap: int = 4) -> Column:
    return F.least(count_of(text, "```output"), F.lit(cap)) * F.lit(weight)


def is_provable(question: Column, answer: Column) -> Column:
    """Kept after the hard-to-grade exclusion: no proof, no box in the question, no text in the answer."""
    return ~(F.contains(question, F.lit("证明")) | F.contains(F.lower(question), F.lit("box")) | F.contains(F.lower(answer), F.lit("text")))


#: Words of second thoughts (fixed values).
REFLECTION = ["wait", "recheck", "retry", "try again", "alternatively", "however", "rethink", "reevaluate"]


def reflection_counts(text: Column) -> Column:
    return F.create_map(*[x for p in REFLECTION for x in (F.lit(p), count_of(F.lower(text), rf"\b{p}\b"))])


# ---- token overlap ------------------------------------------------------------------------------------------------


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(without_punctuation(text)), r"\s+"), lambda x: x != ""))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets, 0 where they share nothing."""
    n = F.size(F.array_intersect(a, b))
    return F.when(n > 0, 2.0 * n / (F.size(a) + F.size(b))).otherwise(0.0)


def passages_to_text(titles: Column, texts: Column) -> Column:
    """Doc i(Title: ...) text, one passage a line."""
    rows = F.transform(F.arrays_zip(titles.alias("t"), texts.alias("x")), lambda p, i: F.concat(F.lit("Doc "), i + 1, F.lit("(Title: "), p["t"], F.lit(") "), p["x"], F.lit("\n")))
    return F.array_join(rows, "")
