"""Grading of answers: normal forms, numeric and element-wise equality, and the scores built on them.

Everything is a Column expression.  Symbolic equality of two different formulas
needs an algebra package and is not decided here: such pairs are unequal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.answers import answer_key, answer_line, boxed_last, choice_letter, key_match, latex_plain, number_match, strip
from millrace.functions.arrays import let

#: Plain replacements of the final-answer normal form, in order (fixed values).
FINAL_REPLACED = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
#: Expressions that the final-answer normal form drops, in order (fixed values).
FINAL_DROPPED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: Patterns of the final-answer normal form after that, in order (fixed values).
FINAL_PATTERNS = [
    (r"^[^\n]*?\$([^\n]*?)\$[^\n]*", r"\$$1\$"), (r"\\text\{([^\n]*?)\}", "$1"), (r"\\textbf\{([^\n]*?)\}", "$1"), (r"\\overline\{([^\n]*?)\}", "$1"), (r"\\boxed\{([^\n]*)\}", "$1"),
    (r"frac([^{])([^\n])", r"frac{$1}{$2}"), (r"sqrt([^{])", r"sqrt{$1}"),
]

_BRACKETS = "()[]{}"
_NUMERIC = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def final_form(text: Column) -> Column:
    """What stands behind the last `=`, without units, wrappers and spaces, with braces around the arguments of fractions and roots."""
    x = F.element_at(F.split(text, "="), -1)
    x = replaced(x, FINAL_REPLACED + [(e, "") for e in FINAL_DROPPED])
    x = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), FINAL_PATTERNS, x)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return strip(F.when(F.regexp_like(bare, F.lit(r"^[0-9]+$")), bare).otherwise(x))


def final_line_score(text: Column, truth: Column, tail: int = 300) -> Column:
    """struct(score 1 or -1, acc, pred): the last `Answer:` line of the text's end against the truth, both in final form."""
    pred = final_form(answer_line(F.right(text, F.lit(tail))))
    ok = F.coalesce(pred == final_form(truth), F.lit(False))
    return F.struct(F.when(ok, 1.0).otherwise(-1.0).alias("score"), ok.alias("acc"), pred.alias("pred"))


def strict_box_score(text: Column, truth: Column, tail: int = 100) -> Column:
    """struct(score 1 or -1, pred): the last box that stands whole in the text's last characters equals the truth."""
    pred = boxed_last(F.right(text, F.lit(tail)))
    return F.struct(F.when(F.coalesce(pred == truth, F.lit(False)), 1).otherwise(-1).alias("score"), pred.alias("pred"))


def tool_turn_score(text: Column, truth: Column, turns: Column) -> Column:
    """The strict box score; a wrong answer gains by tool turns, but stays at 0 at most."""
    s = strict_box_score(text, truth)["score"].cast("double")
    return F.when(s > 0, s).otherwise(F.least(F.lit(0.0), s + (turns - 2) / 2 * 0.1))


def box_score(text: Column, truth: Column) -> Column:
    """1.0 where the last box equals the truth in plain LaTeX form, else 0.0."""
    return F.coalesce(latex_plain(boxed_last(text)) == latex_plain(truth), F.lit(False)).cast("double")


def geometry_score(text: Column, truth: Column, formatted: Column, weight: float = 0.1) -> Column:
    """(1 - weight) * accuracy + weight * format."""
    return (1 - weight) * box_score(text, truth) + weight * formatted


def choice_score(text: Column, truth: Column) -> Column:
    return F.coalesce(choice_letter(text) == truth, F.lit(False)).cast("double")


def count_score(text: Column, truth: Column) -> Column:
    """1 where the last box holds the very count, else 0."""
    return F.coalesce(boxed_last(text) == truth, F.lit(False)).cast("int")


# ---- numeric and element-wise equality ----------------------------------------------------------------------------


def as_number(text: Column) -> Column:
    """The number a text spells, thousands separators aside; null if it is none."""
    bare = replaced(text, [("{,}", ""), (",", "")])
    return F.when(F.regexp_like(bare, F.lit(_NUMERIC)), F.trim(bare)).try_cast("double")


def bare_amount(text: Column) -> Column:
    r"""Without the sign of a dollar amount or of a percentage."""
    x = F.when(F.regexp_like(text, F.lit(r"^\$[0-9]")), F.substr(text, F.lit(2))).otherwise(text)
    return F.when(F.regexp_like(x, F.lit(r"^[0-9]+(\.[0-9]+)?\\?%$")), F.regexp_replace(x, r"[\\%]", "")).otherwise(x)


def close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Equal within a share of the larger one."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def numbers_equal(prediction: Column, truth: Column, percent: bool = True, tolerance: float = 1e-4) -> Column:
    """Null unless both are numbers; a percentage may stand for its share and the other way round."""
    p, t = as_number(prediction), as_number(truth)
    ok = close(p, t, tolerance)
    return (ok | close(p, t / 100, tolerance) | close(p, t * 100, tolerance)) if percent else ok


def elements(text: Column) -> Column:
    """The elements of a bracketed tuple or interval without inner brackets; any other text is its own only element; nothing for an empty text.

    Commas between thousands belong to their number.
    """
    x = F.regexp_replace(F.regexp_replace(text, r"([0-9]),([0-9]{3})(?=$|[^0-9])", "$1$2"), r"([0-9]),([0-9]{3})(?=$|[^0-9])", "$1$2")
    inner = F.substr(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))
    is_tuple = F.regexp_like(x, F.lit(r"(?s)^[(\[].+[)\]]$")) & ~F.regexp_like(inner, F.lit(r"[()\[\]]"))
    return F.when(x.isNull(), F.lit(None)).when(x == "", F.array().cast("array<string>")).when(is_tuple, F.transform(F.split(inner, ","), lambda e: F.trim(e))).otherwise(F.array(x))


def _one_equal(p: Column, t: Column, percent: bool, tolerance: float) -> Column:
    p, t = bare_amount(F.trim(p)), bare_amount(F.trim(t))
    same = (F.lower(p) == F.lower(t)) | (F.replace(p, F.lit(" "), F.lit("")) == F.replace(t, F.lit(" "), F.lit("")))
    unwrapped = F.translate(p, "(){}", "") == F.translate(t, "(){}", "")
    return same | F.coalesce(numbers_equal(p, t, percent, tolerance), unwrapped & (p != ""))


def math_equal(prediction: Column, truth: Column, percent: bool = True, tolerance: float = 1e-4) -> Column:
    """Equality of answers without algebra: text, numbers (percentages too), and element by element for tuples, intervals and lists.

    Tuples and intervals need the same brackets.  Null on either side is unequal.
    """

    def parts(x: Column) -> Column:
        inner = F.regexp_replace(F.trim(x), r"^[(\[]|[)\]]$", "")
        return F.split(inner, ",")

    p, t = F.trim(prediction), F.trim(truth)
    whole = _one_equal(p, t, percent, tolerance)
    brackets = lambda x: F.concat(F.regexp_extract(x, r"^[(\[]", 0), F.regexp_extract(x, r"[)\]]$", 0))
    both_lists = F.contains(p, F.lit(",")) & F.contains(t, F.lit(",")) & ~(as_number(p).isNotNull() & as_number(t).isNotNull()) & (brackets(p) == brackets(t))
    each = F.forall(F.zip_with(parts(p), parts(t), lambda a, b: _one_equal(a, b, percent, tolerance)), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce(whole | (both_lists & (F.size(parts(p)) == F.size(parts(t))) & each), F.lit(False))


def grade(answer: Column, truth: Column) -> Column:
    """Equal in plain LaTeX form, or element by element: an integer needs an integer, fractions need the same text, other numbers the same value."""
    inside = lambda x: latex_plain(F.regexp_replace(F.trim(x), r"^\\text\{(.+?)\}$", "$1"))
    a, t = inside(answer), inside(truth)
    is_int = lambda x: F.coalesce(as_number(x) == F.round(as_number(x)), F.lit(False))
    is_frac = lambda x: F.regexp_like(x, F.lit(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"))

    def same(x: Column, y: Column) -> Column:
        return F.when(is_frac(x) & is_frac(y), x == y).when(is_int(x) != is_int(y), False).otherwise((x == y) | F.coalesce(as_number(x) == as_number(y), F.lit(False)))

    ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    ea, et = elements(a), elements(t)
    by_element = (F.size(ea) == F.size(et)) & ((F.size(et) < 2) | (ends(a) == ends(t))) & F.forall(F.zip_with(ea, et, same), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce((a == t) | ((a != "") & by_element), F.lit(False))


def fuzzy_match(prediction: Column, truth: Column) -> Column:
    """Equal keys, or equal numbers, or the truth is one letter that stands as a word of the prediction."""
    p, t = answer_key(prediction), answer_key(truth)
    letter = F.regexp_like(t, F.lit(r"^[a-z]$")) & F.array_contains(F.split(p, " "), t)
    return key_match(prediction, truth) | number_match(prediction, truth) | F.coalesce(letter, F.lit(False))


def score_by_source(source: Column, scorers: dict[str, Column], default: Column | None = None) -> Column:
    """The score of the source's own scorer; a source without one fails unless there is a default."""
    out = None
    for name, score in scorers.items():
        out = F.when(source == name, score) if out is None else out.when(source == name, score)
    last = default if default is not None else F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    return last if out is None else out.otherwise(last)


def best_of_gold(scores: Column) -> Column:
    """The greatest score over all gold answers, never below 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(scores), F.lit(0.0)))


def output_equal(output: Column, expected: Column) -> Column:
    """Equal as they are, or stripped, or line by line stripped without blank lines, or word by word."""
    lines = lambda x: F.filter(F.transform(F.split(x, "\n"), strip), lambda y: y != "")
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda y: y != "")
    return F.coalesce((output == expected) | (strip(output) == strip(expected)) | (lines(output) == lines(expected)) | (words(output) == words(expected)), F.lit(False))


def penalty(**switched: tuple[Column, float]) -> Column:
    """Sum of the amounts whose condition holds; nothing is switched on by itself."""
    return reduce(lambda a, b: a + b, [F.when(cond, F.lit(float(amount))).otherwise(0.0) for cond, amount in switched.values()], F.lit(0.0))


__all__ = [
    "as_number", "bare_amount", "best_of_gold", "box_score", "choice_score", "close", "count_score", "elements", "final_form", "final_line_score", "fuzzy_match", "geometry_score", "grade", "let",
    "math_equal", "numbers_equal", "output_equal", "penalty", "score_by_source", "strict_box_score", "tool_turn_score",
]
