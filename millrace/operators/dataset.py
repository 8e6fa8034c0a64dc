"""Records of training sets: flattening, messages, choices, splits, filters, weights, batches and their checks.

Everything is narrow or map-side combined; tables of groups are sent to the rows while they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from millrace.operators.advantage import with_group
from millrace.session import small_side, written

# ---- records and messages -----------------------------------------------------------------------------------------


def prompt_records(df: DataFrame, key: str = "uid") -> DataFrame:
    """(key, index, split, truth, turns, last_message) of prompt records; a missing index is 0."""
    return df.select(
        key, F.coalesce("extra_info.index", F.lit(0)).alias("index"), F.col("extra_info.split").alias("split"), F.col("reward_model.ground_truth").alias("truth"), F.size("prompt").alias("turns"),
        F.try_element_at(F.col("prompt.content"), F.lit(-1)).alias("last_message"),
    )


def messages(df: DataFrame, key: str = "uid", column: str = "prompt") -> DataFrame:
    """(key, turn, role, content): one row for each message."""
    return df.select(key, F.posexplode(column).alias("turn", "m")).select(key, "turn", "m.role", "m.content")


def last_user_answer(prompt: Column) -> Column:
    """The last user message behind `#### `, which is added where it is missing; without a user message, only the sign."""
    said = F.coalesce(F.try_element_at(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(-1))["content"], F.lit(""))
    return F.when(F.startswith(said, F.lit("#### ")), said).otherwise(F.concat(F.lit("#### "), said))


def segments(text: Column, marker: str) -> Column:
    """The pieces of a text between markers, without empty ones."""
    return F.filter(F.split(text, marker, -1), lambda x: x != "")


def alternating(text: Column, inside: str = "interpreter") -> Column:
    """struct(role, content): what stands inside the tag is the tool's, everything else the assistant's; blank parts are left out."""
    parts = F.split(text, rf"(?=<{inside}>)|(?<=</{inside}>)", -1)
    tool = lambda p: F.startswith(p, F.lit(f"<{inside}>"))
    bare = lambda p: F.trim(F.regexp_replace(p, rf"^<{inside}>|</{inside}>$", ""))
    each = F.transform(parts, lambda p: F.struct(F.when(tool(p), "tool").otherwise("assistant").alias("role"), F.when(tool(p), bare(p)).otherwise(F.trim(p)).alias("content")))
    return F.filter(each, lambda m: m["content"] != "")


def first_given(columns: list[Column], default: str | None = None) -> Column:
    """The first column that is neither null nor blank, else the default."""
    given = [F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns]
    return F.coalesce(*given, F.lit(default))


def with_choices(question: Column, right: Column, wrong: Column, key: Column, seed: int = 0) -> Column:
    """struct(prompt, letter): the right answer among the wrong ones in an order that key and seed fix, as A), B), ..."""
    tagged = F.concat(F.array(F.struct(F.lit(True).alias("ok"), right.alias("t"))), F.transform(wrong, lambda w: F.struct(F.lit(False).alias("ok"), w.alias("t"))))
    order = F.array_sort(F.transform(tagged, lambda c: F.struct(F.xxhash64(key, c["t"], F.lit(seed)).alias("h"), c["t"].alias("t"), c["ok"].alias("ok"))))
    lines = F.transform(order, lambda c, i: F.concat(F.chr(i + 65), F.lit(") "), c["t"]))
    return F.struct(F.concat(question, F.lit("\n\n"), F.array_join(lines, "\n")).alias("prompt"), F.chr(F.array_position(F.transform(order, lambda c: c["ok"]), True) + 64).alias("letter"))


def counted_letters(word: Column, letter: Column) -> Column:
    """The worked count of a letter in a word: a line for each letter, then the boxed number."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    lines = F.transform(letters, lambda c: F.concat(c, F.when(c == letter, " = ").otherwise(" != "), letter, F.lit(".")))
    n = F.size(F.filter(letters, lambda c: c == letter))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\\boxed{"), n, F.lit("} "), letter, F.lit(" in "), F.array_join(letters, "-"), F.lit("."))


# ---- splits and filters -------------------------------------------------------------------------------------------


def train_part(pos: Column, n: int, share: float = 0.75) -> Column:
    return F.when(pos < int(n * share), "train").otherwise("test")


def in_period(df: DataFrame, column: str, begin: str, end: str) -> DataFrame:
    """Rows whose time lies in [begin, end), given as text in ISO form."""
    return df.where((F.col(column) >= F.to_timestamp_ntz(F.lit(begin))) & (F.col(column) < F.to_timestamp_ntz(F.lit(end))))


def parsed(df: DataFrame, answer: str, text: str, longest: int) -> DataFrame:
    """Rows with an answer and a text of at most so many characters."""
    return df.where(F.col(answer).isNotNull() & (F.length(text) <= longest))


def varied_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows of groups whose scores differ, and of groups of one."""
    g = df.groupBy(group).agg(F.stddev_pop(score).alias("__sd"), F.count("*").alias("__n")).where("__sd > 0 or __n = 1").select(group)
    return df.join(small_side(written(g, "varied")), group, "left_semi")


def accuracy_band(df: DataFrame, group: str, ok: Column, low: float, high: float, length: str, longest: int) -> DataFrame:
    """Rows of groups whose accuracy lies in [low, high] and whose longest response stays below a bound."""
    g = df.groupBy(group).agg(F.avg(ok.cast("double")).alias("__a"), F.max(length).alias("__l")).where(F.col("__a").between(low, high) & (F.col("__l") < longest)).select(group)
    return df.join(small_side(written(g, "band")), group, "left_semi")


def kept(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other frame has."""
    return df.where(F.col(key).isNotNull()).join(small_side(written(keys.select(key).where(F.col(key).isNotNull()).distinct(), "kept")), key, "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other frame lacks: what is left after a resume."""
    return df.join(small_side(written(done.select(key).where(F.col(key).isNotNull()).distinct(), "done")), key, "left_anti")


def with_truth(df: DataFrame, records: DataFrame, key: str, truth: Column) -> DataFrame:
    """Rows of known keys with their record's truth (the greatest of several deliveries)."""
    t = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(truth).alias("truth"))
    return df.where(F.col(key).isNotNull()).join(small_side(written(t, "truths")), key)


# ---- weights and batches ------------------------------------------------------------------------------------------


def power_weight(score: Column, exponent: float, least: float = 1e-8) -> Column:
    return F.greatest(F.pow(F.abs(score), F.lit(exponent)), F.lit(least))


def extreme_weights(df: DataFrame, score: str, least: float = 1e-8) -> DataFrame:
    """weight 1 for the rows with the greatest or least score, else nearly none."""
    e = df.agg(F.max(score).alias("__hi"), F.min(score).alias("__lo"))  # one row
    hit = (F.col(score) == F.col("__hi")) | (F.col(score) == F.col("__lo"))
    return df.join(F.broadcast(e), how="cross").withColumn("weight", F.when(hit, 1.0).otherwise(least)).drop("__hi", "__lo")


def micro_batches(df: DataFrame, length: Column, budget: int) -> DataFrame:
    """One row: batches needed for a token budget each, at most one for each row."""
    return df.agg(F.least(F.count("*"), F.ceil(F.sum(length) / budget)).alias("micro_batches"))


def padded(df: DataFrame, pos: str, n: int, times: int, last: bool = False) -> DataFrame:
    """The batch with its first (or last) row appended so often."""
    if times < 1 or n < 1:
        return df
    row = df.where(F.col(pos) == (n - 1 if last else 0))
    kind = dict(df.dtypes)[pos]
    return df.unionByName(row.withColumn(pos, F.explode(F.sequence(F.lit(n).cast(kind), F.lit(n + times - 1).cast(kind)))))


def rank_of(part: Column, parts: int, copies: int) -> Column:
    """Array of the workers that get a part: `copies` workers hold each of `parts` parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: (part % parts) * copies + c)


def composed(prompt: Column, response: Column, most_prompt: int, most_response: int, pad: int) -> Column:
    """struct(ids, mask, positions): the prompt's end padded on the left, the response's beginning padded on the right."""
    p = F.slice(prompt, F.greatest(F.size(prompt) - most_prompt + 1, F.lit(1)), F.lit(most_prompt))
    r = F.slice(response, F.lit(1), F.lit(most_response))
    left, right = most_prompt - F.size(p), most_response - F.size(r)
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    ids = F.concat(fill(pad, left), p.cast("array<int>"), r.cast("array<int>"), fill(pad, right))
    mask = F.concat(fill(0, left), fill(1, F.size(p) + F.size(r)), fill(0, right))
    positions = F.transform(mask, lambda m, i: F.greatest(F.least(i - left, F.size(p) + F.size(r) - 1), F.lit(0)))
    return F.struct(ids.alias("ids"), mask.alias("mask"), positions.alias("positions"))


def checked(df: DataFrame, schema: StructType, key: str) -> DataFrame:
    """The frame if it has the schema's columns and types; a null key fails when the rows are read."""
    have: dict[str, DataType] = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns that are missing or of another type: {', '.join(wrong)}")
    return df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null {key}")).cast(have[key])).otherwise(F.col(key)))


def columns_of(rows: Column, names: list[str]) -> Column:
    """A list of structs as a struct of lists."""
    return F.struct(*[rows.getField(n).alias(n) for n in names])


def stacked(columns: list[Column], names: list[str]) -> Column:
    """Lists of one length as a list of structs; lists of different lengths fail."""
    same = reduce(lambda a, b: a & b, [F.size(c) == F.size(columns[0]) for c in columns])
    first = F.when(same, columns[0]).otherwise(F.when(F.raise_error(F.lit("lists of different lengths")).cast("boolean"), columns[0]))
    return F.arrays_zip(first.alias(names[0]), *[c.alias(n) for c, n in zip(columns[1:], names[1:])])


# ---- rates and choices by group -----------------------------------------------------------------------------------


def success_rate(df: DataFrame, ok: Column, by: str) -> DataFrame:
    """(by, calls, rate): share of successful calls; 1 where nothing is known."""
    return df.groupBy(by).agg(F.count("*").alias("calls"), F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("rate"))


def greatest_of(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, key, value) of the row with the greatest value; ties go to the smaller key."""
    return df.groupBy(by).agg(F.max_by(key, F.struct(value, -F.col(key))).alias(key), F.max(value).alias(value))


def pair_preference(df: DataFrame, pos: str, score: str) -> DataFrame:
    """preferred: of each two neighbouring rows the one with the greater score, the first on a tie.  A pair is two rows, so no window is large."""
    w = Window.partitionBy(F.floor(F.col(pos) / 2)).orderBy(F.desc(score), pos)
    return df.withColumn("preferred", F.row_number().over(w) == 1)


def generations(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, n, first_response): how many responses a prompt has, and the least of them."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(text).alias("first_response"))


def difficulty(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """The rows with `difficulty`, 1 - the group's accuracy."""
    return with_group(df, df.groupBy(group).agg((1 - F.avg(ok.cast("double"))).alias("difficulty")), group)
