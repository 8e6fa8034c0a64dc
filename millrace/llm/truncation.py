"""Text cut off by field limits (problem 5).

Method: near-copies first.  Values are cut into segments of 8, 8, 16, 32, ...
words, and the min-hash of a segment's runs of five words is a key of each band.
A value that may be cut is looked up by the keys of its last complete segment, so
a copy that has lost most of its text still meets the whole one, which has the
same segment.  Pairs are aligned word by word; a copy whose alignment ends early,
inside a word, sentence, list or table, is cut.  Then records without such a copy
are scored by the terminality of their closing words: how often the corpus ends a
value with just this closing, against how often the same words open a segment that
goes on, and against closings of which this one is only a beginning ("918 tok" of
"918 tokens").  A closing that is too rare for that is whole if its last word speaks
more for an end than the missing mark speaks for a cut: the odds of the word at the
end of segments against inside of them, times the odds of complete lines of its kind
that stand without a final mark, must reach 1.  What a text's own form decides needs
neither: an open fence, tag, brace or JSON value, a replacement character or a cut
mark at the end, a last line that breaks the pattern of the lines above it.

All counts cover all values and closings of any length (long ones as a hash);
digits are masked, so a closing is a pattern.  A value delivered twice counts once.

Equal texts are one node in the search.  A bucket of up to HOT_BUCKET nodes is
compared with all its longer nodes.  In a larger one a value is compared with those
that hold its last two whole words in a row, followed by another word: without them
no alignment can reach its end, so this is exact; hot pairs of words are spread by
salts.

Nulls and empty texts are no cases; a null id gives no row; a null group counts
under null.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from string import ascii_letters

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens as T
from millrace.operators.joins import spread_join
from millrace.session import small_side, written

#: Closings of more characters are counted under their hash.
LONG = 40
HASHED = "\x01"
SHINGLE = 5
#: Length of the first segments, and min-hash bands of one row each.
SEGMENT, BANDS = 8, 3
#: Nodes of a bucket that are compared with all others; in larger buckets the last words choose the partners.
HOT_BUCKET = 8
#: Last fields of a line that make the context of its closing.
FIELDS = 4
#: A closing is dominated if longer closings that begin with it are so many times as frequent.
DOMINANCE = 10
#: Least share of the segments with the same first word that end a value with this very closing.
TERMINALITY = 0.01
LEAST_ENDS = 3
SIMILARITY = 0.8
#: Words that an alignment may skip at a place where the texts differ.
WINDOW = 12

EMPTY, CUT, WHOLE, ASK = 0, 1, 2, 3

MARK = re.compile(r"(?:\.\.\.|…|�|[\[(<{]\s*(?:\w+ ){0,2}(?:cut|cut off|truncated|clipped|omitted|continued|more|snip)\s*[\])>}])\s*$", re.I)
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"')
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^\W\d_]+")
_MARKS = frozenset(".!?。！？")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
#: Ends that nothing is missing behind: a final mark, or the end of a marked answer.
_DONE = re.compile(_TERMINAL.pattern + r"|</\w+>$|```$|\*\*$|\\boxed\{[^{}]*\}\$?$")
_ITEM = re.compile(r"\s*(?:[-*•–]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s")
_ENDS = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$|</\w+>$|```$|\*\*$|\\boxed\{[^{}]*\}\$?$|[\])}]$")
_STRUCTURED = re.compile(r"\d|\||^\s*[-*•]")


def shape(line: str) -> str:
    """A line with words as w and digits as 9; decimals keep their number of places."""
    s = re.sub(r"\d+\.(\d+)", lambda m: "N." + "N" * len(m[1]), line)
    s = _WORDS.sub("w", s)
    return _DIGITS.sub("9", s)


def _unclosed(t: str) -> bool:
    if t.count("```") % 2:
        return True
    for tag in ("think", "answer"):
        if t.count(f"<{tag}>") > t.count(f"</{tag}>"):
            return True
    k = t.rfind("\\boxed{")
    if k >= 0:
        depth = 0
        for c in t[k + 6 :]:
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                break
        if depth > 0:
            return True
    return t.count("**") % 2 == 1


def _open_tail(t: str) -> bool:
    """Whether a tag, a command or a mark is begun at the very end."""
    if t.rstrip(ascii_letters).endswith(("<", "</", "\\")):
        return True
    return (t[-1] == "*" and t[-2:] != "**") or (t[-1] == "`" and t[-3:] != "```")


def closing(segment: str) -> str:
    """The masked closing; a long one as its hash, which is counted like any other."""
    tail = _DIGITS.sub("9", segment.lower())
    return tail if len(tail) <= LONG else HASHED + blake2b(tail.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def kind_of(segments: list[str]) -> str:
    """Lines that are alike: items or prose of the same number of words in powers of two, or (s) prose with a sentence before the last segment."""
    return "s" if len(segments) > 1 else ("i" if _ITEM.match(segments[0]) else "p") + str(_n_words(segments[0]).bit_length())


def _n_words(line: str) -> int:
    return len(line.split()) if line.isascii() else len(T.WORD.findall(line))


def segments_of(line: str) -> list[str]:
    return [x for x in _SENTENCE.split(line) if x and not x.isspace()]


def end_of(text: str | None) -> tuple[int, str, str, list[tuple[str, str]], str, bool]:
    """(state, context, closing, closings of inner lines in the same context, last line, whether a longer copy may show a cut) of one value."""
    if text is None or not text.strip():
        return EMPTY, "", "", [], "", False
    t = text.rstrip()
    # a mark ends with one of these signs; a single full stop is none
    if t[-1] in "…�" or t.endswith("...") or (t[-1] in "])>}" and MARK.search(t)):
        return CUT, "", "", [], "", False
    if t[0] in "{[":
        try:
            json.loads(t)
            return WHOLE, "", "", [], "", False
        except (ValueError, RecursionError):
            bare = _STRINGS.sub("", t)
            if bare.count("{") + bare.count("[") > bare.count("}") + bare.count("]") or bare.count('"') % 2:
                return CUT, "", "", [], "", False
    if _unclosed(t) or _open_tail(t):
        return CUT, "", "", [], "", False
    lines = [x for x in t.split("\n") if x.strip()]
    # where both last lines end with a mark, neither pattern below can hold
    if len(lines) > 1 and (" | " in lines[0] or t[-1] not in _MARKS or lines[-2].rstrip()[-1] not in _MARKS):
        if " | " in lines[0]:
            if lines[-1].count("|") != lines[0].count("|") or not lines[-1].rsplit("|", 1)[1].strip():
                return CUT, "", "", [], "", False
            body = lines[1:]
        else:
            body = lines
        above = [shape(x) for x in body[-3:-1]]
        last = shape(lines[-1]) if above or " | " in lines[0] else ""
        if len(above) == 2 and above[0] == above[1] and _STRUCTURED.search(above[0]) and not _ENDS.search(lines[-2]):
            if last != above[0]:
                return CUT, "", "", [], "", False
        if " | " in lines[0] or (above and above[-1] == last and _STRUCTURED.search(last) and not _ENDS.search(t)):
            ctx = "L" + _fields(last)
            inner = [("L" + _fields(shape(x)), _DIGITS.sub("9", x.rsplit(None, 1)[-1])) for x in body[:-1]]
            return ASK, ctx, _DIGITS.sub("9", lines[-1].rsplit(None, 1)[-1]), inner, lines[-1], True
    seg = _SENTENCE.split(lines[-1])[-1].strip() or lines[-1]
    marked = t[-1] in _MARKS
    if marked or _ENDS.search(t):
        # a long closing with a mark equals no closing without one and begins none that is counted by its letters
        tail = _DIGITS.sub("9", seg.lower())
        return WHOLE, "E", tail if len(tail) <= LONG else "", [], lines[-1], not (marked or _DONE.search(t)) or _ITEM.match(lines[-1]) is not None
    return ASK, "E1" if seg == t.strip() else "E", closing(seg), [], lines[-1], True


def _fields(line: str) -> str:
    """The last fields of a line's shape."""
    return " ".join(line.split(" ")[-FIELDS:])


def segment_counts(text: str, opens: Counter, lines: Counter, closers: list[str]) -> None:
    """Counts the first words of all segments and the complete lines by kind and mark; collects the last words of complete segments."""
    rows = text.split("\n")
    for k, row in enumerate(rows):
        parts = segments_of(row)
        if not parts:
            continue
        for x in parts:
            w = x.split(None, 1)[0]
            opens[w.lower() if w.isalpha() and len(w) <= LONG else _DIGITS.sub("9", w.lower()) if len(w) <= LONG else ""] += 1
        end = parts[-1].rstrip()
        marked = end[-1] in _MARKS or _ENDS.search(end) is not None
        closers += [x.rsplit(None, 1)[-1] for x in parts[:-1]]
        if k + 1 < len(rows):
            lines[kind_of(parts), marked] += 1
        if marked or k + 1 < len(rows):
            closers.append(end.rsplit(None, 1)[-1])


_MULTIPLIERS = T.mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def segments_within(runs: np.ndarray) -> np.ndarray:
    """Number of complete segments of texts with so many runs: segments end at SEGMENT, 2 * SEGMENT, 4 * SEGMENT, ... runs."""
    n = np.maximum(runs, 0) // SEGMENT
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def band_keys(s: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): for each text BANDS keys of every complete segment, from its runs."""
    k = segments_within(np.diff(so))
    first = np.concatenate(([0], np.cumsum(k + 1)))
    owner = np.repeat(np.arange(len(k)), k + 1)
    place = np.arange(first[-1]) - first[:-1][owner]
    start = so[:-1][owner] + np.where(place > 0, SEGMENT << np.maximum(place - 1, 0), 0)
    ends = place == k[owner]
    offsets = np.concatenate(([0], np.cumsum(k * BANDS)))
    out = np.zeros((int(k.sum()), BANDS), np.uint64)
    if len(out):
        padded = np.append(s, np.uint64(0))
        for b in range(BANDS):
            low = np.minimum.reduceat(padded * _MULTIPLIERS[b], start)[~ends]
            out[:, b] = T.mix64(low ^ (place[~ends].astype(np.uint64) << np.uint64(8)) ^ np.uint64(b + 1))
    return out.ravel(), offsets


_EVIDENCE = (
    "kind string, field string, id long, grp string, state int, ctx string, tail string, n long, size int, bands array<long>, last int, node long, look string, word long, probe boolean, found array<string>"
)


def text_nodes(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """One hash for each text's words in their order."""
    place = (np.arange(len(h)) - np.repeat(o[:-1], np.diff(o))).astype(np.uint64)
    return T.set_hashes(T.mix64(h + T.mix64(place)), o)


def last_words(segments: list[str]) -> np.ndarray:
    """Hash of each segment's last word, digits masked; 0 where there is none."""
    h, o = T.word_hashes([_DIGITS.sub("9", x) for x in segments])
    out = np.zeros(len(segments), np.uint64)
    have = np.flatnonzero(np.diff(o))
    out[have] = h[o[1:][have] - 1]
    return out


_NUMBER = T.word_hashes(["9"])[0]


def word_counts(h: np.ndarray, numbers: int, closers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, occurrences, of these at the end of a complete segment); numbers are one word."""
    e = last_words(closers)
    codes, u = pd.factorize(np.concatenate((_NUMBER, e, h)))
    ends = np.bincount(codes[1 : len(e) + 1], minlength=len(u))
    n = np.bincount(codes[len(e) + 1 :], minlength=len(u))
    n[0] += numbers
    return u, n, ends


def count_numbers(texts: list[str | None]) -> int:
    """Runs of digits in all texts."""
    b = np.frombuffer("\n".join(t for t in texts if t).encode("utf-8", "surrogatepass"), np.uint8)
    digit = (b >= 48) & (b <= 57)
    return int(digit[:1].sum() + (digit[1:] & ~digit[:-1]).sum())


def evidence(df: DataFrame, field: str, row_id: str, text: str, group: str, exempt: str | None = None, rules: Callable[[str | None, str | None], list[str]] | None = None) -> DataFrame:
    """One pass over the texts: a row for each value (kind v) with what the rules find in (exempt, text), and counts of inner closings (c), openings (o), complete lines (l) and words (w)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, groups = b.column(0), b.column(1).to_pylist(), b.column(2)
            spared = b.column(3).to_pylist() if b.num_columns > 3 else None
            ends = [end_of(t) for t in texts]
            inner: Counter = Counter()
            opens: Counter = Counter()
            lines: Counter = Counter()
            closers: list[str] = []
            for t, e in zip(texts, ends):
                inner.update(e[3])
                if t:
                    segment_counts(t, opens, lines, closers)
            if spared is not None:
                ends = [(WHOLE, "", "", [], "", False) if e[0] in (CUT, ASK) and s and copied_with_gaps(s, t) else e for e, s, t in zip(ends, spared, texts)]
            h, o = T.word_hashes(texts)
            r, ro = T.shingle_hashes(h, o, SHINGLE)
            keys, ko = band_keys(r, ro)
            w, wn, we = word_counts(h, count_numbers(texts), closers)
            doubt = [segments_of(e[4]) if e[0] == ASK else [] for e in ends]
            n, ni, no, nl = len(ends), len(inner), len(opens), len(lines)
            rest = ni + no + nl + len(w)
            more = ni + no + nl

            def only_values(x: pa.Array) -> pa.Array:
                return pa.concat_arrays([x, pa.nulls(rest, x.type)])

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["v"] * n + ["c"] * ni + ["o"] * no + ["l"] * nl + ["w"] * len(w)),
                    pa.array([field] * (n + rest)),
                    pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(more, pa.int64()), pa.array(T.signed(w))]),
                    only_values(groups.cast(pa.string())),
                    only_values(pa.array([e[0] for e in ends], pa.int32())),
                    pa.array([e[1] for e in ends] + [k[0] for k in inner] + ["O"] * no + [k[0] for k in lines] + ["W"] * len(w), pa.string()),
                    pa.array([e[2] for e in ends] + [k[1] for k in inner] + list(opens) + ["m" if k[1] else "u" for k in lines] + [None] * len(w), pa.string()),
                    pa.array(np.concatenate(([1] * n + list(inner.values()) + list(opens.values()) + list(lines.values()), wn)).astype(np.int64)),
                    pa.array(np.concatenate(([len(t or "") for t in texts] + [0] * more, we)).astype(np.int32)),
                    only_values(pa.ListArray.from_arrays(pa.array(ko.astype(np.int32)), pa.array(T.signed(keys)))),
                    # the last word of a cut value may be cut as well
                    only_values(pa.array(segments_within(np.diff(ro) - 1).astype(np.int32))),
                    only_values(pa.array(T.signed(text_nodes(h, o)))),
                    only_values(pa.array([kind_of(x) if x else None for x in doubt], pa.string())),
                    only_values(pa.array(T.signed(last_words([x[-1] if x else "" for x in doubt])))),
                    only_values(pa.array([e[5] for e in ends], pa.bool_())),
                    only_values(pa.array([rules(s, t) for s, t in zip(spared or [None] * n, texts)] if rules else [None] * n, pa.list_(pa.string()))),
                ],
                names=[c.split()[0] for c in _EVIDENCE.split(", ")],
            )

    cols = [F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(group).cast("string").alias("grp")]
    if exempt:
        cols.append(F.col(exempt).cast("string").alias("exempt"))
    return df.where(F.col(row_id).isNotNull()).select(*cols).mapInArrow(look, _EVIDENCE)


def copied_with_gaps(source: str, text: str | None) -> bool:
    """Whether text gives back most of source with words left out in its midst: such a copy is not cut."""
    a, b = T.words(source), T.words(text)
    if not a or len(b) < 0.7 * len(a) or len(b) >= len(a):
        return False
    i = gaps = 0
    for w in b:
        k = i
        while k < len(a) and a[k] != w:
            k += 1
        if k == len(a):
            return False
        gaps += k > i and i > 0
        i = k + 1
    return gaps > 0


def closing_scores(ev: DataFrame) -> DataFrame:
    """(field, c, tail, look, word) of doubtful closings with the verdict `ends` (true: the corpus ends values so)."""
    v = ev.where("kind = 'v'")
    ctx = F.when(F.col("ctx").startswith("E"), "E").otherwise(F.col("ctx"))
    key = ["field", "c", "tail"]
    doubtful = F.expr("state = 3")
    ends = (
        v.where("tail <> ''").groupBy("field", ctx.alias("c"), "tail")
        .agg(F.count("*").alias("n_end"), F.max(doubtful).alias("doubt"), F.min(F.when(doubtful, F.struct("look", "word"))).alias("s"))
        .select(*key, "n_end", "doubt", "s.look", "s.word")
    )
    inner = ev.where("kind = 'c'").groupBy("field", F.col("ctx").alias("c"), "tail").agg(F.sum("n").alias("n_inner"))
    known = ends.join(inner, key, "full").fillna(0, ["n_end", "n_inner"]).fillna(False, ["doubt"])
    known = written(known.withColumn("n_all", F.col("n_end") + F.col("n_inner")), "closings")
    longer = (
        known.where(~F.startswith("tail", F.lit(HASHED)))
        .select("field", "c", "n_all", "n_inner", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("tail") - 1, F.lit(1))), lambda k: F.col("tail").substr(F.lit(1), k))).alias("p"), "tail")
        .where("p <> tail").groupBy("field", "c", F.col("p").alias("tail")).agg(F.sum("n_all").alias("n_longer"), F.sum("n_inner").alias("n_longer_inner"))
    )
    first = F.element_at(F.split("tail", r"\s+"), 1)
    opened = ev.where("kind = 'o'").groupBy("field", F.col("tail").alias("w")).agg(F.sum("n").alias("n_open"))
    lines = ev.where("kind = 'l'").groupBy("field", F.col("ctx").alias("look")).agg(F.sum("n").alias("n_lines"), F.sum(F.when(F.col("tail") == "u", F.col("n")).otherwise(0)).alias("n_unmarked"))
    words = ev.where("kind = 'w'").groupBy("field", F.col("id").alias("word")).agg(F.sum("n").alias("n_word"), F.sum("size").alias("n_last"))
    doubt = written(known.where("doubt").withColumn("w", first), "doubtful")
    asked = written(doubt.select("field", "word").where("word is not null").distinct(), "asked")
    totals = words.groupBy("field").agg(F.sum("n_last").cast("double").alias("all_last"), F.sum(F.col("n_word") - F.col("n_last")).cast("double").alias("all_inside"))
    words = words.join(small_side(asked), ["field", "word"], "left_semi")
    out = (
        doubt.join(longer, key, "left").join(opened, ["field", "w"], "left").join(lines, ["field", "look"], "left").join(words, ["field", "word"], "left")
        .join(totals, "field", "left").fillna(0, ["all_last", "all_inside", "n_longer", "n_longer_inner", "n_open", "n_lines", "n_unmarked", "n_word", "n_last"])
    )
    dominated = F.col("n_longer") >= DOMINANCE * F.col("n_all")
    in_line = F.col("c").startswith("L")
    line_ok = (F.col("n_inner") > 0) | (F.col("n_longer_inner") == 0)
    rare = F.col("n_end") < TERMINALITY * F.col("n_open")
    inside = F.greatest(F.col("n_word") - F.col("n_last"), F.lit(0)).cast("double")
    marked = F.col("n_lines") - F.col("n_unmarked")
    # n_last / inside over all_last / all_inside, times unmarked / marked, is at least 1
    by_word = (F.col("n_last") >= LEAST_ENDS) & (F.col("n_unmarked") > 0) & (
        F.col("n_last").cast("double") * F.col("all_inside") * F.col("n_unmarked") >= inside * F.col("all_last") * marked
    )
    # a value of one segment has no other to be measured by: only a word that hardly ever ends one speaks against it
    goes_on = (F.col("n_end") < LEAST_ENDS) & (F.col("word") != int(T.signed(_NUMBER)[0])) & (inside >= 20) & (F.col("n_last").cast("double") * F.col("all_inside") < inside * F.col("all_last") / DOMINANCE)
    return out.select(
        *key,
        F.when(in_line, line_ok & ~dominated).otherwise(~dominated & ((~rare & (F.col("n_end") >= LEAST_ENDS)) | by_word)).alias("ends"),
        (~dominated & ~(rare & (F.col("n_open") >= 20)) & ~goes_on).alias("ends_alone"),
    )


# ---- near-copies --------------------------------------------------------------------------------------------------


def bigram_lists(df: DataFrame, ids: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, inner, last): hashes of two words in a row that a third one follows, and the last of them, for the texts with the given ids."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, so = T.shingle_hashes(*T.word_hashes(b.column(1).to_pylist()), 2)
            n = np.maximum(np.diff(so) - 1, 0)
            at = np.repeat(so[:-1] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
            last = np.append(s, np.uint64(0))[np.maximum(so[1:] - 2, 0)]
            d, do = T.distinct_by_text(s[at], np.concatenate(([0], np.cumsum(n))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(do.astype(np.int32)), pa.array(T.signed(d))), pa.array(T.signed(last), mask=n == 0)], names=["id", "inner", "last"]
            )

    return written(texts_of(df, ids, row_id, text).mapInArrow(look, "id long, inner array<long>, last long"), "bigrams")


def texts_of(df: DataFrame, ids: DataFrame, row_id: str, text: str) -> DataFrame:
    base = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return base.join(small_side(ids), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))


def near_copies(ev: DataFrame, df: DataFrame, row_id: str, text: str, hot: int = HOT_BUCKET) -> DataFrame:
    """(node, id, long_id): values that may be cut and every longer text that may continue them.

    A bucket's nodes are its different texts, each with its least id.
    """
    v = ev.where("kind = 'v' and state <> 0")
    own = v.where("probe and last > 0").select("node", "id", "size", F.explode(F.slice("bands", (F.col("last") - 1) * BANDS + 1, BANDS)).alias("key"))
    own = written(own.groupBy("key", "node").agg(F.min("id").alias("id"), F.min("size").alias("size")), "probes")
    asked = written(own.select("key").distinct(), "keys")
    every = v.select("node", "id", "size", F.explode("bands").alias("key")).join(small_side(asked), "key", "left_semi")
    every = written(every.groupBy("key", "node").agg(F.min("id").alias("long_id"), F.max("size").alias("long_size")), "members").withColumnRenamed("node", "long_node")
    sizes = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    few = small_side(written(sizes.where(F.col("n") <= hot).select("key"), "small"))
    fits = (F.col("long_size") > F.col("size")) & (F.col("long_node") != F.col("node"))
    pairs = own.join(few, "key", "left_semi").join(every, "key").where(fits).select("node", "id", "long_id")
    crowded = written(sizes.where(F.col("n") > hot).select("key"), "crowded")
    if not crowded.isEmpty():
        mine, all_ = (x.join(small_side(crowded), "key", "left_semi") for x in (own, every))
        ids = written(mine.select("id").union(all_.select("long_id")).distinct(), "ids")
        # an alignment ends with two whole words of both texts and a third one that may be cut: see aligned_end
        grams = bigram_lists(df, ids, row_id, text)
        a = written(mine.join(grams.drop("inner"), "id").where("last is not null").select("key", "node", "id", "size", F.col("last").alias("gram")), "asked_grams")
        b = all_.join(grams.select(F.col("id").alias("long_id"), "inner"), "long_id").select("key", "long_node", "long_id", "long_size", F.explode("inner").alias("gram"))
        b = b.join(small_side(written(a.select("key", "gram").distinct(), "wanted_grams")), ["key", "gram"], "left_semi")
        met = spread_join(a, written(b, "held_grams"), ["key", "gram"]).where(fits)
        pairs = pairs.unionByName(met.select("node", "id", "long_id"))
    return pairs.distinct()


def _resume(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int] | None:
    """The nearest place after a difference where two words agree again."""
    for d in range(1, WINDOW + 1):
        for x in range(d + 1):
            p, q = i + x, j + d - x
            if p + 1 < len(a) and q + 1 < len(b) and a[p] == b[q] and a[p + 1] == b[q + 1]:
                return p, q
    return None


def aligned_end(a: list[str], b: list[str]) -> tuple[int, bool] | None:
    """Where in b the words of a end, if a is a near-copy of a beginning of b: (number of words of b, whether the last one is cut)."""
    i = j = same = 0
    last = len(a) - 1
    while i < last:
        if j < len(b) and a[i] == b[j]:
            same, i, j = same + 1, i + 1, j + 1
            continue
        if i - same > (1 - SIMILARITY) * last:
            return None
        at = _resume(a[:last], b, i, j)
        if at is None:
            return None
        i, j = at
    if last < 1 or same < SIMILARITY * last or j >= len(b):
        return None
    if a[last] == b[j]:
        return j + 1, False
    return (j + 1, True) if b[j].startswith(a[last]) else None


def ends_early(short: str, long: str) -> bool:
    """Whether short is a near-copy of a beginning of long that stops inside a word, sentence, list or table."""
    a, folded = T.words(short), T.fold(long)
    spans = [(m.start(), m.end()) for m in T.WORD.finditer(folded)]
    end = aligned_end(a, [folded[x:y] for x, y in spans])
    if end is None:
        return False
    k, inside = end
    t = short.rstrip()
    if inside:
        return t[-1].isalnum()
    if k >= len(spans):
        return False
    gap = folded[spans[k - 1][1] : spans[k][0]]
    if "\n" in gap:
        line, follows = t.rsplit("\n", 1)[-1], folded[spans[k - 1][1] :].split("\n", 1)[1].lstrip("\n")
        rows = "|" in line and "|" in follows.split("\n", 1)[0]
        return rows or (_ITEM.match(line) is not None and _ITEM.match(follows) is not None)
    return _TERMINAL.search(t) is None and re.search("[.!?。！？]", gap) is None


def aligned_cuts(df: DataFrame, pairs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(node): the texts whose alignment with a longer one ends early."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select(F.explode(F.array("id", "long_id")).alias("id")).distinct(), "wanted")
    texts = written(texts_of(df, wanted, row_id, text), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [ends_early(s, x) for s, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["node"])

    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("long_id"), F.col("text").alias("longer")), "long_id")
    return both.select("node", "text", "longer").mapInArrow(check, "node long").distinct()


def judged_ends(df: DataFrame, field: str, row_id: str, text: str, group: str, exempt: str | None = None) -> DataFrame:
    """(field, id, grp, cut, by) for every value that is not empty, one row for each id; by: form, copy or closing, what shows a cut."""
    return judged(written(evidence(df, field, row_id, text, group, exempt), "evidence"), df, row_id, text)


def judged(ev: DataFrame, df: DataFrame, row_id: str, text: str) -> DataFrame:
    """judged_ends from its evidence, a table of written()."""
    early = written(aligned_cuts(df, near_copies(ev, df, row_id, text), row_id, text), "early").withColumn("early", F.lit(True))
    scores = written(closing_scores(ev), "scores")
    v = ev.where("kind = 'v' and state <> 0").select("field", "id", "grp", "state", "ctx", "tail", "node", "probe")
    v = v.withColumn("c", F.when(F.col("ctx").startswith("E"), "E").otherwise(F.col("ctx")))
    v = v.join(small_side(scores), ["field", "c", "tail"], "left").join(small_side(early), "node", "left")
    closed = F.when(F.col("ctx") == "E1", F.col("ends_alone")).otherwise(F.col("ends"))
    by = (
        F.when(F.col("state") == CUT, "form").when(F.coalesce("early", F.lit(False)) & F.col("probe"), "copy")
        .when((F.col("state") == ASK) & ~F.coalesce(closed, F.lit(False)), "closing")
    )
    out = v.select("field", "id", "grp", by.alias("by")).groupBy("field", "id").agg(F.min("grp").alias("grp"), F.max("by").alias("by"))
    return out.select("field", "id", "grp", F.col("by").isNotNull().alias("cut"), "by")


def cut_rates(judged: DataFrame) -> DataFrame:
    """(field, grp, n_values, n_cut, rate): how often each source cuts."""
    return judged.groupBy("field", "grp").agg(
        F.count("*").alias("n_values"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate")
    )
