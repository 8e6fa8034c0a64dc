"""Deeply nested semi-structured records turned into related flat tables (problem 3).

Method: columnar shredding.  A record is written leaf by leaf into columns of
(repetition level, definition level, value); the levels alone tell where a
record, a list entry or a missing branch begins.  The table of a repeated
ancestor is then rebuilt from the level sequence of a leaf below it: an entry
whose repetition level is at most the ancestor's depth starts a new instance,
one whose definition level reaches the ancestor's is present, and running counts
over the repetition levels give the instance's place in each enclosing list.
Those places are the parent-child links.

The schema is declared once as a tree of Group, Repeated, Mapping and Leaf.  The
input may deviate from it: a single value stands for a list of one, text that
spells an object or a list counts as that, other non-empty text in an object's
place becomes the field `_raw`, wrapper objects are taken off.  Absent, null and
empty values are undefined at their level and give no row, but null entries keep
their place in a list.  Text that is no JSON gives one row in table `unreadable`;
a null record gives none.  No shuffle is needed: each record is flattened in the
task that reads it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "table string, place array<int>, fields map<string,string>"


@dataclass(frozen=True)
class Leaf:
    """A scalar; nested values are kept as JSON text."""


@dataclass(frozen=True)
class Group:
    fields: dict[str, Any]


@dataclass(frozen=True)
class Repeated:
    element: Any


@dataclass(frozen=True)
class Mapping:
    """An object with open-ended names: a repeated group of key and value."""


@dataclass
class Levels:
    """One leaf column: what the shredder wrote."""

    depth: int
    defined: list[int]  # definition level at which the instance of each repeated ancestor is present
    full: int
    rep: list[int] = field(default_factory=list)
    dfn: list[int] = field(default_factory=list)
    val: list[str | None] = field(default_factory=list)


def spelled(v: Any) -> Any:
    """The object or list that a text spells, else the text itself."""
    if isinstance(v, str) and v[:1].lstrip() in ("", "{", "[") and v.strip()[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def _empty(v: Any) -> bool:
    return v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, (list, dict)) and not v)


def _text(v: Any) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def columns_of(schema: Any) -> dict[str, Levels]:
    """The leaf paths of a schema with their greatest levels."""
    out: dict[str, Levels] = {}

    def walk(node: Any, path: str, depth: int, dfn: int, defined: list[int]) -> None:
        if isinstance(node, Leaf):
            out[path] = Levels(depth, defined, dfn + 1)
        elif isinstance(node, Group):
            for name, child in node.fields.items():
                walk(child, f"{path}.{name}" if path else name, depth, dfn + (1 if path else 0), defined)
        elif isinstance(node, Repeated):
            # +1: the list has an entry, +1: the entry is present
            inner = defined + [dfn + 2]
            if isinstance(node.element, Leaf):
                out[f"{path}[]"] = Levels(depth + 1, inner, dfn + 2)
            else:
                walk(node.element, f"{path}[]", depth + 1, dfn + 1, inner)
        elif isinstance(node, Mapping):
            for part in ("key", "value"):
                out[f"{path}{{}}.{part}"] = Levels(depth + 1, defined + [dfn + 2], dfn + 2)

    walk(schema, "", 0, 0, [])
    return out


def shred(records: list[Any], schema: Any) -> dict[str, Levels]:
    """Writes records (parsed values, in order) into the leaf columns of the schema."""
    cols = columns_of(schema)
    prefixes: dict[str, list[Levels]] = {}

    def below(path: str) -> list[Levels]:
        if path not in prefixes:
            marks = tuple(path + m for m in (".", "[]", "{}"))
            prefixes[path] = [c for p, c in cols.items() if p == path or not path or p.startswith(marks)]
        return prefixes[path]

    def missing(path: str, rep: int, dfn: int) -> None:
        for c in below(path):
            c.rep.append(rep)
            c.dfn.append(dfn)
            c.val.append(None)

    def leaf(c: Levels, rep: int, v: Any, dfn: int) -> None:
        c.rep.append(rep)
        c.dfn.append(dfn if v is None else c.full)
        c.val.append(_text(v))

    def write(node: Any, path: str, v: Any, rep: int, depth: int, dfn: int) -> None:
        if isinstance(node, Leaf):
            leaf(cols[path], rep, v, dfn)
        elif isinstance(node, Group):
            v = spelled(v)
            if _empty(v):
                missing(path, rep, dfn)
                return
            if not isinstance(v, dict):
                v = {"_raw": v}
            inner = dfn + (1 if path else 0)
            for name, child in node.fields.items():
                write(child, f"{path}.{name}" if path else name, v.get(name), rep, depth, inner)
        elif isinstance(node, Repeated):
            v = spelled(v)
            if _empty(v):
                missing(path, rep, dfn)
                return
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                r = rep if i == 0 else depth + 1
                if isinstance(node.element, Leaf):
                    leaf(cols[f"{path}[]"], r, None if _empty(x) else x, dfn + 1)
                elif _empty(x):
                    missing(f"{path}[]", r, dfn + 1)
                else:
                    write(node.element, f"{path}[]", x, r, depth + 1, dfn + 1)
        elif isinstance(node, Mapping):
            v = spelled(v)
            if not _empty(v) and not isinstance(v, dict):
                v = {"_raw": v}
            pairs = [] if _empty(v) else [(k, x) for k, x in v.items()]
            if not pairs:
                missing(path, rep, dfn)
            for i, (k, x) in enumerate(pairs):
                r = rep if i == 0 else depth + 1
                there = not _empty(x)
                leaf(cols[f"{path}{{}}.key"], r, k if there else None, dfn + 1)
                leaf(cols[f"{path}{{}}.value"], r, x if there else None, dfn + 1)

    for v in records:
        write(schema, "", v, 0, 0, 0)
    return cols


def places(c: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(record, place in each enclosing list) of every entry, from the repetition levels alone."""
    rep = np.asarray(c.rep, np.int64)
    record = np.cumsum(rep == 0) - 1
    out = np.zeros((len(rep), c.depth), np.int64)
    for j in range(1, c.depth + 1):
        count = np.cumsum(rep == j)
        base = np.maximum.accumulate(np.where(rep < j, count, 0)) if len(rep) else count
        out[:, j - 1] = count - base
    return record, out


def instances(c: Levels, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, record, places) of the present instances of the ancestor at a depth."""
    rep, dfn = np.asarray(c.rep, np.int64), np.asarray(c.dfn, np.int64)
    record, place = places(c)
    at = np.flatnonzero((rep <= depth) & (dfn >= c.defined[depth - 1]))
    return at, record[at], place[at, :depth]


def rebuild(cols: dict[str, Levels], path: str) -> list[tuple[int, tuple[int, ...], dict[str, str | None]]]:
    """Rows (record, places, leaf values) of the repeated ancestor at `path`, such as steps[].tool_calls[]."""
    depth = path.count("[]") + path.count("{}")
    own = {p: c for p, c in cols.items() if c.depth == depth and (p == path or p.startswith(path + "."))}
    rows: dict[tuple[int, tuple[int, ...]], dict[str, str | None]] = {}
    for p, c in own.items():
        at, record, place = instances(c, depth)
        name = p[len(path) + 1 :] or "value"
        for e, r, pl in zip(at.tolist(), record.tolist(), map(tuple, place.tolist())):
            rows.setdefault((r, pl), {})[name] = c.val[e]
    return [(r, pl, f) for (r, pl), f in sorted(rows.items())]


def unwrap(v: Any, wrappers: tuple[str, ...]) -> Any:
    for w in wrappers:
        inner = spelled(v.get(w)) if isinstance(v, dict) else None
        if isinstance(inner, dict):
            v = inner
    return v


def _no_constant(name: str) -> Any:
    raise ValueError(name)


#: Records that are opened at a time.
SLICE = 1_000


def nested_nodes(
    df: DataFrame,
    record: str,
    keys: list[str],
    schema: Group,
    tables: dict[str, str],
    wrappers: tuple[str, ...] = (),
    links: Callable[[dict[str, list]], None] | None = None,
) -> DataFrame:
    """Long form of all flat tables: the key columns, `table`, `place` and `fields`.

    tables maps a table's name to the path of its repeated ancestor.  `place`
    holds the place of the instance in each enclosing list from the outermost in,
    so a parent's `place` is a prefix of its child's.  links may complete the
    tables of a batch, for example by resolving references inside a record.
    """
    paths = dict(tables)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            parsed, rows_at, bad = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if text is None:
                    continue
                try:
                    v = unwrap(json.loads(text, parse_constant=_no_constant), wrappers)
                except (ValueError, RecursionError):
                    bad.append(i)
                    continue
                if isinstance(v, dict):
                    parsed.append(v)
                    rows_at.append(i)
            cols = shred(parsed, schema)
            flat: dict[str, list] = {name: rebuild(cols, path) for name, path in paths.items()}
            if links:
                links(flat)
            owner, table, place, fields = [], [], [], []
            for i in bad:
                owner.append(i)
                table.append("unreadable")
                place.append([])
                fields.append([])
            for name, rows in flat.items():
                for r, pl, f in rows:
                    owner.append(rows_at[r])
                    table.append(name)
                    place.append(list(pl))
                    fields.append(list(f.items()))
            key_columns = [b.column(k).take(pa.array(owner, pa.int64())) for k in range(b.num_columns - 1)]
            arrays = [*key_columns, pa.array(table, pa.string()), pa.array(place, pa.list_(pa.int32())), pa.array(fields, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(len(keys))), "table", "place", "fields"])

    chosen = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{record}`").cast("string").alias("r"))
    kinds = dict(chosen.dtypes)
    out = chosen.mapInArrow(flatten, ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keys))), NODE_SCHEMA]))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "table", "place", "fields")


def flat_table(nodes: DataFrame, keys: list[str], name: str, levels: list[str], fields: list[str]) -> DataFrame:
    """One related flat table out of nested_nodes(): keys, a column for each level's place, the fields."""
    return nodes.where(F.col("table") == name).select(
        *keys, *[F.col("place")[i].alias(c) for i, c in enumerate(levels)], *[F.col("fields")[c].alias(c) for c in fields]
    )


_L = Leaf()
TRAJECTORY = Group(
    {
        "steps": Repeated(
            Group(
                {
                    **dict.fromkeys(["step_index", "content", "status", "start_position", "end_position", "generation_time_ms", "_raw"], _L),
                    "tool_calls": Repeated(Group({"tool_name": _L, "raw_text": _L, "_raw": _L, "tool_input": Mapping()})),
                    "tool_outputs": Repeated(
                        Group({**dict.fromkeys(["tool_name", "result", "status", "error", "execution_time_ms", "_raw"], _L), "processed_images": Repeated(_L)})
                    ),
                    "verification": Repeated(Group(dict.fromkeys(["step_index", "score", "confidence", "critique", "tool_check", "_raw"], _L))),
                    "repair": Repeated(Group(dict.fromkeys(["action", "target_step", "patch_type", "new_content", "_raw"], _L))),
                }
            )
        ),
        "verifications": Repeated(Group(dict.fromkeys(["step_index", "score", "confidence", "critique", "tool_check", "_raw"], _L))),
    }
)
TRAJECTORY_TABLES = {
    "step": "steps[]",
    "tool_call": "steps[].tool_calls[]",
    "tool_arg": "steps[].tool_calls[].tool_input{}",
    "tool_output": "steps[].tool_outputs[]",
    "processed_image": "steps[].tool_outputs[].processed_images[]",
    "verification": "steps[].verification[]",
    "repair": "steps[].repair[]",
    "outside": "verifications[]",
}


def _index(v: str | None) -> str | None:
    """A step index as text: 3, "3" and 3.0 are the same."""
    try:
        f = float(v) if v is not None else None
    except ValueError:
        return v.strip()
    return None if f is None else str(int(f)) if f == int(f) else str(f)


def place_verifications(flat: dict[str, list]) -> None:
    """Moves verifications kept outside their step to the step with the same step_index, -1 if none has it."""
    steps: dict[tuple[int, str], int] = {}
    for r, pl, f in flat["step"]:
        k = _index(f.get("step_index"))
        if k is not None:
            steps.setdefault((r, k), pl[0])
    for r, pl, f in flat.pop("outside"):
        k = _index(f.get("step_index"))
        flat["verification"].append((r, (steps.get((r, k), -1) if k is not None else -1, pl[0]), f))


def trajectory_nodes(df: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """The flat tables of trajectory records in long form (see nested_nodes)."""
    return nested_nodes(df, record, keys, TRAJECTORY, TRAJECTORY_TABLES, ("trajectory",), place_verifications)


def trajectory_links(nodes: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """(key, node, step_no, item_no, leaf): one row for each node with the link to its parent."""
    t, p = F.col("table"), F.col("place")
    item = F.when(t.isin("tool_call", "tool_arg", "tool_output", "processed_image"), p[1]).otherwise(0)
    leaf = F.when(t == "tool_arg", F.col("fields")["key"]).when(t == "processed_image", p[2].cast("string")).otherwise("")
    return nodes.select(
        F.col(key), t.alias("node"), F.when(t == "unreadable", -1).otherwise(p[0]).cast("int").alias("step_no"),
        item.cast("int").alias("item_no"), leaf.alias("leaf"),
    )
