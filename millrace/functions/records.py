"""Records inside texts: verifications, repairs, tool calls, steps and interpreter blocks; and what code and commands must not hold.

A record is a flat JSON object (no braces inside).  Objects that are no JSON count
as absent.  Null text gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.answers import FORBIDDEN_CALLS, every, last, strip
from millrace.functions.arrays import let

VERIFICATION = "step_index int, score double, confidence double, critique string, tool_check boolean"
REPAIR = "action string, target_step int, patch_type string, new_content string, justification string"
CALL = "tool_name string, tool_input string"
VERIFICATION_KEYS = ["step_index", "score", "confidence", "critique"]
REPAIR_ACTIONS = ["PATCH", "NO_CHANGE"]


def objects_with(text: Column, key: str) -> Column:
    """All flat objects that hold the quoted key, as text, in order."""
    return every(text, rf'(?s)\{{[^{{}}]*"{key}"[^{{}}]*\}}', 0)


def has_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has all keys, whatever their values; null for text that is no object."""
    have = F.json_object_keys(json)
    return reduce(lambda a, b: a & b, [F.array_contains(have, k) for k in keys])


def verification(text: Column) -> Column:
    """The last verification as a struct; null unless it is JSON with all four keys."""
    return let(last(objects_with(text, "step_index")), lambda j: F.when(has_keys(j, VERIFICATION_KEYS), F.from_json(j, VERIFICATION)))


def verification_format(text: Column) -> Column:
    """struct(has_json, has_all_fields, is_valid) of the first verification."""
    first = F.try_element_at(objects_with(text, "step_index"), F.lit(1))
    ok = F.coalesce(has_keys(first, VERIFICATION_KEYS), F.lit(False))
    return F.struct(F.json_object_keys(first).isNotNull().alias("has_json"), ok.alias("has_all_fields"), ok.alias("is_valid"))


def repair(text: Column) -> Column:
    """The last repair instruction as a struct; null unless its action is known."""
    return let(last(objects_with(text, "action")), lambda j: F.when(F.get_json_object(j, "$.action").isin(REPAIR_ACTIONS), F.from_json(j, REPAIR)))


def repair_format(text: Column) -> Column:
    """struct(has_json, has_action, valid_action) of the first repair instruction."""
    first = F.try_element_at(objects_with(text, "action"), F.lit(1))
    known = F.coalesce(F.get_json_object(first, "$.action").isin(REPAIR_ACTIONS), F.lit(False))
    return F.struct(F.json_object_keys(first).isNotNull().alias("has_json"), F.coalesce(has_keys(first, ["action"]), F.lit(False)).alias("has_action"), known.alias("valid_action"))


def tool_calls(text: Column) -> Column:
    """Flat JSON objects that name a tool, as structs."""
    good = F.filter(objects_with(text, "tool_name"), lambda j: F.coalesce(has_keys(j, ["tool_name"]), F.lit(False)))
    return F.transform(good, lambda j: F.from_json(j, CALL))


def tagged_calls(text: Column, tag: str = "tool_call") -> Column:
    """struct(name, arguments) of the JSON between call tags; what is no JSON or has no name is left out."""
    inner = F.transform(every(text, rf"(?s)<{tag}>(.*?)</{tag}>"), strip)
    good = F.filter(inner, lambda j: F.coalesce(has_keys(j, ["name", "arguments"]), F.lit(False)))
    return F.transform(good, lambda j: F.from_json(j, "name string, arguments string"))


def untagged(text: Column, tag: str = "tool_call") -> Column:
    """The text without the tagged calls."""
    return F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")


def steps_with_calls(text: Column) -> Column:
    """struct(step_index from 1, reasoning, calls) of each think block and what follows it up to the next one."""
    blocks = every(text, r"(?is)<think>.*?</think>.*?(?=<think>|$)", 0)
    call = rf"(?s)\{{\"tool_name\":\"[^\"]+\",\"tool_input\":\{{[^}}]+\}}\}}"

    def one(b: Column, i: Column) -> Column:
        after = F.regexp_replace(b, r"(?is)^<think>.*?</think>", "")
        calls = F.filter(every(after, call, 0), lambda j: F.json_object_keys(j).isNotNull())
        return F.struct((i + 1).alias("step_index"), strip(F.regexp_extract(b, r"(?is)^<think>(.*?)</think>", 1)).alias("reasoning"), F.transform(calls, lambda j: F.from_json(j, CALL)).alias("calls"))

    return F.transform(blocks, one)


def before_and_after(text: Column, tag: str = "interpreter") -> Column:
    """struct(inside, rest): what the first block of the tag holds and what follows it; nulls where there is none."""
    inside = F.try_element_at(every(text, rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    rest = F.try_element_at(every(text, rf"(?s)^.*?<{tag}>.*?</{tag}>(.*)$"), F.lit(1))
    return F.struct(strip(inside).alias("inside"), rest.alias("rest"))


def sql_solution(last_action: Column, actions: Column) -> Column:
    """struct(valid, sql): the last action holds a solution and every action begins with a think block; the SQL may stand in sql tags instead."""
    valid = F.regexp_like(last_action, F.lit(r"(?s)<solution>.*?</solution>")) & F.forall(actions, lambda a: F.regexp_like(a, F.lit(r"(?s)^\s*<think>.*?</think>")))
    found = F.coalesce(last(every(last_action, r"(?s)<solution>(.*?)</solution>")), last(every(last_action, r"(?s)<sql>(.*?)</sql>")))
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), strip(found).alias("sql"))


# ---- code and commands --------------------------------------------------------------------------------------------

#: Parts that make code of a language unsafe (fixed values).
UNSAFE = {
    "python": [f"{w} {m}" for m in ("subprocess", "multiprocessing", "threading", "socket") for w in ("import", "from")] + FORBIDDEN_CALLS,
    "javascript": ["process.exit", "child_process", "require('child_process')", "fs.writeFile", "fs.write", "fs.unlink", "fs.rmdir"],
    "cpp": ["system(", "exec(", "fork(", "popen("],
}
#: Parts of commands that are refused (fixed values).
REFUSED_PARTS = [
    "rm -rf /", "dd if=", "mkfs", "fdisk", "mount", "umount", "passwd", "su ", "sudo ", "chroot", "systemctl", "service", "iptables", "ufw", "firewall-cmd", "nc ", "ncat ", "telnet ", "ssh ", "scp ", "rsync ",
    "curl http", "wget http", "lynx", "w3m", "crontab", "batch", "kill -9", "killall", "pkill ", "> /dev/", "< /dev/", "mknod", "losetup",
]
#: Patterns of commands that are refused (fixed values).
REFUSED_PATTERNS = [
    r"rm\s+.*-rf\s+/", r">\s*/etc/", r">\s*/bin/", r">\s*/usr/", r">\s*/var/", r"chmod\s+777", r"find\s+/.*-exec", r"eval\s+.*[;&|]", r"source\s+/", r"\.\s+/",
]


def is_safe(code: Column, language: Column) -> Column:
    """Whether code holds none of its language's unsafe parts; other languages are safe."""
    out = F.lit(True)
    for name, parts in UNSAFE.items():
        hit = reduce(lambda a, b: a | b, [F.contains(code, F.lit(p)) for p in parts])
        out = F.when(F.lower(language) == name, ~hit).otherwise(out)
    return out


def refused_commands(command: Column) -> Column:
    """The first refused part of a command, else what the first matching pattern finds, else an empty array."""
    low = F.lower(command)
    part = F.try_element_at(F.filter(F.array(*[F.lit(p) for p in REFUSED_PARTS]), lambda p: F.contains(low, p)), F.lit(1))
    found = F.filter(F.array(*[every(low, p, 0) for p in REFUSED_PATTERNS]), lambda x: F.size(x) > 0)
    return F.when(part.isNotNull(), F.array(part)).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.array().cast("array<string>")))
