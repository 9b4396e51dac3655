"""A small rule language for records, compiled to one SQL expression.

A line is `condition && condition => action, action`; a backslash at its end continues it on
the next. The first line whose conditions all hold decides; its actions run in order.
Conditions:

    *   true   exists(name)
    name == "x"   name != "x"   <   <=   >   >=   and the same with whole numbers
    name =~ /re/i   name !~ /re/   the pattern has to match the whole value
    name =~ s/re/text/gi   replaces in the record and holds if the pattern was found anywhere
    name =~ 10.0.0.0/8   name !~ fe80::/10   the address lies in the network (== and != as well)

and actions: ACCEPT, DROP, CONTINUE, name = "x", name = 3, clear(name). Names are columns,
or map entries as headers->Name. Without a decision a record is accepted. A null value equals
and matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import full_match, ip6_in_prefix, ip_in_prefix

_CONDITION = re.compile(r"\s*(?:(true|\*)|exists\((\w+(?:->[\w-]+)?)\)|(\w+(?:->[\w-]+)?)\s*(==|!=|<=|>=|<|>|=~|!~)\s*(.+?))\s*$", re.DOTALL)


@dataclass
class Rule:
    conditions: list[str]
    decision: str = "CONTINUE"
    changes: list[tuple[str, str | None]] = field(default_factory=list)


def parse(text: str) -> list[Rule]:
    rules = []
    for line in re.sub(r"\\\n", " ", text).splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        left, arrow, right = line.partition("=>")
        if not arrow:
            raise ValueError(f"a rule needs '=>': {line}")
        rule = Rule([c for c in re.split(r"\s*&&\s*", left.strip()) if c])
        for action in re.split(r"\s*,\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", right.strip()):
            if action in ("ACCEPT", "DROP", "CONTINUE"):
                rule.decision = action
            elif m := re.fullmatch(r"clear\((\w+(?:->[\w-]+)?)\)", action):
                rule.changes.append((m[1], None))
            elif m := re.fullmatch(r"(\w+)\s*=\s*(.+)", action):
                rule.changes.append((m[1], m[2]))
            else:
                raise ValueError(f"no such action: {action}")
        rules.append(rule)
    return rules


def _value(name: str) -> Column:
    column, arrow, key = name.partition("->")
    return F.col(column)[key] if arrow else F.col(column)


def _regex(text: str) -> tuple[str, str | None, str]:
    m = re.fullmatch(r"(s?)/((?:[^/\\]|\\.)*)/(?:((?:[^/\\]|\\.)*)/)?([ig]*)", text, re.DOTALL)
    if not m:
        raise ValueError(f"no such pattern: {text}")
    return ("(?i)" if "i" in m[4] else "") + m[2].replace("\\/", "/"), m[3] if m[1] else None, m[4]


def condition(text: str) -> Column:
    m = _CONDITION.match(text)
    if not m:
        raise ValueError(f"no such condition: {text}")
    if m[1]:
        return F.lit(True)
    if m[2]:
        return _value(m[2]).isNotNull()
    left, op, right = _value(m[3]), m[4], m[5].strip()
    equal = op in ("==", "=~")
    if op in ("=~", "!~", "==", "!=") and (network := re.fullmatch(r"([0-9.]+|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*)(?:/(\d+))?", right)) and re.search(r"\..*\.|:", right):
        six = ":" in network[1]
        found = (ip6_in_prefix if six else ip_in_prefix)(left, network[1], int(network[2] or (128 if six else 32)))
        return F.coalesce(found if equal else ~found, F.lit(not equal))
    if op in ("=~", "!~"):
        pattern, new, _ = _regex(right)
        found = left.rlike(pattern) if new is not None else full_match(left, pattern)
        return F.coalesce(found if equal else ~found, F.lit(not equal))
    other = F.lit(right[1:-1]) if right[:1] == '"' else F.lit(int(right)) if re.fullmatch(r"[+-]?\d+", right) else F.lit(right)
    got = {"==": left == other, "!=": left != other, "<": left < other, "<=": left <= other, ">": left > other, ">=": left >= other}[op]
    return F.coalesce(got, F.lit(op == "!="))


def apply(records: DataFrame, text: str) -> DataFrame:
    """Records that aren't dropped, with the changes of their rules."""
    out = records.withColumn("__decision", F.lit(None).cast("string"))
    for rule in parse(text):
        open_ = F.col("__decision").isNull()
        holds = open_
        edits: list[tuple[str, Column]] = []
        for c in rule.conditions:
            holds = holds & condition(c)
            m = _CONDITION.match(c)
            if m and m[4] == "=~" and m[5].startswith("s/") and (parts := _regex(m[5].strip())):
                target = F.regexp_replace(_value(m[3]), parts[0] if "g" in parts[2] else f"^(?s)(.*?){parts[0]}", parts[1] if "g" in parts[2] else "$1" + parts[1])
                edits.append((m[3], target))
        out = out.withColumn("__holds", holds)
        for name, new in edits:
            out = _set(out, name, new)
        for name, value in rule.changes:
            out = _set(out, name, F.lit(None) if value is None else F.lit(value[1:-1] if value[:1] == '"' else int(value) if re.fullmatch(r"[+-]?\d+", value) else value))
        if rule.decision != "CONTINUE":
            out = out.withColumn("__decision", F.when(F.col("__holds"), rule.decision).otherwise(F.col("__decision")))
    return out.filter(F.coalesce(F.col("__decision") != "DROP", F.lit(True))).drop("__decision", "__holds")


def _set(df: DataFrame, name: str, new: Column) -> DataFrame:
    column, arrow, key = name.partition("->")
    if not arrow:
        return df.withColumn(column, F.when(F.col("__holds"), new.cast(df.schema[column].dataType)).otherwise(F.col(column)))
    rest = F.map_filter(column, lambda k, _: k != key)
    return df.withColumn(column, F.when(F.col("__holds"), F.when(new.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), new.cast("string"))))).otherwise(F.col(column)))


def where(records: DataFrame, sql: str) -> DataFrame:
    """Free conditions are SQL expressions; no code of users is evaluated."""
    return records.filter(F.expr(sql))
