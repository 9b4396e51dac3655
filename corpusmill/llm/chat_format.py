"""Chat formatting of the maximal conversations of a log.

A log that stores a conversation after each exchange holds it many times, each a prefix of
the next. Each turn has a digest (SHA-256 of its number, role and text, taken as 128 bits);
the rolling state after a turn combines it with the state before, and counts the rows, so
that prefixes have equal states. A conversation whose final state is an inner state of
another is a snapshot and goes, by an anti-join; of equal conversations the smallest conv_id
stays. The rest are rendered.

Only digests are moved until the rest is known. States roll inside spans of SPAN turns and
then over the spans, so a conversation of any length is spread over tasks until it is
rendered; a rendered conversation is one value.

Results for odd input: rows with a null conv_id are left out; a null role or text is
empty; a null turn comes first; rows that repeat a turn exactly count once; different rows
of one turn are ordered by role and text and enter states together; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024
STATE = ("x", "y", "n")


def turns(log: DataFrame) -> DataFrame:
    t = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.filter("conv_id is not null")


def states(t: DataFrame) -> DataFrame:
    """conv_id, turn, the state after it, and whether it is the last."""
    digest = F.sha2(F.concat_ws(":", "turn", F.length("role"), "role", "text").cast("binary"), 256)
    rows = t.select("conv_id", F.floor(F.col("turn") / SPAN).alias("span"), "turn", digest.alias("digest"))
    # all that follows, but for a row a span, stays in these partitions
    rows = rows.select("conv_id", "span", "turn", F.xxhash64("digest").alias("x"), F.xxhash64(F.lit(7), "digest").alias("y")).repartition("conv_id", "span").distinct()
    each = rows.groupBy("conv_id", "span", "turn").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("n"))
    roll = {"x": F.bit_xor, "y": F.bit_xor, "n": F.sum}
    order = Window.partitionBy("conv_id", "span").orderBy("turn")
    running = each.select("conv_id", "span", "turn", *[f(k).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, f in roll.items()], F.lead("turn").over(order).isNull().alias("last"))
    spans = Window.partitionBy("conv_id").orderBy("span")
    before = each.groupBy("conv_id", "span").agg(*[f(k).alias(k) for k, f in roll.items()])
    before = before.select("conv_id", "span", *[F.coalesce(f(k).over(spans.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{k}0") for k, f in roll.items()], F.lead("span").over(spans).isNull().alias("ends"))
    joined = [F.col(k).bitwiseXOR(F.col(f"{k}0")).alias(k) for k in ("x", "y")]
    return running.join(before, ["conv_id", "span"]).select("conv_id", "turn", *joined, (F.col("n") + F.col("n0")).alias("n"), (F.col("last") & F.col("ends")).alias("final"))


def maximal(t: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that prefix no longer one, each text once."""
    s = states(t)
    final = s.filter("final").groupBy(*STATE).agg(F.min("conv_id").alias("conv_id"))
    return final.join(s.filter("not final").select(*STATE), list(STATE), "left_anti").select("conv_id")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(log: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of each maximal conversation."""
    t = turns(log)
    kept = t.join(maximal(t), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    each = F.transform("turns", lambda x: segment(x["role"], x["text"]))
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(each, "").alias("text"))


SQL = """
with t as (select distinct conv_id, coalesce(turn, -4611686018427387904) turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
seg as (select conv_id, turn, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece, '[' || turn || ':' || length(role) || ':' || length(text) || ']' || role || text as mark from t),
per as (select conv_id, turn, string_agg(mark, '' order by role, text) as mark from seg group by conv_id, turn),
pre as (select conv_id, turn, sha256(string_agg(mark, '' ) over (partition by conv_id order by turn rows unbounded preceding)) as state, turn = max(turn) over (partition by conv_id) as final from per),
kept as (select min(conv_id) as conv_id from pre where final and state not in (select state from pre where not final) group by state)
select conv_id, count(*) as n_turns, string_agg(piece, '' order by turn, role, text) as text from seg where conv_id in (select conv_id from kept) group by conv_id
"""
