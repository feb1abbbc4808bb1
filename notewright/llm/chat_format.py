"""Operator 1: tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by conversation and identifier.  The order of calls is topological:
level by level, calls whose prerequisites are done are peeled off.  Conversations of up to
``GATHERED`` calls are peeled as a stream of identifiers, one conversation in memory at a time; in
larger ones pointers jump over chains and rounds over narrow rows do the rest, so a conversation of any
size is never gathered in one task.  Arguments are checked against a JSON schema by name.  Canonical JSON has sorted keys, no white space, and escapes only where JSON
needs them.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from notewright.llm import common

#: JSON schema types and the Python types that they admit.
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
#: Calls of a conversation that a task may hold (identifiers only).
GATHERED = 100_000
LONE = re.compile("[\ud800-\udfff]")


def spelled(text: str) -> str:
    """The text with surrogates that stand alone, which no UTF-8 holds, as their JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return spelled(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def violations(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, required, properties, additionalProperties, items,
    minLength, maxLength, minimum and maximum of JSON schema.  A type that JSON schema does not have
    is an error of its own."""
    found = []
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else list(kinds)
        strange = [str(k) for k in names if k not in TYPES]
        if strange:
            return [f"{at}: schema has no type {'|'.join(strange)}"]
        if not any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in names):
            return [f"{at}: not {'|'.join(names)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    return found


def checked(schemas: Mapping[str, Mapping]):
    """A pandas UDF: canonical arguments and what is wrong with them, from a tool's name and raw JSON."""
    fixed = dict(schemas)

    @F.pandas_udf("canonical string, errors array<string>")
    def check(name: pd.Series, raw: pd.Series) -> pd.DataFrame:
        out = []
        for n, r in zip(name, raw, strict=True):
            try:
                value = json.loads(r)
                text = canonical(value)
            except (TypeError, ValueError):
                out.append((None, ["$: not JSON"]))
                continue
            except RecursionError:
                out.append((None, ["$: nested too deeply"]))
                continue
            out.append((text, [spelled(e) for e in violations(value, fixed[n])] if n in fixed else ["$: unknown tool"]))
        return pd.DataFrame(out, columns=["canonical", "errors"])

    return check


def json_text(value: Column) -> Column:
    """A string (or null) as JSON."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def peeled(needs: Mapping[str, Mapping[str, int]], least: Mapping[str, int | None]) -> dict[str, int]:
    """Levels of the calls of one conversation: for each the calls it comes after and by how many
    levels, and its least level (None: it never gets one).  Calls in or behind a cycle are left out."""
    behind: dict[str, list[tuple[str, int]]] = {}
    left = {}
    for c, after in needs.items():
        known = [(x, far) for x, far in after.items() if x in needs]
        left[c] = len(known)
        for x, far in known:
            behind.setdefault(x, []).append((c, far))
    out = dict(least)
    ready = [c for c, n in left.items() if not n and out[c] is not None]
    for c in ready:  # grows as calls become free
        for d, far in behind.get(c, ()):
            left[d] -= 1
            if out[d] is not None:
                out[d] = max(out[d], out[c] + far)
                if not left[d]:
                    ready.append(d)
    return {c: out[c] for c in ready}


def _gathered_levels(calls: DataFrame) -> DataFrame:
    """Levels from ``conv_id, call_id, after, far, least``, one conversation in memory at a time."""
    kinds = {c: calls.schema[c].dataType.simpleString() for c in ("conv_id", "call_id")}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, needs, least = None, {}, {}

        def flush() -> pd.DataFrame:
            found = peeled(needs, least)
            return pd.DataFrame({"conv_id": [now] * len(needs), "call_id": list(needs), "level": pd.array([found.get(c) for c in needs], "Int64")})

        for batch in batches:
            done = []
            for conv, call, after, far, low in zip(*(batch[c] for c in ("conv_id", "call_id", "after", "far", "least")), strict=True):
                if conv != now:
                    if needs:
                        done.append(flush())
                    now, needs, least = conv, {}, {}
                needs[call] = dict(zip(after, map(int, far), strict=True))
                least[call] = None if pd.isna(low) else int(low)
            if done:
                yield pd.concat(done, ignore_index=True)
        if needs:
            yield flush()

    # A number of partitions that is given is kept, however small the table looks.
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = calls.select("conv_id", "call_id", "after", "far", "least").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "call_id")
    return rows.mapInPandas(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level long")


def _chains(single: DataFrame, tables: common.Tables) -> DataFrame:
    """``conv_id, call_id, to, far``: where each chain of calls with one prerequisite (``to``) starts,
    and how far that is.  Pointers jump over pointers, so rounds are the binary digits of a length; a
    pointer that still ends inside a chain then is in or behind a cycle."""
    jump = tables.put("jump-0", single.withColumn("far", F.lit(1).cast("long")))
    rounds = math.ceil(math.log2(max(2, jump.count()))) + 1
    for i in range(rounds):
        ahead = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("then"), F.col("far").alias("more"))
        new = jump.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("then", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("then").isNotNull().alias("moved"))
        new = tables.put(f"jump-{i + 1}", new)
        tables.drop(f"jump-{i}")
        jump = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    return jump


def _knot_rounds(knots: DataFrame, edges: DataFrame, tables: common.Tables) -> DataFrame:
    """Levels of ``knots`` (conv_id, call_id, least) by ``edges`` (conv_id, call_id, needs, far) between
    them, peeled in as many rounds as a path has knots."""
    key = ["conv_id", "call_id"]
    todo, left, done, i = tables.put("todo-0", knots), tables.put("left-0", edges), None, 0
    while True:
        ready = todo.where("least is not null").join(left.select(*key).distinct(), key, "left_anti")
        ready = tables.put(f"ready-{i}", ready.withColumnRenamed("least", "level"))
        done = ready if done is None else done.unionByName(ready)
        if not ready.limit(1).count():
            return done
        freed = ready.select("conv_id", F.col("call_id").alias("needs"), "level")
        told = left.join(freed, ["conv_id", "needs"]).groupBy(*key).agg(F.max(F.col("level") + F.col("far")).alias("told"))
        rest = todo.join(ready.select(*key), key, "left_anti").join(told, key, "left")
        todo = tables.put(f"todo-{i + 1}", rest.select(*key, F.when(F.col("least").isNotNull(), F.greatest("least", F.coalesce("told", F.lit(0)))).alias("least")))
        left = tables.put(f"left-{i + 1}", left.join(freed.select("conv_id", "needs"), ["conv_id", "needs"], "left_anti"))
        tables.drop(f"todo-{i}", f"left-{i}")
        i += 1


def _wide_levels(calls: DataFrame, tables: common.Tables, gathered: int) -> DataFrame:
    """Levels in conversations of any size.

    Chains of calls with one prerequisite are jumped over.  The calls with several, the *knots*, are
    left; a conversation with up to ``gathered`` of them is done in one task, else they go in rounds.
    """
    key = ["conv_id", "call_id"]
    nodes = tables.put("nodes", calls.select(*key).distinct())
    edges = calls.select(*key, F.explode("after").alias("needs")).distinct()
    edges = tables.put("edges", edges.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").select(*key, "needs"))
    many = tables.put("many", edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to")))
    first = tables.put("first", nodes.join(many, key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    jump = _chains(many.where("n = 1").select(*key, "to"), tables)
    knot = many.where("n > 1").select(*key)
    # The knots' edges, past the chains, and what they lead to.
    over = jump.select("conv_id", F.col("call_id").alias("needs"), "to", "far")
    past = edges.join(knot, key, "left_semi").join(over, ["conv_id", "needs"], "left")
    past = past.groupBy(*key, F.coalesce("to", "needs").alias("needs")).agg(F.max(F.coalesce("far", F.lit(0)) + 1).alias("far"))
    named = first.select("conv_id", F.col("call_id").alias("needs"), F.lit(1).alias("kind")).unionByName(knot.select("conv_id", F.col("call_id").alias("needs"), F.lit(2).alias("kind")))
    past = tables.put("past", past.join(named, ["conv_id", "needs"], "left"))
    inner = F.when(F.col("kind") == 2, F.struct(F.col("needs").alias("id"), F.col("far").alias("far")))
    least = F.when(F.count("kind") == F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("far"))), F.lit(0)))
    size = knot.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    wide = tables.put("wide", size.where(F.col("n") > gathered).select("conv_id"))
    held = past.join(wide, "conv_id", "left_anti").groupBy(*key).agg(least.alias("least"), F.collect_list(inner).alias("e"))
    found = _gathered_levels(held.select(*key, F.transform("e", lambda e: e["id"]).alias("after"), F.transform("e", lambda e: e["far"]).alias("far"), "least"))
    if wide.limit(1).count():
        rows = past.join(wide, "conv_id", "left_semi")
        found = found.unionByName(_knot_rounds(rows.groupBy(*key).agg(least.alias("least")), rows.where("kind = 2").select(*key, "needs", "far"), tables))
    known = tables.put("known", first.unionByName(found.where("level is not null")))
    ends = known.select("conv_id", F.col("call_id").alias("to"), "level")
    chained = jump.join(ends, ["conv_id", "to"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return nodes.join(known.unionByName(chained), key, "left").select(*key, "level")


def levels(calls: DataFrame, tables: common.Tables, gathered: int = GATHERED) -> DataFrame:
    """``conv_id, call_id, level``: 0 for calls without a prerequisite among the calls, else one more
    than the latest of them; null for calls in or behind a cycle.  A call is here once."""
    large = tables.put("large", calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > gathered).select("conv_id"))
    plain = lambda rows: rows.select("conv_id", "call_id", "after", F.transform("after", lambda _: F.lit(1)).alias("far"), F.lit(0).alias("least"))
    if not large.limit(1).count():
        return _gathered_levels(plain(calls))
    return _gathered_levels(plain(calls.join(large, "conv_id", "left_anti"))).unionByName(_wide_levels(calls.join(large, "conv_id", "left_semi"), tables, gathered))


def positions(leveled: DataFrame, tables: common.Tables) -> DataFrame:
    """``conv_id, call_id, level, position`` from ``conv_id, call_id, turn, level``.

    All calls are put in one order by ranges; a call's place is its range's offset plus its place in
    the range, less the first place of its conversation.  So a conversation of any size is as many
    tasks as it has ranges.
    """
    keys = ["conv_id", "level", "turn", "call_id"]
    parts = int(leveled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = leveled.where("level is not null").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = tables.put("ranged", ranged.withColumn("place", F.monotonically_increasing_id()).select("conv_id", "call_id", "level", F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    # One row for each range, in one window.
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranged.join(F.broadcast(offsets), "range").withColumn("place", F.col("offset") + F.col("place"))
    firsts = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    placed = placed.join(firsts, "conv_id").select("conv_id", "call_id", "level", (F.col("place") - F.col("first") + 1).alias("position"))
    return placed.unionByName(leveled.where("level is null").select("conv_id", "call_id", "level", F.lit(None).cast("long").alias("position")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], gathered: int = GATHERED) -> DataFrame:
    """Links ``calls`` (conv_id, call_id, turn, name, arguments, after) with ``results`` (conv_id,
    call_id, turn, content).

    One row for each call, and for each result without a call: ``conv_id, call_id, name, turn, status,
    level, position, errors, canonical_json``.  ``status`` is ``linked``, ``no_result`` or ``orphan``
    (a result without a call).  Of several calls, or results, with one identifier the earliest counts
    (ties: the least content).  ``position`` counts calls of a conversation in topological order, by
    level, then turn, then identifier; it is null where the level is.  Null identifiers link with
    nothing and are left out; null arguments are not JSON; null ``after`` is no prerequisite; empty
    tables give an empty result.  Arguments that are nested too deeply for a parser, and numbers that
    no double holds, are errors; surrogates that stand alone are written as their escapes.
    """
    tables = common.Tables(calls.sparkSession, "chat")
    own = F.struct("turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(own).alias("c"))
    calls = tables.put("calls", calls.select("conv_id", "call_id", "c.*"))
    results = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    leveled = tables.put("levels", levels(calls.select("conv_id", "call_id", "after"), tables, gathered))
    leveled = leveled.join(calls.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"])
    placed = calls.drop("after").join(positions(leveled, tables), ["conv_id", "call_id"])
    both = placed.withColumn("is_call", F.lit(True)).join(results, ["conv_id", "call_id"], "full_outer")
    both = both.withColumn("found", checked(schemas)(F.col("name"), F.col("arguments")))
    is_call = F.col("is_call").isNotNull()
    status = F.when(~is_call, "orphan").when(F.col("r").isNull(), "no_result").otherwise("linked")
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce("found.canonical", F.lit("null")), F.lit(',"id":'), json_text(F.col("call_id")),
        F.lit(',"name":'), json_text(F.col("name")), F.lit(',"result":'), json_text(F.col("r.content")), F.lit("}"),
    )
    return both.select(
        "conv_id", "call_id", "name", F.coalesce("turn", "r.turn").alias("turn"), status.alias("status"), F.col("level").cast("long").alias("level"), "position",
        F.when(is_call, F.array_join("found.errors", "; ")).otherwise("").alias("errors"), text.alias("canonical_json"),
    )


#: The production parameters of the query: a turn of the user asks the tool ``reply``.
REPLY = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as calls, results and other messages: each user turn calls ``reply`` after the
    conversation's user turns of up to two turns before; the assistant's next turn is its result.
    Rows of other roles, or without a conversation or turn, are messages."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    earlier = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 2).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    full = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = conversations.where(full & (F.col("role") == "user")).select("conv_id", name.alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(earlier).alias("after"))
    before = F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string"))
    results = conversations.where(full & (F.col("role") == "assistant")).select("conv_id", before.alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, conversations.where(~(full & F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))))


def message_rows(messages: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) that are neither call nor result, in the columns of
    ``link_calls``: one row each, of status ``message``."""
    text = F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(',"role":'), json_text(F.col("role")), F.lit("}"))
    none = F.lit(None).cast("string")
    return messages.select(
        "conv_id", none.alias("call_id"), none.alias("name"), "turn", F.lit("message").alias("status"), F.lit(None).cast("long").alias("level"),
        F.lit(None).cast("long").alias("position"), F.lit("").alias("errors"), text.alias("canonical_json"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results, messages = calls_of(conversations)
    return link_calls(calls, results, {"reply": REPLY}).unionByName(message_rows(messages))


#: The same in SQL.  Calls two turns apart are a chain, so a call's level is its place in its chain.
OP1_SQL = """
WITH calls AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, min(turn) AS turn, min(text) AS text
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(turn) AS turn, min(text) AS content
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), chained AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM calls
), leveled AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM chained
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) AS position FROM leveled
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS name, coalesce(c.turn, r.turn) AS turn,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  c.level, c.position,
  CASE WHEN c.call_id IS NULL THEN '' WHEN c.text IS NULL THEN '$.prompt: not string'
    ELSE concat_ws('; ', CASE WHEN length(c.text) < 1 THEN '$.prompt: too short' END,
      CASE WHEN length(c.text) > 400 THEN '$.prompt: too long' END, CASE WHEN c.turn < 0 THEN '$.turn: too small' END) END AS errors,
  '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null'
      ELSE '{"prompt":' || coalesce(to_json(c.text)::VARCHAR, 'null') || ',"turn":' || c.turn || '}' END
    || ',"id":' || to_json(coalesce(c.call_id, r.call_id))::VARCHAR || ',"name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
    || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS canonical_json
FROM placed c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT conv_id, NULL, NULL, turn, 'message', NULL, NULL, '',
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')
"""
