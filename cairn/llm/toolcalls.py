"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Arcs of a scope that are ordered in one task (more are ordered by rounds over all tasks), and arcs that a task orders together.
SCOPE, TOGETHER = 1 << 20, 1 << 17
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: The tools that the turns of a conversation stand for, with the schemas of their arguments.
CHAT_TOOLS = {
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "maximum": 0}}, "additionalProperties": False},
    "ask": {"type": "object", "required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
}


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with ``value`` by a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength and maxLength."""
    out: list[str] = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, TYPES[k]) and (k not in ("integer", "number") or not isinstance(value, bool)) for k in kinds):
        return [f"{at}: type"]
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        out.append(f"{at}: enum")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    elif isinstance(value, list) and "items" in schema:
        out += [x for k, item in enumerate(value) for x in faults(item, schema["items"], f"{at}[{k}]")]
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def pairs_of(events: DataFrame) -> DataFrame:
    """(scope, id, call, result): of each identifier the first call and the first result, by ``at``, then ``uid``."""
    place = F.struct("at", "uid")
    first = events.filter(F.col("id").isNotNull()).groupBy("scope", "id").agg(F.min(F.when(F.col("kind") == "call", place)).alias("c"), F.min(F.when(F.col("kind") == "result", place)).alias("r"))
    return C.cut(first.select("scope", "id", F.col("c.uid").alias("call"), F.col("r.uid").alias("result")))


def linked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joins calls and results, ``events`` (scope, uid, id, kind, at, after), by identifier: the events with ``link``, and the arcs (scope, uid, parent).

    ``link``: ``linked``, ``no result``, ``no call`` or ``duplicate`` (of calls with the same id the first is linked, likewise of results). So the joined table
    has an id once: frequent ids don't multiply. Arcs: a result follows its call; a call the result of each id in ``after``, or that call where
    it has no result. Each event has an arc from null besides.
    """
    pairs = pairs_of(events)
    known = events.join(pairs, ["scope", "id"], "left")
    is_call, lone = F.col("kind") == "call", F.col("call").isNull() | F.col("result").isNull()
    own = F.when(is_call, F.col("call")).otherwise(F.col("result"))
    link = F.when(F.col("uid") != own, "duplicate").when(~lone, "linked").when(is_call, "no result").otherwise("no call")
    known = C.cut(known.select("scope", "uid", "id", "kind", "at", "after", link.alias("link"), F.when(~is_call, F.col("call")).alias("parent")))
    before = pairs.select("scope", F.col("id").alias("to"), F.coalesce("result", "call").alias("parent"))
    waits = known.filter("kind = 'call'").select("scope", "uid", F.explode(F.array_distinct("after")).alias("to")).join(before, ["scope", "to"])
    arcs = known.select("scope", "uid", F.explode(F.array_distinct(F.array(F.lit(None).cast("long"), "parent"))).alias("parent"))
    return known.drop("after", "parent"), C.cut(arcs.union(waits.select("scope", "uid", "parent")))


def levels(uid: np.ndarray, parent: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, depth) of arcs, those that ``follows`` marks have a parent: how many arcs the longest way from a start has; -1 in a cycle and behind one."""
    nodes = np.unique(uid)
    child, above = np.searchsorted(nodes, uid[follows]), np.searchsorted(nodes, parent[follows])
    order = np.argsort(above, kind="stable")
    child, first = child[order], np.searchsorted(above[order], np.arange(len(nodes) + 1))
    waiting, depth, level = np.bincount(child, minlength=len(nodes)), np.full(len(nodes), -1, dtype=np.int64), 0
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        depth[ready] = level
        size = first[ready + 1] - first[ready]
        next_ = child[np.repeat(first[ready] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        np.subtract.at(waiting, next_, 1)
        next_ = np.unique(next_)
        ready, level = next_[waiting[next_] == 0], level + 1
    return nodes, depth


def ordered(arcs: DataFrame) -> DataFrame:
    """(uid, depth): the place of an event in the topological order, the longest chain of events that it waits for; null in a cycle and behind one.

    ``arcs`` (scope, uid, parent) don't leave a scope. Scopes of SCOPE arcs or fewer are ordered in tasks, many together; larger ones by ``rounds``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def told() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            follows = np.asarray(table.column("parent").is_valid())
            node, depth = levels(table.column("uid").to_numpy(), table.column("parent").fill_null(0).to_numpy(), follows)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(depth, mask=depth < 0)], ["uid", "depth"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = 0
            if count >= TOGETHER and len(keys):  # the scope that was open ends here, or goes on
                last = held[-1].column(0)[-1].as_py()
                at = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                held.append(batch.slice(0, at))
                if at < len(keys):
                    yield told()
                    held, count = [], 0
            if at < len(keys):
                held.append(batch.slice(at))
                count += len(keys) - at
        if held:
            yield told()

    tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = None
    if arcs.count() > SCOPE:
        large = C.cut(arcs.groupBy("scope").count().filter(F.col("count") > SCOPE).select("scope"))
        large = large if large.limit(1).count() else None
    small = arcs if large is None else arcs.join(large, "scope", "left_anti")
    rows = small.select(F.xxhash64("scope").alias("key"), "uid", "parent").repartition(tasks, "key").sortWithinPartitions("key")
    found = rows.mapInArrow(run, "uid long, depth long")
    return found if large is None else found.union(rounds(arcs.join(large, "scope", "left_semi").select("uid", "parent")))


def rounds(arcs: DataFrame) -> DataFrame:
    """``ordered`` for arcs (uid, parent) that fit into no task.

    Chains of events that follow one other only are shortened by doubling: log2 of their length in joins, however long they are. Then each event that waits for
    several looks through the chains to where they start; if that is one event, or the depths there are known, it is settled like the others. This
    repeats until nothing changes: a conversation whose parallel calls come together again takes a few rounds.
    """
    arcs = C.cut(arcs)
    known = C.cut(arcs.groupBy("uid").agg(F.max("parent").alias("p")).filter("p IS NULL").select("uid", F.lit(0).cast("long").alias("depth")))
    every = arcs.select("uid").distinct()
    open_ = C.cut(arcs.filter("parent IS NOT NULL").groupBy("uid", "parent").agg(F.lit(1).cast("long").alias("w")))
    state = None
    while (now := open_.agg(F.count(F.lit(1)), F.count_distinct("uid"), F.sum("w")).first()) != state:
        state = now
        ways = open_.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to"), F.min("w").alias("w"))
        chain, length, ended = C.cut(ways.filter("n = 1").select("uid", "to", "w")), 1, False
        while length <= 2 * now[1] and not ended:
            up = chain.select(F.col("uid").alias("to"), F.col("to").alias("__to"), F.col("w").alias("__w"))
            step = C.cut(chain.join(up, "to", "left").select("uid", F.coalesce("__to", "to").alias("to"), (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"), F.col("__to").isNotNull().alias("moved")))
            chain, length, ended = step.drop("moved"), 2 * length, step.filter("moved").limit(1).count() == 0
        if not ended:  # what still moves goes round a cycle, and has no depth
            chain, open_ = C.cut(step.filter("NOT moved").drop("moved")), C.cut(open_.join(step.filter("moved").select("uid"), "uid", "left_anti"))
        through = chain.select(F.col("uid").alias("parent"), "to", F.col("w").alias("more"))
        several = open_.join(chain.select("uid"), "uid", "left_anti").join(through, "parent", "left")
        several = several.groupBy("uid", F.coalesce("to", "parent").alias("parent")).agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        reached = chain.select("uid", F.col("to").alias("parent"), "w").unionByName(several)
        reached = C.cut(reached.join(known.select(F.col("uid").alias("parent"), "depth"), "parent", "left"))
        all_known = reached.groupBy("uid").agg(F.max(F.col("depth") + F.col("w")).alias("depth"), F.count_if(F.col("depth").isNull()).alias("waits"))
        settled = C.cut(all_known.filter("waits = 0").select("uid", "depth"))
        known = C.cut(known.union(settled))
        open_ = C.cut(reached.join(settled, "uid", "left_anti").select("uid", "parent", "w"))
    return every.join(known, "uid", "left")


def serialised(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(uid, valid, errors, json) of events with (uid, id, kind, name, arguments, content).

    ``arguments``: JSON of a call, validated against the schema of its tool. ``content``: what a result says. ``json``: the event in canonical form.
    Arguments that are no JSON (NaN, infinity and lone surrogates are none, nor is what is nested too deep to be read) are a fault, ``$: no JSON``, and stand there as a string.
    Events that are neither call nor result stand there with their ``name`` as role.
    """
    columns = ["uid", "id", "kind", "name", "arguments", "content"]

    def call(id_: str | None, name: str | None, arguments: str | None) -> tuple[list[str], str]:
        said = lambda value: canonical({"function": {"arguments": value, "name": name}, "id": id_, "type": "function"})
        try:
            value = json.loads(arguments)
            line = said(value)
            line.encode()
            return faults(value, schemas[name]) if name in schemas else ["$: unknown tool"], line
        except (TypeError, ValueError, RecursionError):
            return ["$: no JSON"], said(arguments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, said = [], []
            for id_, kind, name, arguments, content in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if kind == "call":
                    bad, line = call(id_, name, arguments)
                else:
                    bad = [] if content is not None else ["$: content"]
                    line = canonical({"content": content, "role": "tool", "tool_call_id": id_} if kind == "result" else {"content": content, "role": name})
                errors.append(bad), said.append(line)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([not e for e in errors], pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(said, pa.string())], ["uid", "valid", "errors", "json"])

    C.text_batches(events.sparkSession)
    return events.select(*columns).mapInArrow(run, "uid long, valid boolean, errors array<string>, json string")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None) -> DataFrame:
    """Links tool calls (uid, id, after, at, name, arguments) and results (uid, id, at, content), orders, validates and serialises them.

    ``uid`` is a unique long over all tables, ``after`` an id or an array of ids that a call waits for. With a column ``scope`` identifiers are those of a scope (a conversation).
    ``others`` (uid, at, name, content): what else was said, by whom; it links to nothing and waits for nothing. Returns an event
    each: (uid, id, kind, at, link, depth, valid, errors, json).

    A null id links to nothing; calls or results that repeat an id are marked ``duplicate``; ids in ``after`` that no call has are left out; an event in a cycle or behind one has no depth. Null or
    empty arguments and null contents are faults; empty tables give no events; other columns, whatever their names, are not read.
    """
    null = lambda kind: F.lit(None).cast(kind)

    def of(df: DataFrame, kind: str, **has: Column) -> DataFrame:
        scope = C.nullable_key("scope") if "scope" in df.columns else F.lit("")
        made = {"after": null("array<string>"), "name": null("string"), "arguments": null("string"), "content": null("string")} | has
        return df.select(scope.alias("scope"), "uid", F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.col("at").cast("long").alias("at"), *[c.alias(k) for k, c in made.items()])

    after = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    events = of(calls, "call", after=after.cast("array<string>"), name=F.col("name"), arguments=F.col("arguments")).unionByName(of(results, "result", content=F.col("content")))
    known, arcs = linked(events.select("scope", "uid", "id", "kind", "at", "after"))
    found = known.join(ordered(arcs), "uid").select("uid", "id", "kind", "at", "link", "depth")
    said = events.drop("scope", "after", "at")
    if others is not None:
        rest = others.select("uid", null("string").alias("id"), F.lit("other").alias("kind"), F.col("at").cast("long").alias("at"), F.lit("unlinked").alias("link"), F.lit(0).cast("long").alias("depth"), "name", null("string").alias("arguments"), "content")
        found, said = found.union(rest.select(*found.columns)), said.unionByName(rest.select(*said.columns))
    return found.join(serialised(said, schemas), "uid")


def chat_events(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (uid, conv_id, turn, role, text) as calls, results and others: a system or user turn calls ``configure`` or ``ask`` with its text, under the id ``conversation:turn``; an
    assistant's or tool's turn gives the result of the turn before. A call waits for the calls of the two turns before it, or their results. Turns of other roles, or of none, are others; those without a number have no id."""
    turn = F.col("turn").cast("long")
    said = lambda n: F.when(turn.isNotNull(), F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string")))
    asks, gives = F.coalesce(F.col("role").isin("system", "user"), F.lit(False)), F.coalesce(F.col("role").isin("assistant", "tool"), F.lit(False))
    base = [F.col("conv_id").alias("scope"), "uid"]
    arguments = F.to_json(F.struct("text", turn.alias("turn")))
    calls = rows.filter(asks).select(*base, said(turn).alias("id"), F.array(said(turn - 1), said(turn - 2)).alias("after"), turn.alias("at"), F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"), arguments.alias("arguments"))
    results = rows.filter(gives).select(*base, said(turn - 1).alias("id"), turn.alias("at"), F.col("text").alias("content"))
    others = rows.filter(~asks & ~gives).select("uid", turn.alias("at"), F.col("role").alias("name"), F.col("text").alias("content"))
    return calls, results, others


def op2_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a linked, ordered and validated event in canonical JSON."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = C.cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    calls, results, others = chat_events(rows)
    events = link_calls(calls, results, CHAT_TOOLS, others).join(rows.select("uid", "conv_id", "turn", "role"), "uid")
    return events.select("conv_id", "turn", "role", F.col("id").alias("call_id"), "kind", "link", "depth", "valid", F.concat_ws("; ", "errors").alias("errors"), "json")


#: The same events in SQL, for conversations whose turns don't repeat. ``p``: the turn before that isn't of another role; a call follows it if it is the turn before, or a call of
#: the one before that.
ORACLE = """
WITH k AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role IN ('system', 'user') THEN 'call' WHEN role IN ('assistant', 'tool') THEN 'result' ELSE 'other' END AS kind
  FROM conversations),
e AS (
  SELECT *, lag(turn) OVER w AS p_turn, lag(kind) OVER w AS p_kind, lead(turn) OVER w = turn + 1 AND lead(kind) OVER w = 'result' AS answered
  FROM k WHERE kind <> 'other' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (
  SELECT *, kind = 'result' AND coalesce(p_turn = turn - 1 AND p_kind = 'call', FALSE) AS given FROM e),
i AS (
  SELECT *, CASE WHEN kind = 'result' THEN given
                 ELSE coalesce(p_turn = turn - 1 OR p_turn = turn - 2 AND p_kind = 'call', FALSE) END AS follows
  FROM r),
n AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM i),
f AS (
  SELECT conv_id, turn, role, text, kind, coalesce(answered, FALSE) AS answered, given,
         row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS depth,
         conv_id || ':' || CASE WHEN kind = 'result' THEN turn - 1 ELSE turn END AS call_id,
         CASE WHEN kind = 'result' THEN CASE WHEN text IS NULL THEN '$: content' END
              ELSE nullif(concat_ws('; ', CASE WHEN text IS NULL THEN '$.text: required' WHEN text = '' THEN '$.text: minLength' WHEN role = 'user' AND length(text) > 400 THEN '$.text: maxLength' END,
                                    CASE WHEN role = 'system' AND turn > 0 THEN '$.turn: maximum' END), '') END AS fault
  FROM n
  UNION ALL
  SELECT conv_id, turn, role, text, kind, FALSE, FALSE, 0, NULL, CASE WHEN text IS NULL THEN '$: content' END FROM k WHERE kind = 'other'),
t AS (SELECT *, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS said FROM f)
SELECT conv_id, turn, role, call_id, kind, depth,
       CASE kind WHEN 'other' THEN 'unlinked' WHEN 'result' THEN CASE WHEN given THEN 'linked' ELSE 'no call' END ELSE CASE WHEN answered THEN 'linked' ELSE 'no result' END END AS link,
       fault IS NULL AS valid, coalesce(fault, '') AS errors,
       CASE kind WHEN 'other' THEN '{"content":' || said || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
            WHEN 'result' THEN '{"content":' || said || ',"role":"tool","tool_call_id":"' || call_id || '"}'
            ELSE '{"function":{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || said || ',' END || '"turn":' || turn || '},"name":"' || CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END || '"},"id":"' || call_id || '","type":"function"}' END AS json
FROM t
"""
