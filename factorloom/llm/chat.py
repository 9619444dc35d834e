"""Chat formatting with tool-call linking.

A conversation's messages are rows (conv_id, turn, role, text). An assistant's text
may be a JSON object with ``tool_calls``, a list of ``{id, name, arguments}``, and
``content``; a tool's text is ``{tool_call_id, content}``. Calls and results are
joined by (conversation, identifier) in a hash join; the earliest result answers a
call, other results stay unlinked. Calls are put in topological order: one whose
arguments name a call's result (``{"$result": "<id>"}``) comes after that call, inside its
message by levels, and across messages by moving the message that waits behind the one it
waits for and its results; a result follows its call wherever its row stood. Messages that
wait for nothing later stay at their turn. Arguments are checked against
the schema of the call's name. Each conversation becomes one line of canonical JSON:
keys sorted, no white space, arguments as canonical JSON text, nulls left out.

Only DataFrame operations run here. Defined cases: a null text has no content, a
null role no role; rows of one turn are ordered by role and text, repeated rows are
repeated messages; calls that depend on themselves or on each other in a ring keep
the order of their rows and count as ``n_cyclic``; an unknown name or a text that is
no JSON object makes no valid call; messages that wait for each other in a ring, or
for such messages, stay at their turns; rows without conv_id form conversations of
their own, one for each different row; an empty table gives no rows. A conversation is
one document, so its messages meet in one task, however long their texts. Other columns
are ignored.
"""

from __future__ import annotations

import json as json_module
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut, drop

CALLS = "content string, tool_calls array<struct<id string, name string, arguments string>>"
RESULT = "tool_call_id string, content string"
# JSON Schema types and the type names that variants have.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
    "null": "VOID",
}
#: Schemas the registered query checks against.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


#: Keywords of a schema that say nothing about what is valid.
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def fits(value: Column, schema: dict | bool) -> Column:
    """Whether a variant is valid under a JSON Schema, as one expression; a keyword that isn't known is an error.

    Known are type (one or several), enum, const, properties, required, additionalProperties, items, the bounds of numbers,
    lengths and list sizes, pattern (found anywhere in the string) and the notes. Keywords for another type don't apply.
    """
    if isinstance(schema, bool):
        return F.lit(schema)
    kind = F.schema_of_variant(value)
    of = lambda *types: F.coalesce(kind.rlike("^(?:" + "|".join(TYPES[t] for t in types) + ")$"), F.lit(False))
    sure = lambda c: F.coalesce(c, F.lit(False))
    json = F.to_json(value)
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    entries = F.try_variant_get(value, "$", "array<variant>")
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    same = lambda x: json == F.lit(canonical_text(x))
    compared = {"minimum": lambda x: number >= x, "maximum": lambda x: number <= x, "exclusiveMinimum": lambda x: number > x, "exclusiveMaximum": lambda x: number < x}
    counted = {"minLength": lambda x: F.length(text) >= x, "maxLength": lambda x: F.length(text) <= x, "pattern": lambda x: F.regexp_like(text, x)}
    listed = {"minItems": lambda x: F.size(entries) >= x, "maxItems": lambda x: F.size(entries) <= x}
    known = schema.get("properties", {})
    ok = value.isNotNull()
    for word, rule in sorted(schema.items()):
        if word == "type":
            ok = ok & of(*([rule] if isinstance(rule, str) else rule))
        elif word == "enum":
            ok = ok & reduce(or_, map(same, rule), F.lit(False))
        elif word == "const":
            ok = ok & same(rule)
        elif word in compared:
            ok = ok & (~of("number") | sure(compared[word](F.lit(float(rule)))))
        elif word in counted:
            ok = ok & (~of("string") | sure(counted[word](F.lit(rule))))
        elif word in listed:
            ok = ok & (~of("array") | sure(listed[word](F.lit(rule))))
        elif word == "items":
            ok = ok & (~of("array") | sure(F.forall(entries, _all(rule))))
        elif word == "properties":
            for key, inner in sorted(rule.items()):
                ok = ok & (~F.array_contains(keys, key) | fits(F.try_variant_get(value, _path(key), "variant"), inner))
        elif word == "required":
            ok = reduce(and_, (~of("object") | F.array_contains(keys, key) for key in rule), ok)
        elif word == "additionalProperties" and rule is False:
            ok = ok & (F.size(F.array_except(keys, F.array(*(F.lit(k) for k in known)).cast("array<string>"))) == 0)
        elif not (word in NOTES or word == "additionalProperties" and rule is True):
            raise ValueError(f"a schema's keyword isn't known: {word}")
    return sure(ok)


def _all(schema: dict | bool):
    return lambda x: fits(x, schema)


def _path(key: str) -> str:
    """The path of a key; one with both kinds of quotes has none."""
    quote = "'" if '"' in key else '"'
    if quote in key:
        raise ValueError(f"a property's name has both kinds of quotes: {key}")
    return f"$[{quote}{key}{quote}]"


def canonical_text(value) -> str:
    return json_module.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether the arguments are an object that fits the schema of the name."""
    parsed = F.try_parse_json(arguments)
    ok = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        ok = F.when(name == tool, fits(parsed, {"type": "object"}) & fits(parsed, schema)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; a text that is no JSON as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def levels(calls: DataFrame) -> DataFrame:
    """Adds level (0: depends on no call, -1: on a ring) to calls (key, nth, id, needs array of ids)."""
    ids = calls.select("key", "id").distinct()
    waits = cut(calls.select("key", "id", F.explode("needs").alias("need")).join(ids.toDF("key", "need"), ["key", "need"], "left_semi").distinct())
    done = cut(ids.join(waits.select("key", "id").distinct(), ["key", "id"], "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while not waits.isEmpty():
        level += 1
        waits = cut(waits.join(done.select("key", F.col("id").alias("need")), ["key", "need"], "left_anti"), waits)
        ready = ids.join(done, ["key", "id"], "left_anti").join(waits.select("key", "id").distinct(), ["key", "id"], "left_anti").withColumn("level", F.lit(level))
        if ready.isEmpty():
            break
        done = cut(done.unionByName(ready), done)
    drop(waits)
    return calls.join(done, ["key", "id"], "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def places(calls: DataFrame) -> DataFrame:
    """Adds ``place`` (turn, wait), where the message of a call is written, to calls (key, turn, text, nth, id, needs).

    A message stands at its turn with a wait of 0, or else behind the last one that it waits for: at the same turn, with a
    wait greater by one. A message is told by conversation, turn and text.
    """
    message = F.struct("turn", "text")
    own = F.struct("turn", F.lit(0).alias("wait"))
    named = calls.groupBy("key", F.col("id").alias("need")).agg(F.min(message).alias("on"))
    waits = calls.select("key", message.alias("message"), F.explode("needs").alias("need")).join(named, ["key", "need"]).filter(~F.col("message").eqNullSafe(F.col("on")))
    waits = cut(waits.select("key", "message", "on").distinct())
    # where every message waits for earlier turns alone, none moves
    if waits.filter("message.turn is null or on.turn >= message.turn").isEmpty():
        drop(waits)
        return calls.withColumn("place", own)
    # all messages that wait or are waited for, with the place known so far and how many they still wait for
    nodes = calls.select("key", message.alias("message"), own.alias("place")).distinct()
    waiting = waits.groupBy("key", "message").agg(F.count("*").alias("left"))
    node = ["key", "message"]
    same = lambda a, b: (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.message").eqNullSafe(F.col(f"{b}.message"))
    nodes = cut(nodes.alias("n").join(waiting.alias("w"), same("n", "w"), "left").select("n.key", "n.message", "n.place", F.coalesce("left", F.lit(0)).alias("left"), F.lit(False).alias("told")))
    while not (ready := nodes.filter("left = 0 and not told")).isEmpty():
        told = ready.select("key", F.col("message").alias("on"), F.struct(F.col("place.turn").alias("turn"), (F.col("place.wait") + 1).alias("wait")).alias("behind"))
        news = waits.alias("w").join(told.alias("t"), (F.col("w.key") == F.col("t.key")) & F.col("w.on").eqNullSafe(F.col("t.on"))).groupBy("w.key", "w.message").agg(F.max("behind").alias("behind"), F.count("*").alias("gone"))
        nodes = cut(
            nodes.alias("n").join(news.alias("w"), same("n", "w"), "left").select("n.key", "n.message", F.greatest("n.place", "w.behind").alias("place"), (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"), (F.col("told") | (F.col("left") == 0)).alias("told")),
            nodes,
        )
    drop(waits)
    found = nodes.filter("told").select(*node, "place")
    met = calls.withColumn("message", message).alias("n").join(found.alias("w"), same("n", "w"), "left")
    return met.select("n.*", F.coalesce("w.place", F.struct("n.turn", F.lit(0).alias("wait"))).alias("place")).drop("message")


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_calls, n_linked, n_invalid, n_cyclic, n_unlinked (results) and messages, the canonical JSON."""
    schemas = SCHEMAS if schemas is None else schemas
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("key", F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), alone.alias("n")))
    json = F.col("text").startswith("{")
    rows = rows.withColumn("call", F.when((F.col("role") == "assistant") & json, F.from_json("text", CALLS))).withColumn("result", F.when((F.col("role") == "tool") & json, F.from_json("text", RESULT)))
    calling = F.coalesce(F.size("call.tool_calls") > 0, F.lit(False))
    answering = F.col("result.tool_call_id").isNotNull()

    # calls, in their order and level; an id given twice in a conversation is the first call's
    calls = rows.filter(calling).select("conv_id", "key", "turn", "text", F.posexplode("call.tool_calls").alias("nth", "c")).select("conv_id", "key", "turn", "text", "nth", "c.*")
    needs = F.regexp_extract_all("arguments", F.lit('\\{\\s*"\\$result"\\s*:\\s*"([^"]*)"\\s*\\}'), 1)
    calls = calls.withColumn("arguments", canonical(F.col("arguments"))).withColumn("needs", F.coalesce(needs, F.array().cast("array<string>")))
    calls = places(levels(calls)).withColumn("valid", valid_arguments(F.col("name"), F.col("arguments"), schemas))
    results = rows.filter(answering).select("conv_id", "key", "turn", "role", "text", F.col("result.tool_call_id").alias("id"), F.col("result.content").alias("content"))
    first_call = calls.groupBy("key", "id").agg(F.min(F.struct("turn", "text", "nth", "level", "place")).alias("c"))
    first_result = results.groupBy("key", "id").agg(F.min(F.struct("turn", "text")).alias("r"))
    linked = results.hint("shuffle_hash").join(first_call, ["key", "id"], "left")
    linked = linked.hint("shuffle_hash").join(first_result, ["key", "id"], "left")
    answers = F.col("c").isNotNull() & (F.struct("turn", "text") == F.col("r"))

    # messages with the order they are written in: (place, kind, level or text)
    order = lambda turn, kind, level, nth, tie, wait=F.lit(0): F.struct(turn.alias("turn"), wait.alias("wait"), F.lit(kind).alias("kind"), level.alias("level"), nth.alias("nth"), tie.alias("tie"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    tie = F.concat_ws("\u0001", "role", "text")
    plain = rows.filter(~calling & ~answering).select(
        "conv_id", "key", order(F.col("turn"), 0, zero, zero, tie).alias("at"), F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))).alias("json"),
        *(F.lit(0).cast("long").alias(n) for n in ("calls", "linked", "invalid", "cyclic", "unlinked")),
    )
    # a ring comes after the calls that can be ordered, by row
    levelled = F.when(F.col("level") < 0, 1 << 30).otherwise(F.col("level"))
    one = F.struct(levelled.alias("l"), F.col("nth"), F.to_json(F.struct("arguments", "id", "name")).alias("json"))
    asked = calls.groupBy("conv_id", "key", "turn", "text").agg(F.first("place").alias("place"), F.array_sort(F.collect_list(one)).alias("all"), F.count("*").alias("calls"), F.sum(flag(~F.col("valid"))).alias("invalid"), F.sum(flag(F.col("level") < 0)).alias("cyclic"))
    content = F.to_json(F.struct(F.from_json("text", "content string")["content"].alias("content")))  # {} without one
    head = F.when(content == "{}", "{").otherwise(F.concat(F.regexp_replace(content, "\\}$", ""), F.lit(",")))
    asked = asked.select(
        "conv_id", "key", order(F.col("place.turn"), 1, zero, zero, F.col("text"), F.col("place.wait")).alias("at"), F.concat(head, F.lit('"role":"assistant","tool_calls":['), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit("]}")).alias("json"),
        "calls", F.lit(0).cast("long").alias("linked"), "invalid", "cyclic", F.lit(0).cast("long").alias("unlinked"),
    )
    told = linked.select(
        "conv_id", "key",
        F.when(answers, order(F.col("c.place.turn"), 2, F.when(F.col("c.level") < 0, 1 << 30).otherwise(F.col("c.level")), F.col("c.nth"), F.col("text"), F.col("c.place.wait"))).otherwise(order(F.col("turn"), 3, zero, zero, F.col("text"))).alias("at"),
        F.to_json(F.struct("content", "role", F.col("id").alias("tool_call_id"))).alias("json"),
        F.lit(0).cast("long").alias("calls"), flag(answers).alias("linked"), F.lit(0).cast("long").alias("invalid"), F.lit(0).cast("long").alias("cyclic"), flag(~answers).alias("unlinked"),
    )
    written = plain.unionByName(asked).unionByName(told)
    totals = (F.sum(n).alias(f"n_{n}") for n in ("calls", "linked", "invalid", "cyclic", "unlinked"))
    chats = written.groupBy("conv_id", "key").agg(F.count("*").alias("n_turns"), *totals, F.array_sort(F.collect_list(F.struct("at", "json"))).alias("m"))
    messages = F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["json"]), ","), F.lit("]"))
    return chats.select("conv_id", "n_turns", "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_unlinked", messages.alias("messages"))


def digests(turns: DataFrame) -> DataFrame:
    """The counts of each conversation and the digest of its canonical JSON."""
    return format_chats(turns).withColumn("chat_sha256", F.sha2("messages", 256)).drop("messages")


#: DuckDB SQL for ``digests`` over conversations whose texts hold no tool calls; any that do would differ in n_calls.
ORACLE = """
SELECT conv_id, count(*) AS n_turns,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' AND starts_with(text, '{') AND json_valid(text) THEN json_array_length(text, '$.tool_calls') END), 0) AS BIGINT) AS n_calls,
       CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_cyclic,
       CAST(0 AS BIGINT) AS n_unlinked,
       sha256('[' || string_agg('{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN role IS NULL THEN '' ELSE ',' END END
              || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) END || '}', ','
              ORDER BY turn, concat_ws(chr(1), role, text)) || ']') AS chat_sha256
FROM conversations GROUP BY conv_id
"""


def with_tools(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) in which each user's turn is also looked up by a tool.

    Each user's row gets a call ``c<turn>`` of ``search`` with its text and turn; where the turn is 2 modulo 4 the query is
    the result of the call two turns before instead, which the schema doesn't allow. Calls are answered by the text unless the
    turn is divisible by 3, and one divisible by 5 gets a result that no call asked for.
    """
    asked = turns.filter("role = 'user'")
    turn = F.col("turn").cast("string")
    before = F.format_string('{"query":{"$result":"c%d"},"limit":%d}', F.col("turn") - 2, F.col("turn"))
    arguments = F.when(F.col("turn") % 4 == 2, before).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))))
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), turn, F.lit('","name":"search","arguments":'), arguments, F.lit("}]}"))
    result = lambda name, content: F.to_json(F.struct(F.concat(F.lit(name), turn).alias("tool_call_id"), content.alias("content")))
    row = lambda role, text: ("conv_id", "turn", F.lit(role).alias("role"), text.alias("text"))
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(asked.select(*row("assistant", call)))
    rows = rows.unionByName(asked.filter("turn % 3 <> 0").select(*row("tool", result("c", F.col("text")))))
    return rows.unionByName(asked.filter("turn % 5 = 0").select(*row("tool", result("x", F.lit("?")))))


#: DuckDB SQL for the digests of ``with_tools`` over conversations without tool calls of their own and with one row a turn.
TOOLS_ORACLE = """
WITH u AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 2 THEN '{"limit":' || turn || ',"query":{"$result":"c' || (turn - 2) || '"}}'
                  ELSE '{"limit":' || turn || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}' END AS arguments FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, 0 AS kind, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json, 0 AS calls, 0 AS linked, 0 AS invalid, 0 AS unlinked FROM conversations
      UNION ALL SELECT conv_id, turn, 1, '{"role":"assistant","tool_calls":[{"arguments":' || CAST(to_json(arguments) AS VARCHAR) || ',"id":"c' || turn || '","name":"search"}]}', 1, 0, CASE WHEN turn % 4 = 2 THEN 1 ELSE 0 END, 0 FROM u
      UNION ALL SELECT conv_id, turn, 2, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"c' || turn || '"}', 0, 1, 0, 0 FROM u WHERE turn % 3 <> 0
      UNION ALL SELECT conv_id, turn, 3, '{"content":"?","role":"tool","tool_call_id":"x' || turn || '"}', 0, 0, 0, 1 FROM u WHERE turn % 5 = 0)
SELECT conv_id, count(*) AS n_turns, CAST(sum(calls) AS BIGINT) AS n_calls, CAST(sum(linked) AS BIGINT) AS n_linked, CAST(sum(invalid) AS BIGINT) AS n_invalid,
       CAST(0 AS BIGINT) AS n_cyclic, CAST(sum(unlinked) AS BIGINT) AS n_unlinked, sha256('[' || string_agg(json, ',' ORDER BY turn, kind) || ']') AS chat_sha256
FROM m GROUP BY conv_id
"""


def with_waiting(turns: DataFrame) -> DataFrame:
    """Conversations in which calls wait for results of later turns.

    Each user's row gets a call ``c<turn>`` of ``search``. At the turns 2 and 4 modulo 8 its query is the result of the call
    two turns later, so that 2 waits for 4 and 4 for 6; elsewhere it is the row's text. Each call is answered by the text.
    """
    asked = turns.filter("role = 'user'")
    turn = F.col("turn").cast("string")
    later = F.format_string('{"query":{"$result":"c%d"},"limit":%d}', F.col("turn") + 2, F.col("turn"))
    arguments = F.when((F.col("turn") % 8).isin(2, 4), later).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))))
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), turn, F.lit('","name":"search","arguments":'), arguments, F.lit("}]}"))
    answer = F.to_json(F.struct(F.concat(F.lit("c"), turn).alias("tool_call_id"), F.col("text").alias("content")))
    rows = turns.select("conv_id", "turn", "role", "text")
    for role, text in (("assistant", call), ("tool", answer)):
        rows = rows.unionByName(asked.select("conv_id", "turn", F.lit(role).alias("role"), text.alias("text")))
    return rows


#: DuckDB SQL for the digests of ``with_waiting``, of the same conversations as ``TOOLS_ORACLE``.
WAITING_ORACLE = """
WITH u AS (SELECT a.conv_id, a.turn, a.text, b.turn AS next, c.turn AS third FROM conversations AS a
           LEFT JOIN conversations AS b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = 'user' AND a.turn % 8 IN (2, 4)
           LEFT JOIN conversations AS c ON c.conv_id = a.conv_id AND c.turn = a.turn + 4 AND c.role = 'user' AND b.turn % 8 = 4 WHERE a.role = 'user'),
p AS (SELECT conv_id, turn, text, coalesce(third, next, turn) AS place, CASE WHEN third IS NOT NULL THEN 2 WHEN next IS NOT NULL THEN 1 ELSE 0 END AS wait,
             CASE WHEN turn % 8 IN (2, 4) THEN '{"limit":' || turn || ',"query":{"$result":"c' || (turn + 2) || '"}}'
                  ELSE '{"limit":' || turn || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}' END AS arguments FROM u),
m AS (SELECT conv_id, turn AS place, 0 AS wait, 0 AS kind, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json, 0 AS calls, 0 AS linked, 0 AS invalid FROM conversations
      UNION ALL SELECT conv_id, place, wait, 1, '{"role":"assistant","tool_calls":[{"arguments":' || CAST(to_json(arguments) AS VARCHAR) || ',"id":"c' || turn || '","name":"search"}]}', 1, 0, CASE WHEN turn % 8 IN (2, 4) THEN 1 ELSE 0 END FROM p
      UNION ALL SELECT conv_id, place, wait, 2, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"c' || turn || '"}', 0, 1, 0 FROM p)
SELECT conv_id, count(*) AS n_turns, CAST(sum(calls) AS BIGINT) AS n_calls, CAST(sum(linked) AS BIGINT) AS n_linked, CAST(sum(invalid) AS BIGINT) AS n_invalid,
       CAST(0 AS BIGINT) AS n_cyclic, CAST(0 AS BIGINT) AS n_unlinked, sha256('[' || string_agg(json, ',' ORDER BY place, wait, kind) || ']') AS chat_sha256
FROM m GROUP BY conv_id
"""
