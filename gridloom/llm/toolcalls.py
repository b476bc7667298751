"""Chat formatting: link tool calls to their results, order and validate them, write canonical JSON.

DataFrame functions only. Calls and results are hash-joined by conversation and
identifier. A call's arguments name the calls that they need as "$call:ID". The
transcript's order is a topological one where each such reference points
backwards, which one join proves; only the conversations where one points
forwards are peeled level by level. Arguments are validated against schemas, and
each link becomes one JSON object with sorted keys and no spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages

REFERENCE = r'"\$call:([^"]+)"'

#: Schemas of the calls that plain conversations are read as.
CHAT_SCHEMAS = {
    "instruct": {"required": {"text": "string"}, "optional": {}},
    "reply": {"required": {"text": "string"}, "optional": {"after": "string"}},
}

#: How the types of a schema begin in schema_of_variant's result.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def _typed(value: Column, kind: str) -> Column:
    shown = F.schema_of_variant(value)
    return F.coalesce(reduce(Column.__or__, [shown.startswith(t) for t in TYPES[kind]]), F.lit(False))


def valid_arguments(name: Column, raw: Column, parsed: Column, schemas: dict) -> Column:
    """Whether the arguments are an object that the schema of the tool ``name`` admits; false for unknown tools."""
    out = F.lit(False)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    for tool, schema in schemas.items():
        allowed = [*schema["required"], *schema["optional"]]
        fits = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]).cast("array<string>"))) == 0
        for key, kind in schema["required"].items():
            fits = fits & _typed(F.try_variant_get(parsed, f"$.{key}", "variant"), kind)
        for key, kind in schema["optional"].items():
            there = F.array_contains(keys, key)
            fits = fits & (~there | _typed(F.try_variant_get(parsed, f"$.{key}", "variant"), kind))
        out = F.when(name == tool, _typed(parsed, "object") & fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _levels(edges: DataFrame, calls: DataFrame, stage: Stages) -> DataFrame:
    """(conv_id, call_id, level) of ``calls`` by the longest chain of edges; calls on or behind a cycle have none.

    ``edges`` are (conv_id, call_id, needs). A round settles the calls all of
    whose needs are settled, so there are as many rounds as the longest chain has calls.
    """
    key = ["conv_id", "call_id"]
    done = stage(calls.select(*key).join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)))
    left = stage(edges)
    before, n = -1, left.count()
    while n and n != before:
        settled = done.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("of"))
        seen = left.join(settled, ["conv_id", "needs"], "left")
        ready = (
            seen.groupBy(*key)
            .agg(F.max("of").alias("of"), F.count_if(F.col("of").isNull()).alias("open"))
            .where("open = 0")
            .select(*key, (F.col("of") + 1).cast("int").alias("level"))
        )
        ready = stage(ready)
        done = stage(done.unionByName(ready))
        left = stage(left.join(ready.select(*key), key, "left_anti"))
        before, n = n, left.count()
    return done


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row for each call, and one for each result without a call.

    ``calls`` has (conv_id, call_id, turn, name, arguments), ``results`` has
    (conv_id, call_id, turn, content); other columns are ignored. Of calls, or of
    results, that repeat an identifier in a conversation the first by turn (then by
    content) stands, and ``n_calls`` and ``n_results`` count them. Rows with a null
    conversation or identifier can't be linked: they are returned unlinked.

    status: linked; unanswered (no result); orphan (no call); early (the result
    stands before its call). level: 0 where the transcript's order is topological,
    else the level in it, null for calls on a cycle; (level, turn, call_id) orders
    the calls of a conversation. valid: the arguments fit the schema. json: the
    canonical object.
    """
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call_cols = [F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments")]
    result_cols = [F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content")]
    calls = calls.select(*key, *call_cols)
    results = results.select(*key, *result_cols)
    first = lambda cols: F.min(F.struct(*cols))
    c = calls.where(known).groupBy(*key).agg(first(["turn", "name", "arguments"]).alias("c"), F.count("*").alias("n_calls"))
    r = results.where(known).groupBy(*key).agg(first(["turn", "content"]).alias("r"), F.count("*").alias("n_results"))
    linked = c.join(r.hint("shuffle_hash"), key, "full_outer")
    alone = calls.where(~known).select(*key, F.struct("turn", "name", "arguments").alias("c"), F.lit(1).cast("long").alias("n_calls"))
    widow = results.where(~known).select(*key, F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    rows = linked.unionByName(alone, allowMissingColumns=True).unionByName(widow, allowMissingColumns=True)
    rows = rows.select(
        *key,
        F.coalesce("c.turn", "r.turn").alias("turn"),
        F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"),
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("c").isNull(), "orphan")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.col("r.turn") < F.col("c.turn"), "early")
        .otherwise("linked")
        .alias("status"),
    )
    stage = Stages()
    rows = stage(rows)
    edges = (
        rows.where(known & F.col("arguments").contains("$call:"))
        .select(*key, "turn", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("needs"))
        .join(
            rows.where(known & (F.col("n_calls") > 0)).select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("of")),
            ["conv_id", "needs"],
        )
    )
    forward = edges.where(
        (F.col("of") > F.col("turn"))
        | ((F.col("of") == F.col("turn")) & (F.col("needs") >= F.col("call_id")))
        | F.col("of").isNull()
        | F.col("turn").isNull()
    )
    odd = stage(forward.select("conv_id").distinct())
    if odd.isEmpty():
        rows = rows.withColumn("level", F.lit(0))
    else:
        some = rows.where(known).join(odd, "conv_id", "left_semi")
        levels = _levels(edges.join(odd, "conv_id", "left_semi").select(*key, "needs"), some, stage)
        rows = (
            rows.join(levels, key, "left")
            .join(odd.withColumn("odd", F.lit(True)), "conv_id", "left")
            .withColumn("level", F.when(F.col("odd"), F.col("level")).otherwise(F.lit(0)))
            .drop("odd")
        )
    parsed = F.try_parse_json("arguments")
    rows = rows.withColumn("valid", valid_arguments(F.col("name"), F.col("arguments"), parsed, schemas))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(F.col(c))), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    plain = {"call_id": "id", "conv_id": "conv_id", "name": "name", "content": "result", "status": "status", "valid": "valid"}
    texts = {out: text(c) for c, out in plain.items()}
    # variants keep the keys of an object sorted; arguments that don't parse stay a string
    texts["arguments"] = F.coalesce(F.to_json(parsed), text("arguments"))
    parts = [x for k in sorted(texts) for x in (F.lit(f'"{k}":'), texts[k], F.lit(","))][:-1]
    out = rows.select(
        *key, "turn", "name", "level", "status", "valid", "n_calls", "n_results", F.concat(F.lit("{"), *parts, F.lit("}")).alias("json")
    )
    return stage.last(out)


def chat_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls``, an array of
    (id, name, arguments), is those calls, and a tool's text (tool_call_id, content)
    is a result. Other turns are read as calls too: a user's turn t is the call
    turn-t of ``reply``, after the user's turn before it, and a system's is one
    of ``instruct``; an assistant's turn t is the result of turn-(t - 1). A null
    text is a null argument or content; turns of other roles are left out.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tools = F.from_json(
        F.get_json_object("text", "$.tool_calls"), "array<struct<id:string,name:string,arguments:string>>"
    )
    marked = rows.withColumn("tools", F.when((F.col("role") == "assistant") & F.col("text").startswith("{"), tools))
    own = marked.where(F.size("tools") > 0).select("conv_id", "turn", F.explode("tools").alias("t"))
    made = own.select("conv_id", F.col("t.id").alias("call_id"), "turn", F.col("t.name").alias("name"), F.col("t.arguments").alias("arguments"))
    answers = rows.where(F.col("role") == "tool").select(
        "conv_id",
        F.get_json_object("text", "$.tool_call_id").alias("call_id"),
        "turn",
        F.coalesce(F.get_json_object("text", "$.content"), "text").alias("content"),
    )
    at = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    after = F.when((F.col("role") == "user") & (F.col("turn") > 1), F.concat(F.lit("$call:"), at(F.col("turn") - 2)))
    said = rows.where(F.col("role").isin("user", "system")).select(
        "conv_id",
        at(F.col("turn")).alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"),
        F.to_json(F.struct(after.alias("after"), "text")).alias("arguments"),
    )
    replies = marked.where((F.col("role") == "assistant") & ~F.coalesce(F.size("tools") > 0, F.lit(False))).select(
        "conv_id", at(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return made.unionByName(said), answers.unionByName(replies)


#: DuckDB's form of link_calls over chat_as_calls, for conversations whose texts hold no tool calls.
CHAT_SQL = """
WITH c AS (
  SELECT conv_id, 'turn-' || turn AS call_id, turn, if(role = 'user', 'reply', 'instruct') AS name, text,
    if(role = 'user' AND turn > 1, '"after":"$call:turn-' || (turn - 2) || '",', '') AS after
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, name,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    c.turn IS NOT NULL AS valid, (c.turn IS NOT NULL)::BIGINT AS n_calls, (r.turn IS NOT NULL)::BIGINT AS n_results,
    if(c.turn IS NULL, 'null', '{' || after || '"text":' || to_json(text) || '}') AS arguments, content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, 0 AS level, status, valid, n_calls, n_results,
  '{"arguments":' || arguments || ',"conv_id":' || conv_id || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":' || to_json(status) || ',"valid":' || valid || '}' AS json
FROM j
"""
