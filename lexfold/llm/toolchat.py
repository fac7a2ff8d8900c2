"""Chat formatting with tool-call linking, in DataFrame operations alone.

A message's text may hold blocks ``<tool_call>{"id", "name", "arguments"}</tool_call>``
and ``<tool_result>{"id", "content"}</tool_result>``. Calls and results are
hash-joined by conversation and identifier. A string ``"$id"`` among a call's
arguments makes it depend on that call's result; depth orders events
topologically: a call is one deeper than the results it depends on, a result one
deeper than its call. Arguments are validated against schemas, those that the
caller gives for all conversations and those that a conversation declares in blocks
``<tool_schema>{"name", "parameters": {argument: {"type", "required"}}}</tool_schema>``.
Everything is serialised as canonical JSON: keys sorted, no white space.

Rows are events, ordered by (depth, turn, part) within a conversation; no
conversation is gathered in one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
SCHEMA = r"(?s)<tool_schema>(.*?)</tool_schema>"
#: Types of a schema, as the engine names a JSON value's type.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
#: Tool name -> argument -> (type, whether it is required). A tool without schema takes any object.
Schemas = dict[str, dict[str, tuple[str, bool]]]


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def _valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether parsed arguments fit the tool's schema: an object with the required keys, known keys and right types."""
    ok = F.schema_of_variant(arguments).rlike("^OBJECT")
    for tool, spec in schemas.items():
        keys = F.json_object_keys(F.to_json(arguments))
        fits = F.size(F.array_except(keys, F.array(*map(F.lit, spec)) if spec else F.array().cast("array<string>"))) == 0
        for key, (kind, required) in spec.items():
            found = F.schema_of_variant(F.try_variant_get(arguments, f"$['{key}']", "variant"))
            fits = fits & F.coalesce(found.rlike(TYPES[kind]), F.lit(not required))
        ok = F.when(name == tool, ok & fits).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def _declared(schemas: DataFrame) -> DataFrame:
    """(conv_id, tool, spec), written: the first schema of a tool that a conversation declares; spec: argument -> (type, required)."""
    v = F.try_parse_json("body")
    given = schemas.select("conv_id", F.try_variant_get(v, "$.name", "string").alias("tool"), F.to_json(F.try_variant_get(v, "$.parameters", "variant")).alias("p"), F.struct("turn", "part").alias("at")).where("tool is not null and p is not null")
    first = given.groupBy("conv_id", "tool").agg(F.min_by("p", "at").alias("p"))
    return materialise(first.select("conv_id", "tool", F.from_json("p", "map<string,struct<type:string,required:boolean>>").alias("spec")).where("spec is not null"), "toolchat-schemas")


def _fits(arguments: Column, spec: Column) -> Column:
    """Whether parsed arguments fit a declared schema: known keys of their types, and all that are required. A type of another name is any."""
    kinds = F.transform_values(F.from_json(F.to_json(arguments), "map<string,variant>"), lambda _, x: F.schema_of_variant(x))
    pattern = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    known = F.size(F.array_except(F.map_keys(kinds), F.map_keys(spec))) == 0
    typed = F.forall(F.map_entries(kinds), lambda e: F.coalesce(F.rlike(e["value"], pattern[spec[e["key"]]["type"]]), F.lit(True)))
    needed = F.map_keys(F.map_filter(spec, lambda _, x: F.coalesce(x["required"], F.lit(False))))
    return F.coalesce(known & typed & (F.size(F.array_except(needed, F.map_keys(kinds))) == 0), F.lit(False))


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, kind, role, body): a message's own text as part 0, then its calls, its results and its schemas."""
    rows = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    text = F.struct(F.lit("message").alias("kind"), F.regexp_replace(F.regexp_replace(F.regexp_replace("t", CALL, ""), RESULT, ""), SCHEMA, "").alias("body"))

    def found(kind: str, mark: str, pattern: str) -> Column:
        every = F.when(F.contains("t", F.lit(mark)), F.regexp_extract_all("t", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        return F.transform(every, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body")))

    every = F.concat(F.array(text), found("call", "<tool_call>", CALL), found("result", "<tool_result>", RESULT), found("schema", "<tool_schema>", SCHEMA))
    return rows.select("conv_id", "turn", "role", F.posexplode(every).alias("part", "e")).select("conv_id", "turn", F.col("part").cast("long").alias("part"), F.col("e.kind").alias("kind"), "role", F.col("e.body").alias("body"))


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 1 for a call without dependencies; null in or after a cycle.

    calls: (conv_id, call_id, needs). Dependencies on unknown calls do not bind.
    A round settles the calls whose dependencies are settled, and an open call that
    hangs on a single one is passed over: whoever needs it needs that one, deeper by
    w. A chain of n calls thus takes log n rounds. Each round settles a call, or no
    call outside cycles is left.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key).distinct()
    edges = calls.select(*key, F.explode("needs").alias("need")).distinct()
    edges = materialise(edges.join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select(*key, "need", F.lit(2).cast("long").alias("w")), "toolchat-edges")
    done = materialise(known.join(edges.select(*key).distinct(), key, "left_anti").withColumn("depth", F.lit(1).cast("long")), "toolchat-depths")
    while True:
        waiting = edges.join(done.select("conv_id", F.col("call_id").alias("need"), "depth"), ["conv_id", "need"], "left")
        state = waiting.groupBy(*key).agg(F.max(F.col("depth") + F.col("w")).alias("m"), F.count_if(F.col("depth").isNull()).alias("open"), F.count("*").alias("n"), F.max("need").alias("via"), F.max("w").alias("more"))
        state = materialise(state, "toolchat-state")
        new = state.where("open = 0").select(*key, F.col("m").alias("depth"))
        if new.isEmpty():
            return done
        done = materialise(done.union(new), "toolchat-depths")
        left = state.where("open > 0")
        passed = left.where("n = 1").select("conv_id", F.col("call_id").alias("need"), "via", "more")
        on = edges.join(left.select(*key), key, "left_semi").join(passed, ["conv_id", "need"], "left")
        # the bound stops weights around a cycle, which never settle
        w = F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(1 << 60))
        edges = materialise(on.select(*key, F.coalesce("via", "need").alias("need"), w.alias("w")).groupBy(*key, "need").agg(F.max("w").alias("w")), "toolchat-edges")


def formatted(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """conv_id, turn, part, kind, call_id, depth, linked, valid, json: a row for each event.

    linked: a call has a result, a result a call, of one identifier in the
    conversation; null for messages and schemas. valid: a call parses, has an id and a
    name, and its arguments fit the caller's schema of the tool and the first one that
    the conversation declares, wherever; a result parses and has an id; a schema has a
    name and parameters; messages are valid. An identifier that several calls share
    takes the largest of their depths. depth is 0 for messages, schemas and results
    without a call, null for calls in a cycle, after one, or unparsed. json is
    canonical; a block that does not parse is kept as a JSON string. Null texts are
    empty; very long texts are read whole, one row each, conversations and chains of
    any length by rows; repeated rows return a row each; an empty table returns no
    row. Other columns are ignored, whatever their names.
    """
    every = events(messages)
    said = every.where("kind = 'message'").select(
        "conv_id", "turn", "part", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("boolean").alias("linked"), F.lit(True).alias("valid"),
        F.to_json(F.struct(F.col("body").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    blocks = materialise(every.where("kind <> 'message'"), "toolchat-blocks")
    if blocks.isEmpty():
        return said
    v = F.try_parse_json("body")
    blocks = blocks.withColumn("call_id", F.try_variant_get(v, "$.id", "string"))
    name, arguments = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.arguments", "variant")
    needs = F.array_distinct(F.regexp_extract_all(F.coalesce(F.to_json(arguments), F.lit("")), F.lit(r'"\$([^"\\]+)"'), F.lit(1)))
    quoted = F.get_json_object(F.to_json(F.struct(F.col("body").alias("x"))), "$")
    json = F.coalesce(canonical(F.col("body")), F.regexp_extract(quoted, r'(?s)^\{"x":(.*)\}$', 1))
    declared = small(_declared(blocks.where("kind = 'schema'")))
    calls = blocks.where("kind = 'call'").withColumn("tool", name).join(declared, ["conv_id", "tool"], "left")
    fits = F.col("spec").isNull() | _fits(arguments, F.col("spec"))
    calls = calls.select("conv_id", "turn", "part", "kind", "call_id", (F.col("call_id").isNotNull() & name.isNotNull() & _valid(name, arguments, schemas or {}) & fits).alias("valid"), json.alias("json"), needs.alias("needs"))
    told = F.try_variant_get(v, "$.name", "string").isNotNull() & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.parameters", "variant")).rlike("^OBJECT"), F.lit(False))
    nothing = F.lit(None).cast("string")
    shapes = blocks.where("kind = 'schema'").select("conv_id", "turn", "part", "kind", nothing.alias("call_id"), F.lit(0).cast("long").alias("depth"), nothing.cast("boolean").alias("linked"), told.alias("valid"), json.alias("json"))
    results = blocks.where("kind = 'result'").select("conv_id", "turn", "part", "kind", "call_id", F.col("call_id").isNotNull().alias("valid"), json.alias("json"))
    depths = _depths(calls.where("call_id is not null").select("conv_id", "call_id", "needs"))
    answered = results.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    asked = calls.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    key, columns = ["conv_id", "call_id"], ["conv_id", "turn", "part", "kind", "call_id", "depth", "linked", "valid", "json"]
    linked = F.coalesce("linked", F.lit(False)).alias("linked")
    calls = calls.join(depths, key, "left").join(answered, key, "left").withColumn("linked", linked).select(*columns)
    results = results.join(asked, key, "left").join(depths, key, "left").withColumn("depth", F.when(F.col("linked"), F.col("depth") + 1).otherwise(F.lit(0).cast("long"))).withColumn("linked", linked).select(*columns)
    return said.unionByName(calls).unionByName(results).unionByName(shapes)
