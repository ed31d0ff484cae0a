"""Linking tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by identifier, calls are put in an order in which
each follows the calls it depends on, their arguments are checked against the tools'
schemas, and each call is serialised as canonical JSON: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.llm.recovery import cut

#: What Spark names a JSON value's type, by JSON schema type.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null where it can't be read."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted list of what is wrong with a call's arguments under its tool's schema (``required``, ``properties``)."""
    tree = F.try_parse_json(arguments)
    wrong = F.when(tree.isNull() | ~F.schema_of_variant(tree).startswith("OBJECT"), F.array(F.lit("not an object")))
    for tool, schema in sorted(schemas.items()):
        checks = []
        for key, kind in sorted(schema["properties"].items()):
            value = F.try_variant_get(tree, f"$['{key}']", "variant")
            there = value.isNotNull()
            if key in schema.get("required", ()):
                checks.append(F.when(~there, F.lit(f"{key}: missing")))
            checks.append(F.when(there & ~F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$"), F.lit(f"{key}: not {kind}")))
        wrong = wrong.when(name == tool, F.array_compact(F.array(*checks)))
    return wrong.otherwise(F.array(F.lit("unknown tool")))


def call_order(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without dependencies, else one more than the highest among them.

    ``calls`` has conv_id, call_id and depends_on (array of call_ids of the same
    conversation; null conv_ids are one conversation). Dependencies on calls that aren't
    there are ignored. Chains of calls with one dependency each are followed by pointer
    doubling, in as many rounds as the logarithm of their length; only calls with several
    dependencies are settled level by level, for all conversations at once. Calls on a
    cycle, or that depend on one, have a null level.
    """
    place = lambda call: F.struct("conv_id", call.alias("call_id"))
    named = calls.where("call_id is not null")
    all_calls = cut(named.select(place(F.col("call_id")).alias("call")).distinct())
    needs = named.select(place(F.col("call_id")).alias("call"), "conv_id", F.explode(F.array_distinct("depends_on")).alias("need")).select("call", place(F.col("need")).alias("need")).distinct()
    needs = cut(needs.join(all_calls.withColumnRenamed("call", "need"), "need", "left_semi"))
    degree = needs.groupBy("call").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    jumps = cut(degree.where("n = 1").select("call", F.col("need").alias("at"), F.lit(1).cast("long").alias("steps")))
    for _ in range(max(1, all_calls.count()).bit_length() + 1):
        on = jumps.select(F.col("call").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"))
        jumps = cut(jumps.join(on, "at", "left").select("call", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_at").isNotNull().alias("moved")))
        moved = not jumps.where("moved").isEmpty()
        jumps = jumps.drop("moved")
        if not moved:
            break
    several = degree.where("n > 1").select("call")
    levels = cut(all_calls.join(needs.select("call").distinct(), "call", "left_anti").withColumn("level", F.lit(0).cast("long")))
    ends = jumps.select(F.col("call").alias("need"), "at", "steps")
    edges = needs.join(several, "call", "left_semi").join(ends, "need", "left")
    edges = cut(edges.select("call", F.coalesce("at", "need").alias("at"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    while True:
        waiting = edges.join(levels.select("call"), "call", "left_anti")
        ready = waiting.join(levels.withColumnRenamed("call", "at"), "at", "left").groupBy("call")
        ready = ready.agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("blocked"))
        settled = cut(ready.where("blocked = 0").select("call", "level"))
        if settled.isEmpty():
            break
        levels = cut(levels.union(settled))
    chained = jumps.join(levels.withColumnRenamed("call", "at"), "at").select("call", (F.col("level") + F.col("steps")).alias("level"))
    return all_calls.join(levels.union(chained), "call", "left").select("call.conv_id", "call.call_id", "level")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and result that belong together, per call without result, and per result without call.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON), depends_on. ``results``:
    conv_id, turn, call_id, content. Returns ``conv_id, call_id, name, call_turn,
    result_turn, level, status, errors, record``. Status: ok, invalid (arguments),
    early (the result's turn is not after the call's), unanswered, orphan (a result
    alone), cycle. Calls and results belong together when conv_id (null equals null) and
    call_id do. Null call_ids join with nothing. Several results of a call are a row
    each, as are repeated rows. ``record`` is the canonical JSON, with arguments that
    can't be read as the string they are; null for an orphan. Empty tables give no row of
    theirs. Extra columns of either table are ignored.
    """
    c = calls.select("conv_id", F.col("turn").alias("call_turn"), "call_id", "name", "arguments", "depends_on", F.lit(True).alias("called"))
    order = call_order(calls).toDF("o_conv", "o_call", "level")
    c = c.join(order, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("call_id") == F.col("o_call")), "left")
    r = results.select(F.col("conv_id").alias("result_conv"), F.col("turn").alias("result_turn"), F.col("call_id").alias("answers"), "content")
    both = c.join(r, F.col("conv_id").eqNullSafe(F.col("result_conv")) & (F.col("call_id") == F.col("answers")), "full")
    called = F.col("called").isNotNull()
    errors = F.when(called, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("errors", errors)
    status = (
        F.when(~called, "orphan").when(F.size("errors") > 0, "invalid").when(F.col("level").isNull(), "cycle")
        .when(F.col("answers").isNull(), "unanswered").when(F.col("result_turn") <= F.col("call_turn"), "early").otherwise("ok")
    )
    as_string = F.variant_get(F.parse_json(F.to_json(F.struct(F.col("arguments").alias("s")))), "$.s", "variant")
    record = canonical(F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), as_string).alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"))))
    return both.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), F.coalesce("call_id", "answers").alias("call_id"), "name", "call_turn", "result_turn",
        F.col("level").cast("long").alias("level"), status.alias("status"), F.array_join("errors", "; ").alias("errors"), F.when(called, record).alias("record"),
    )


#: The tools that ``conversation_calls`` names.
SCHEMAS = {
    "continue": {"required": ["length", "query"], "properties": {"length": "integer", "query": "string"}},
    "open": {"required": ["language", "length", "query"], "properties": {"language": "string", "length": "integer", "query": "string"}},
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chat turns: an assistant turn is a call, the user turn right after it its result.

    The first call of a conversation opens it, without the language its schema asks for;
    a later one depends on the assistant turn two turns before. Other roles are ignored.
    """
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    calls = m.where("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("turn") <= 2, "open").otherwise("continue").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.char_length("text").alias("length"))).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("depends_on"),
    )
    results = m.where("role = 'user'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
