"""Chat formatting with linked tool calls. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tool's arguments: (name, type, required, least length or value). Types: string, integer, number, boolean.
REPLY_SCHEMA = (("prompt", "string", True, 1), ("turn", "integer", True, 0))

CARRIED = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"

#: What ``schema_of_variant`` calls values of each type; an integer may be too large for 64 bits.
KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": r"^BOOLEAN$"}


def carried_calls(messages: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments) that assistants' texts carry as JSON ``{"tool_calls": [...]}``.

    Texts that are no such JSON hold none; calls without an id are left out.
    """
    parsed = messages.where((F.col("role") == "assistant") & F.col("text").startswith("{")).withColumn("j", F.from_json("text", CARRIED))
    call = parsed.select("conv_id", "turn", F.explode("j.tool_calls").alias("c"))
    return call.where("c.id IS NOT NULL").select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def carried_results(messages: DataFrame) -> DataFrame:
    """Results (conv_id, turn, call_id, content) that tools' texts carry as JSON ``{"tool_call_id": ..., "content": ...}``."""
    parsed = messages.where((F.col("role") == "tool") & F.col("text").startswith("{")).withColumn("j", F.from_json("text", CARRIED))
    return parsed.where("j.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("content"))


def turn_calls(messages: DataFrame) -> DataFrame:
    """A user's turn as a call of the tool ``reply``, with the conversation and turn as its identifier."""
    user = messages.where((F.col("role") == "user") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"})
    return user.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))


def turn_results(messages: DataFrame) -> DataFrame:
    """An assistant's turn as the result of the call made in the turn before."""
    own = messages.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return own.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def problem(arguments: Column, schema) -> Column:
    """The first thing wrong with a JSON object of arguments, by the order of the schema; ``ok`` if nothing is.

    Values are of the type that their JSON token has: "3" is a string, 3 an integer, 3.5 a number. A null is missing.
    """
    value = F.try_parse_json(arguments)
    found = F.when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False)), "no object")
    for name, kind, required, least in schema:
        own = F.try_variant_get(value, "$['" + name + "']", "variant")
        token = F.schema_of_variant(own)
        missing = F.coalesce(token, F.lit("VOID")) == "VOID"
        if required:
            found = found.when(missing, f"{name}: missing")
        found = found.when(~missing & ~token.rlike(KINDS[kind]), f"{name}: not of type {kind}")
        if kind == "string":
            found = found.when(~missing & (F.length(F.try_variant_get(own, "$", "string")) < least), f"{name}: too short")
        elif kind != "boolean":
            found = found.when(~missing & (F.try_variant_get(own, "$", "double") < least), f"{name}: too small")
    return found.otherwise("ok")


def canonical(**fields: Column) -> Column:
    """JSON of the fields with their names in order, no white space, and nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One canonical JSON line for each event: messages, calls with what validation says, and results with their call.

    messages has conv_id, turn, role and text; calls conv_id, turn, call_id, name and arguments (JSON); results
    conv_id, turn, call_id and content. Results join their call by conv_id (null is one conversation) and
    call_id. Of repeated calls of one id in a conversation, the first by turn, name and arguments is linked, so a result
    never meets two; the others have status ``repeated``; results without a call have status ``orphan``, calls
    without a result ``open``. Tools without a schema accept any object.

    Order is topological: sorted by conv_id, order_turn, level and the rest, a result stands after its call even if
    it was logged earlier (order_turn is the later of both turns; calls have level 1, results 2, messages 0).
    Rows with null ids or turns stay, with nulls in their JSON; repeated messages and results come out as often as
    they come; empty tables give no rows.
    """
    long_ids = [F.col("conv_id").cast("long"), F.col("turn").cast("long")]
    own = calls.where("call_id IS NOT NULL").select(long_ids[0].alias("conv"), "call_id", F.struct(long_ids[1].alias("turn"), long_ids[0].alias("conv_id"), "name", "arguments").alias("call"))
    each = own.withColumn("again", F.row_number().over(Window.partitionBy("conv", "call_id").orderBy("call")) > 1)
    status = F.lit("no schema")
    for name, schema in sorted(schemas.items()):
        status = F.when(F.col("call.name") == name, problem(F.col("call.arguments"), schema)).otherwise(status)
    each = each.withColumn("status", status)
    answered = results.groupBy(long_ids[0].alias("answer_conv"), F.col("call_id").alias("answer_id")).agg(F.count("*").alias("n"))
    call_rows = each.join(answered, (F.col("call_id") == F.col("answer_id")) & F.col("conv").eqNullSafe(F.col("answer_conv")), "left").select(
        F.col("call.conv_id").alias("conv_id"), F.col("call.turn").alias("order_turn"), F.lit(1).alias("level"), "call_id",
        F.when(F.col("again"), F.concat(F.lit("repeated, "), "status")).when(F.col("n").isNull(), F.concat(F.lit("open, "), "status")).otherwise(F.col("status")).alias("status"),
        canonical(arguments=F.col("call.arguments"), conv_id=F.col("call.conv_id"), id=F.col("call_id"), name=F.col("call.name"), role=F.lit("call"), turn=F.col("call.turn")).alias("json"),
    )
    known = each.where(~F.col("again")).select("conv", F.col("call_id").alias("known_id"), F.col("call.turn").alias("call_turn"), F.col("call.name").alias("name"), F.lit(True).alias("linked"))
    linked = results.select(long_ids[0].alias("conv_id"), long_ids[1].alias("turn"), "call_id", "content").join(known, (F.col("call_id") == F.col("known_id")) & F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    result_rows = linked.select(
        "conv_id", F.greatest("turn", "call_turn").alias("order_turn"), F.lit(2).alias("level"), "call_id",
        F.when(F.col("linked"), "linked").otherwise("orphan").alias("status"),
        canonical(content=F.col("content"), conv_id=F.col("conv_id"), id=F.col("call_id"), name=F.col("name"), role=F.lit("result"), turn=F.col("turn")).alias("json"),
    )
    message_rows = messages.select(
        long_ids[0].alias("conv_id"), long_ids[1].alias("order_turn"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"),
        canonical(content=F.col("text"), conv_id=long_ids[0], role=F.col("role"), turn=long_ids[1]).alias("json"),
    )
    return message_rows.unionByName(call_rows).unionByName(result_rows)


def format_turns(messages: DataFrame) -> DataFrame:
    """Conversations whose user turns call ``reply`` and whose assistant turns answer, with the calls that texts carry."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls = turn_calls(messages).unionByName(carried_calls(messages))
    results = turn_results(messages).unionByName(carried_results(messages))
    others = messages.where(~F.coalesce(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(False)))
    return format_chats(others, calls, results, {"reply": REPLY_SCHEMA})
