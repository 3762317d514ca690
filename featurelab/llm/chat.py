"""Chat formatting with linked tool calls; DataFrame functions only.

Calls and results are joined by ``(conv_id, call_id)``; arguments are parsed as
variants and checked against the tools' schemas; calls and results are ordered
so that a result follows its call and a call follows the results it depends
on; every message becomes one canonical JSON text (object keys sorted, no
white space, null fields left out).  The result has one row per message with
its sort keys ``ord, level, step, turn``, never one row per conversation, so a
conversation of any length spreads over many tasks.

Defined results:

* a call is ``linked`` if it is valid and has a result, else ``unanswered``;
  ``invalid: <reason>`` if its arguments fail the schema, are no JSON object or
  name a key twice; ``ambiguous`` if its id occurs in several calls of the
  conversation; ``cycle`` if it depends on itself;
* a result is ``linked`` if its id has exactly one call, ``ambiguous`` if it has
  several, else ``orphan``; several results of a call are all linked;
* other messages are ``plain``;
* a null conversation, id or turn links with nothing; null texts are left out of
  the JSON; repeated rows repeat; empty tables give an empty result; extra and
  clashing columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: JSON schema types and the variant types that satisfy them
_TYPES = {"string": r"^STRING$", "integer": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$",
          "number": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$", "boolean": r"^BOOLEAN$",
          "array": r"^ARRAY<.*$", "object": r"^OBJECT<.*$", "null": r"^VOID$"}


def check_arguments(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """Why the JSON text ``arguments`` does not fit the schema of tool ``name``; null if it fits.

    ``tools``: ``{name: {"properties": {key: type}, "required": [key, ...]}}``.
    """
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    why = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit("not an object"))
    known = F.lit(False)
    for tool, schema in sorted(tools.items()):
        here = name == tool
        known = known | here
        for key in sorted(schema.get("required", ())):
            why = why.when(here & ~F.array_contains(keys, key), F.lit(f"missing {key}"))
        for key, kind in sorted(schema["properties"].items()):
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant"))
            why = why.when(here & F.array_contains(keys, key) & ~F.coalesce(got.rlike(_TYPES[kind]), F.lit(False)),
                           F.lit(f"{key} is no {kind}"))
        extra = F.array_except(keys, F.array(*(F.lit(k) for k in sorted(schema["properties"]))))
        why = why.when(here & (F.size(extra) > 0), F.lit("unexpected key"))
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")).otherwise(why)


#: path lengths stop growing here: no chain of calls is as long, and only paths around a cycle get there
_LONGEST = 1 << 40


def _ordered(calls: DataFrame) -> DataFrame:
    """``ord`` and ``level`` of each call from the calls it depends on; calls on a cycle have a null level.

    ``level`` is the longest path of dependencies, ``ord`` the latest turn on
    any.  Each round settles the calls whose needs are settled, and replaces a
    need that has one need itself by that one, with the path's length and latest
    turn; so a chain takes rounds in the logarithm of its length.
    """
    key = ["conv_id", "call_id"]
    needs = calls.select(*key, F.explode("depends").alias("need")).where("need is not null").distinct()
    base = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("turn").alias("ord"))
    needs = needs.join(base.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    base = common.stage(base, "call-base")
    # paths from a call to a need: their length and the latest turn on them, without the need's
    paths = common.stage(needs.join(base.withColumnRenamed("ord", "o"), key).select(*key, "need", F.lit(1).cast("long").alias("w"), "o"), "call-paths")
    # calls whose needs name no call of the conversation are free too
    level = common.stage(base.join(paths.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long")), "call-level")
    while True:
        known = level.select("conv_id", F.col("call_id").alias("need"), F.col("ord").alias("known_o"), F.col("level").alias("l"))
        ready = paths.join(known, ["conv_id", "need"], "left").groupBy(*key).agg(
            F.max(F.greatest("o", "known_o")).alias("ord"), F.max(F.col("l") + F.col("w")).alias("level"),
            F.count("l").alias("n"), F.count("*").alias("m")).where("n = m")
        ready = common.stage(ready.select(*key, "ord", "level"), "call-ready")
        if ready.limit(1).count() == 0:
            return base.select(*key, F.col("ord").alias("own")).join(level, key, "left") \
                .select(*key, F.coalesce("ord", "own").alias("ord"), "level")
        level = common.stage(level.unionByName(ready), "call-level")
        rest = paths.join(ready.select(*key), key, "left_anti")
        one = rest.groupBy(*key).agg(F.min("need").alias("far"), F.max("w").alias("far_w"), F.max("o").alias("far_o"), F.count("*").alias("m")) \
            .where("m = 1").select("conv_id", F.col("call_id").alias("need"), "far", "far_w", "far_o")
        step = rest.join(one, ["conv_id", "need"], "left")
        length = F.least(F.col("w") + F.coalesce("far_w", F.lit(0)), F.lit(_LONGEST))
        paths = common.stage(step.groupBy(*key, F.coalesce("far", "need").alias("need")).agg(
            F.max(length).alias("w"), F.max(F.greatest("o", "far_o")).alias("o")), "call-paths")


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """``conv_id, ord, level, step, turn, role, call_id, status, message`` of every message.

    ``messages``: ``conv_id, turn, role, text``; ``calls``: ``conv_id, turn,
    call_id, name, arguments`` (JSON text) and optionally ``depends`` (ids of
    calls); ``results``: ``conv_id, turn, call_id, text``.
    """
    common.prepare(messages.sparkSession)
    key = ["conv_id", "call_id"]
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = calls.select(*key, "turn", "name", "arguments", *(["depends"] if "depends" in calls.columns else []))
    results = results.select(*key, "turn", "text")
    # first what each id has on the other side, pre-aggregated; then one join by id per side
    has_calls = calls.groupBy(*key).agg(F.count("*").alias("n_calls"), F.min("turn").alias("call_turn"))
    has_results = results.groupBy(*key).agg(F.count("*").alias("n_results"))
    why = check_arguments(F.col("name"), F.col("arguments"), tools)
    linked = calls.join(has_results, key, "left").join(has_calls, key, "left").withColumn("why", why)
    if "depends" in calls.columns:
        place = _ordered(calls)
        linked = linked.join(place, key, "left")
        has_calls = has_calls.join(place, key, "left")
        cycle = F.col("level").isNull() & F.col("n_calls").isNotNull()
        at, level = F.coalesce("ord", "turn"), F.coalesce("level", F.lit(0))
        answer_at, answer_level = F.coalesce("ord", "turn"), level
    else:
        cycle = F.lit(False)
        at, level = F.col("turn"), F.lit(0)
        answer_at, answer_level = F.col("call_turn"), F.lit(0)
    status = F.when(F.col("n_calls") > 1, F.lit("ambiguous")).when(F.col("why").isNotNull(), F.concat(F.lit("invalid: "), "why")) \
        .when(cycle, F.lit("cycle")).when(F.col("n_results") > 0, F.lit("linked")).otherwise(F.lit("unanswered"))
    # valid arguments are embedded as an object (variants keep their keys sorted), others as a JSON string
    quoted = F.to_json(F.struct(F.col("arguments").alias("a")))
    value = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.substr(quoted, F.lit(6), F.length(quoted) - 6))
    ident = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("name").alias("name")))
    tail = F.when(ident == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substr(ident, F.lit(2))))
    head = F.when(F.col("arguments").isNotNull(), F.concat(F.lit('{"arguments":'), value, tail)).otherwise(ident)
    call_json = F.concat(F.lit('{"role":"assistant","tool_calls":['), head, F.lit("]}"))
    out = linked.select("conv_id", at.cast("long").alias("ord"), level.cast("int").alias("level"), F.lit(0).alias("step"), F.col("turn").cast("long").alias("turn"),
                        F.lit("assistant").alias("role"), "call_id", status.alias("status"), call_json.alias("message"))
    answers = results.join(has_calls, key, "left")
    out = out.unionByName(answers.select(
        "conv_id", F.when(F.col("n_calls") == 1, answer_at).otherwise(F.col("turn")).cast("long").alias("ord"),
        F.when(F.col("n_calls") == 1, answer_level).otherwise(F.lit(0)).cast("int").alias("level"), F.lit(1).alias("step"),
        F.col("turn").cast("long").alias("turn"), F.lit("tool").alias("role"), "call_id",
        F.when(F.col("n_calls") == 1, F.lit("linked")).when(F.col("n_calls") > 1, F.lit("ambiguous")).otherwise(F.lit("orphan")).alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("message")))
    return out.unionByName(messages.select(
        "conv_id", F.col("turn").cast("long").alias("ord"), F.lit(0).alias("level"), F.lit(0).alias("step"), F.col("turn").cast("long").alias("turn"), "role",
        F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))).alias("message")))


def parse_transcript(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of a transcript whose texts may hold tool JSON.

    An assistant text that is an object with ``tool_calls`` (``[{"id", "name",
    "arguments", "depends"}]``) gives calls; a text of role ``tool`` that is an
    object with ``tool_call_id`` gives a result with its ``content``.
    """
    call = "struct<id:string,name:string,arguments:string,depends:array<string>>"
    rows = conversations.select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    is_json = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    rows = rows.withColumn("j", F.when(is_json & F.coalesce(F.col("role").isin("assistant", "tool"), F.lit(False)),
                                       F.from_json("text", f"struct<content:string,tool_call_id:string,tool_calls:array<{call}>>")))
    called = F.coalesce((F.col("role") == "assistant") & F.col("j.tool_calls").isNotNull(), F.lit(False))
    answered = F.coalesce((F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull(), F.lit(False))
    calls = rows.where(called).select("conv_id", "turn", F.explode("j.tool_calls").alias("c")) \
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
                F.col("c.depends").alias("depends"))
    results = rows.where(answered).select("conv_id", "turn", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("text"))
    return rows.where(~called & ~answered).select("conv_id", "turn", "role", "text"), calls, results
