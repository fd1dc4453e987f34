"""Chat formatting: tool calls linked to their results, in DataFrame
functions only.

Calls and results of a conversation meet in a hash join on (conversation,
call id). Calls are ordered topologically: an argument "$<id>" uses the
result of that call, so the call stands one level above the highest it
uses. Arguments are parsed and checked against the tool's schema, and each
exchange is serialised as canonical JSON (keys sorted at every depth, no
spaces, whole numbers without fraction).

Scale: every exchange is keyed by (conversation, call id), never by the
conversation alone, and the output is one row per call or stray result
with the columns that order it, so a conversation that holds a third of
all rows is spread like any other. Levels take as many rounds as the
longest chain of uses; only calls that use others take part. The schema
table is broadcast when it has at most BROADCAST_TOOLS tools.

Statuses: "linked"; "unanswered" (call without result); "stray" (result
without call); "early" (result before its call's turn); calls after the
first with an id are "repeated call", results after the first are
"repeated result". Equal (turn, place) ties are broken by the content.

Defined cases: a null conversation or call id links with nothing (status
"no id"); null or unparsable arguments are the error "not an object"; an
unknown tool is the error "unknown tool"; calls in a cycle of uses, or that
use such a call, have a null level and the error "cycle"; uses of unknown
ids are the error "unknown use" and do not count for the level; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

BROADCAST_TOOLS = 10_000
#: JSON types a schema may name, and how the parsed value calls them
_TYPES = {"string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)$",
          "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$",
          "array": "^ARRAY", "object": "^OBJECT"}


def calls_of(messages: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_turn, place, call_id, tool,
    arguments, and whether it is the first with its id."""
    c = messages.select("conv_id", F.col("turn").alias("call_turn"), F.posexplode_outer("calls").alias("place", "c")) \
        .where("c IS NOT NULL").select("conv_id", "call_turn", "place", F.col("c.id").alias("call_id"),
                                       F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"))
    c = c.withColumn("me", F.struct("call_turn", "place", "tool", "arguments"))
    lead = c.where("conv_id IS NOT NULL AND call_id IS NOT NULL") \
        .groupBy("conv_id", "call_id").agg(F.min("me").alias("lead"))
    c = c.join(lead, ["conv_id", "call_id"], "left")
    return c.withColumn("first", F.col("me").eqNullSafe(F.col("lead"))).drop("me", "lead")


def results_of(messages: DataFrame) -> DataFrame:
    """One row per result: conv_id, result_turn, call_id, content, and
    whether it is the first for its call."""
    r = messages.where("role = 'tool'").select(
        "conv_id", F.col("turn").alias("result_turn"), F.col("result_of").alias("call_id"), F.col("text").alias("content"))
    r = r.withColumn("me", F.struct("result_turn", "content"))
    lead = r.where("conv_id IS NOT NULL AND call_id IS NOT NULL") \
        .groupBy("conv_id", "call_id").agg(F.min("me").alias("lead"))
    r = r.join(lead, ["conv_id", "call_id"], "left")
    return r.withColumn("first", F.col("me").eqNullSafe(F.col("lead"))).drop("me", "lead")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, unknown): 0 for calls that use no other,
    else one more than the highest level used; null in or behind a cycle."""
    uses = F.filter(F.map_values(F.col("given")), lambda v: F.coalesce(v.rlike(r'^"\$.+"$'), F.lit(False)))
    uses = F.array_distinct(F.transform(uses, lambda v: F.regexp_extract(v, r'^"\$(.+)"$', 1)))
    own = calls.where("first").select("conv_id", "call_id", uses.alias("uses"))
    own = stage(own)
    asks = own.select("conv_id", "call_id", F.explode("uses").alias("used"))
    there = own.select("conv_id", F.col("call_id").alias("used"), F.lit(True).alias("known"))
    asks = stage(asks.join(there, ["conv_id", "used"], "left"))
    unknown = asks.where("known IS NULL").select("conv_id", "call_id", F.lit(True).alias("unknown")).distinct()
    edges = stage(asks.where("known").select("conv_id", "call_id", "used"))
    users = edges.select("conv_id", "call_id").distinct()
    done = stage(own.select("conv_id", "call_id").join(users, ["conv_id", "call_id"], "left_anti")
                 .withColumn("level", F.lit(0)))
    parts, open_ = [done], edges
    while True:
        # uses that are settled now; a call is settled with its last use
        open_ = open_.join(done.select("conv_id", F.col("call_id").alias("used"), F.col("level").alias("now")),
                           ["conv_id", "used"], "left")
        if "best" not in open_.columns:
            open_ = open_.withColumn("best", F.lit(None).cast("int"))
        open_ = stage(open_.withColumn("best", F.coalesce("best", "now")).drop("now"))
        ready = open_.groupBy("conv_id", "call_id").agg(
            F.count("*").alias("n"), F.count("best").alias("settled"), F.max("best").alias("top")) \
            .where("n = settled")
        done = stage(ready.select("conv_id", "call_id", (F.col("top") + 1).alias("level")))
        if done.isEmpty():
            break
        parts.append(done)
        open_ = stage(open_.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return own.select("conv_id", "call_id").join(out, ["conv_id", "call_id"], "left") \
        .join(unknown, ["conv_id", "call_id"], "left")


def errors_of(given: Column, fields: Column) -> Column:
    """What is wrong with parsed arguments (name -> JSON) under a schema
    (array of field, type, required; null for an unknown tool), sorted."""
    def type_of(v):
        return F.coalesce(F.schema_of_variant(F.try_parse_json(v)), F.lit("VOID"))

    def misfit(f):
        v = F.try_element_at(given, f["field"])
        wrong = F.lit(False)
        for name, seen in _TYPES.items():
            wrong = wrong | ((f["type"] == name) & ~type_of(v).rlike(seen))
        return F.when(v.isNull(), F.when(f["required"], F.concat(F.lit("missing "), f["field"]))) \
            .when(wrong, F.concat(F.lit("type of "), f["field"]))
    listed = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys(given), listed), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.filter(F.transform(fields, misfit), lambda e: e.isNotNull()), extra)
    return F.when(given.isNull(), F.array(F.lit("not an object"))) \
        .when(fields.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(found))


def _quoted(c: Column) -> Column:
    """A JSON string literal, or null."""
    one = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(one, 2, F.length(one) - 2))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Exchanges of ``messages`` (conv_id, turn, role, text, calls:
    array<struct<id, name, arguments>>, result_of) under ``schemas`` (tool,
    field, type, required). One row per call or stray result: conv_id,
    call_id, call_turn, place, result_turn, status, level, tool, errors,
    json. Sort a conversation by level, call_turn, place."""
    # objects parse to name -> value; values keep their own JSON text, with
    # the keys of nested objects in order
    parsed = F.try_parse_json("arguments")
    shape = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    calls = calls_of(messages).withColumn("given", F.when(
        shape.startswith("OBJECT"), F.from_json(F.to_json(parsed), "map<string,variant>")))
    calls = calls.withColumn("given", F.transform_values("given", lambda k, v: F.to_json(v)))
    calls = stage(calls)
    results = stage(results_of(messages))

    linked = calls.where("first").join(results.where("first").drop("first"), ["conv_id", "call_id"], "full") \
        .withColumn("status", F.when(F.col("first").isNull(), "stray").when(F.col("result_turn").isNull(), "unanswered")
                    .when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked"))
    again = calls.where("NOT first").withColumn("result_turn", F.lit(None).cast("long")) \
        .withColumn("content", F.lit(None).cast("string")).withColumn(
            "status", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no id").otherwise("repeated call"))
    late = results.where("NOT first").withColumn(
        "status", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no id").otherwise("repeated result"))
    rows = linked.unionByName(again).unionByName(late.drop("first"), allowMissingColumns=True)

    tools = schemas.groupBy("tool").agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    tools = stage(tools)
    if tools.count() <= BROADCAST_TOOLS:
        tools = F.broadcast(tools)
    rows = rows.join(tools, "tool", "left").join(levels(calls), ["conv_id", "call_id"], "left")
    is_call = F.col("call_turn").isNotNull()
    deep = F.when(F.col("unknown"), F.array(F.lit("unknown use"))).otherwise(F.array().cast("array<string>"))
    cycle = F.when(F.col("level").isNull() & F.coalesce(F.col("first"), F.lit(False)),
                   F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    wrong = F.when(is_call, F.array_sort(F.concat(errors_of(F.col("given"), F.col("fields")), deep, cycle))) \
        .otherwise(F.array().cast("array<string>"))
    body = F.concat(F.lit("{"), F.array_join(F.transform(
        F.array_sort(F.map_entries("given")), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(body, _quoted(F.col("arguments"))), F.lit(',"id":'), _quoted(F.col("call_id")),
        F.lit(',"name":'), _quoted(F.col("tool")), F.lit(',"result":'), _quoted(F.col("content")),
        F.lit(',"status":'), _quoted(F.col("status")), F.lit("}"))
    return rows.select("conv_id", "call_id", "call_turn", "place", "result_turn", "status",
                       F.when(F.col("first"), F.col("level")).alias("level"), "tool", wrong.alias("errors"),
                       json.alias("json"))
