"""Chat formatting with linked tool calls, in built-in functions only.

Calls and results meet in a hash join by identifier. Calls name the call that
they come after; the longest way to each is found by pointer doubling
(a round doubles the distance that is known) along ids that wait for one call, and
in rounds over those that wait for several, and gives a topological order:
every call has a higher level than those that it waits for. Arguments are held
against the schema of their tool. Records are canonical JSON: object keys in
order, no white space, as Spark's VARIANT keeps and prints them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What a schema's type names are in ``schema_of_variant``.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}
#: Results of an id with so many are dealt over SALTS partitions.
HOT_RESULTS = 10_000
SALTS = 64


def canonical(json: Column) -> Column:
    """JSON text with keys in order and without white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json))


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments (JSON text), in the order of the schema: an array of texts, empty where they are valid.

    ``schemas`` has a JSON schema of an object for each tool, of which are used:
    required, properties (type, enum, minimum, maximum, maxLength) and
    additionalProperties = false.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    no = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))
    out = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("unknown tool")))
    out = out.when(value.isNull(), F.array(F.lit("arguments are no JSON"))).when(~kind.rlike(TYPES["object"]), F.array(F.lit("arguments are no object")))
    for tool, schema in schemas.items():
        checks = []
        properties = schema.get("properties", {})
        keys = F.json_object_keys(arguments)
        for p in schema.get("required", []):
            checks.append(no(~F.array_contains(keys, p), f"{p} is missing"))
        for p, rule in properties.items():
            at = F.try_variant_get(value, f"$.{p}", "variant")
            there = F.array_contains(keys, p)
            if "type" in rule:
                checks.append(no(there & ~F.coalesce(F.schema_of_variant(at), F.lit("VOID")).rlike(TYPES[rule["type"]]), f"{p} is no {rule['type']}"))
            if "enum" in rule:
                checks.append(no(there & ~F.coalesce(F.try_variant_get(value, f"$.{p}", "string"), F.lit("")).isin(rule["enum"]), f"{p} is none of the values"))
            for limit, sign in (("minimum", -1), ("maximum", 1)):
                if limit in rule:
                    number = F.try_variant_get(value, f"$.{p}", "double")
                    checks.append(no(number * sign > rule[limit] * sign, f"{p} is beyond its {limit}"))
            if "maxLength" in rule:
                checks.append(no(F.schema_of_variant(at).rlike(TYPES["string"]) & (F.length(F.try_variant_get(value, f"$.{p}", "string")) > rule["maxLength"]), f"{p} is too long"))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(p) for p in properties]) if properties else F.array().cast("array<string>")
            checks.append(no(F.size(F.array_except(keys, known)) > 0, "a property is unknown"))
        out = out.when(name == tool, F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): how many calls stand before each on the longest way, over what all rows of an id come after; null for a call in or after a circle. A call after unknown ones only is a first one."""
    ids = common.written(calls.where("call_id is not null").select("call_id", "after").distinct(), "calls")
    known = common.written(ids.select("call_id").distinct(), "calls")
    edges = common.written(ids.join(known.select(F.col("call_id").alias("after")), "after").select("call_id", "after"), "edges")
    counted = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("ptr"))
    # ids that wait for several calls end the ways of doubling, as first ones do
    at = known.join(counted, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("ptr")).alias("ptr"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("level"), F.col("call_id").alias("head"))
    at = common.written(at.withColumn("head", F.coalesce("ptr", "head")), "levels")
    rounds = max(1, known.count()).bit_length() + 1
    for _ in range(rounds):
        open_rows = at.where("ptr is not null")
        if not open_rows.limit(1).count():
            break
        step = at.select(F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("level").alias("more"), F.col("head").alias("to"))
        moved = open_rows.join(step, "ptr").select("call_id", F.col("next").alias("ptr"), (F.col("level") + F.col("more")).alias("level"), F.col("to").alias("head"))
        at = common.written(at.where("ptr is null").unionByName(moved), "levels")
    several = counted.where("n > 1").select("call_id")
    if not several.limit(1).count():
        return at.select("call_id", F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))

    # what is left of the graph: edges of ids that wait for several calls, to the heads of these
    way = at.where("ptr is null").select(F.col("call_id").alias("after"), "head", F.col("level").alias("far"))
    short = common.written(edges.join(several, "call_id").join(way, "after", "left").select("call_id", "head", "far"), "edges")
    done = common.written(at.where("head = call_id and ptr is null").join(several, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("top")), "tops")
    while True:
        step = short.join(done.select(F.col("call_id").alias("head"), "top"), "head", "left").join(done.select("call_id"), "call_id", "left_anti")
        ready = step.groupBy("call_id").agg(F.max(F.col("top") + F.col("far") + 1).alias("top"), F.count("top").alias("told"), F.count(F.lit(1)).alias("n")).where("told = n").select("call_id", "top")
        ready = common.written(ready, "tops")
        if not ready.limit(1).count():
            break
        done = common.written(done.unionByName(ready), "tops")
    tops = done.select(F.col("call_id").alias("head"), "top")
    return at.join(tops, "head", "left").select("call_id", F.when(F.col("ptr").isNull(), F.col("level") + F.col("top")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, call_id, kind, level, status, record) for each call, for each result without a call, and for each further result of one.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and after (the
    id of a call, or null); ``results`` has conv_id, turn, call_id and content.
    ``status`` is "ok", "invalid" (the arguments break the schema), "pending" (no
    result) or "circular" (no order exists), the last that holds; results without a
    call have kind and status "orphan". Where several results answer a call, that of the least
    (turn, content) is taken and ``n_results`` in the record tells how many there
    are; each of the others has a row of kind and status "result" at its own turn, with
    the level of its call. Calls that repeat an id are linked each. Null ids are never linked. Null
    contents and arguments are recorded as null. Empty tables give no rows.
    """
    told = results.groupBy("call_id", "conv_id", "turn", "content").agg(F.count(F.lit(1)).alias("n"))
    answered = told.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("first"), F.sum("n").alias("n_results"))
    order = common.written(levels(calls), "order")
    linked = calls.join(answered.hint("shuffle_hash"), "call_id", "left").join(order, "call_id", "left")
    errors = schema_errors(F.col("name"), F.col("arguments"), schemas)
    status = F.when(F.col("level").isNull() & F.col("call_id").isNotNull(), "circular").when(F.col("n_results").isNull(), "pending").when(F.size("errors") > 0, "invalid").otherwise("ok")
    fields = F.struct(F.try_parse_json("arguments").alias("arguments"), "errors", F.col("call_id").alias("id"), "level", F.coalesce("n_results", F.lit(0)).alias("n_results"), "name", F.col("first.content").alias("result"), "status")
    out = linked.withColumn("errors", errors).withColumn("status", status).select("conv_id", "turn", "call_id", F.lit("call").alias("kind"), "level", "status", F.to_json(F.to_variant_object(fields)).alias("record"))

    # rows of an id with many results are dealt over SALTS partitions
    hot = answered.where(F.col("n_results") >= HOT_RESULTS).select("call_id", F.lit(True).alias("hot"))
    spread = F.when(F.col("hot") | F.col("call_id").isNull(), F.pmod(F.xxhash64("conv_id", "turn", "content"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = told.join(F.broadcast(hot), "call_id", "left").withColumn("salt", spread).drop("hot")
    ids = order.join(answered, "call_id").select("call_id", "level", F.lit(True).alias("called"), F.when(F.col("n_results") > 1, F.col("first")).alias("first"), F.explode(F.when(F.col("n_results") >= HOT_RESULTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = dealt.join(ids, ["call_id", "salt"], "left")
    # the first is in its call's record, once
    taken = F.col("called").isNotNull() & (F.col("first").isNull() | F.struct("turn", "content", "conv_id").eqNullSafe(F.col("first")))
    left = F.col("n") - F.when(taken, 1).otherwise(0)
    kind = F.when(F.col("called").isNull(), "orphan").otherwise("result")
    rest = met.withColumn("kind", kind).withColumn("copies", F.explode(F.array_repeat(F.lit(0), left.cast("int"))))
    record = F.to_json(F.to_variant_object(F.struct(F.col("content"), F.col("call_id").alias("id"), F.col("kind").alias("status"))))
    return out.unionByName(rest.select("conv_id", "turn", "call_id", "kind", "level", F.col("kind").alias("status"), record.alias("record")))


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each message as canonical JSON of its role and content."""
    record = F.to_json(F.to_variant_object(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))))
    return messages.select("conv_id", "turn", record.alias("record"))
