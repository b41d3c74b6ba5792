"""Chat formatting: tool calls linked with their results, in DataFrame and SQL operations alone.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object may declare tools
({"tools": [{"name", "parameters": JSON schema}]}), make calls ({"content", "tool_calls": [{"id", "name", "arguments", "depends_on"}]})
or give a result ({"tool_call_id", "content"}). Calls and results of a conversation are joined on the call's
identifier, calls are put in topological order of what they depend on, arguments are validated against the tool's schema, and every message is written as canonical
JSON: sorted keys, no spaces, numbers in shortest form. The unit is the message, so a conversation of any length is
spread over tasks; a conversation or an identifier may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.json_schema import validate
from lorewell.llm.shared import materialize

# A message is parsed once; its parts go on as JSON, and its text only where it is the content.
_PARSED = """
SELECT conv_id, turn, role, m1, m2, call_id, CASE WHEN made THEN calls END AS calls, CASE WHEN startswith(tools, '[') THEN tools END AS tools,
       CASE WHEN made OR call_id IS NOT NULL THEN content END AS content, CASE WHEN made OR call_id IS NOT NULL THEN NULL ELSE text END AS text
FROM (SELECT *, CASE WHEN startswith(calls, '[') THEN exists(from_json(calls, 'array<variant>'), c -> startswith(to_json(c), '{{')) ELSE false END AS made FROM (SELECT conv_id, turn, role, text, try_variant_get(v, '$.tool_call_id', 'string') AS call_id, to_json(variant_get(v, '$.content', 'variant')) AS content,
             to_json(variant_get(v, '$.tool_calls', 'variant')) AS calls, to_json(variant_get(v, '$.tools', 'variant')) AS tools,
             xxhash64(conv_id, turn, role, text, nulls) AS m1, hash(nulls, text, role, turn, conv_id) AS m2
      FROM (SELECT *, CASE WHEN startswith(trim(LEADING ' \\t\\n\\r' FROM text), '{{') THEN try_parse_json(text) END AS v, concat(isnull(conv_id), isnull(turn), isnull(role), isnull(text)) AS nulls FROM {rows})))
"""

_CALLS = """
SELECT DISTINCT conv_id, turn, m1, m2, pos, variant_get(c, '$.id', 'string') AS id, variant_get(c, '$.name', 'string') AS name,
       CASE WHEN startswith(arguments, '"') THEN coalesce(to_json(try_parse_json(variant_get(c, '$.arguments', 'string'))), arguments) ELSE arguments END AS arguments,
       to_json(variant_get(c, '$.depends_on', 'variant')) AS depends_on
FROM (SELECT r.conv_id, r.turn, r.m1, r.m2, c.pos, c.value AS c, to_json(variant_get(c.value, '$.arguments', 'variant')) AS arguments
      FROM {rows} AS r, LATERAL variant_explode(parse_json(r.calls)) AS c WHERE r.calls IS NOT NULL AND startswith(to_json(c.value), '{{'))
"""

_TOOLS = """
SELECT conv_id, variant_get(t.value, '$.name', 'string') AS name, to_json(variant_get(t.value, '$.parameters', 'variant')) AS parameters, turn
FROM {rows}, LATERAL variant_explode(parse_json(tools)) AS t WHERE tools IS NOT NULL AND startswith(to_json(t.value), '{{')
"""

_CALL = ["conv_id", "m1", "m2", "pos"]
#: Turns of a block in which an identifier's results are looked up.
TURNS = 4096


def _same(a: str, b: str, *columns: str):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with valid: true or false, null if the conversation declares no such tool or its schema can't be told (see json_schema).
    Equal arguments of equal schemas are validated once."""
    given = F.coalesce("arguments", F.lit("null"))
    known = calls.alias("c").join(tools.alias("t"), _same("c", "t", "conv_id", "name"), "left").select("c.*", F.col("t.conv").alias("declared"), F.coalesce("parameters", F.lit("true")).alias("schema"))
    known = materialize(known.withColumn("k1", F.xxhash64("schema", given)).withColumn("k2", F.hash(given, "schema")))
    pairs = known.where("declared").groupBy("k1", "k2").agg(F.first("schema").alias("schema"), F.first(given).alias("value"))
    out = known.drop("schema").join(validate(pairs, ["k1", "k2"]), ["k1", "k2"], "left")
    # Arguments are an object, whatever the schema says.
    odd = ~F.coalesce(F.col("arguments").startswith("{"), F.lit(False))
    return out.withColumn("valid", F.when(F.col("declared"), F.when(odd, F.lit(False)).otherwise(F.col("valid")))).drop("declared", "k1", "k2")


def _ends(single: DataFrame) -> DataFrame:
    """Where chains of calls that depend on one other each end: (conv_id, id, needs, dist) of single (conv_id, id, needs), needs being the first on the way that depends on none
    or several, dist the steps to it; calls on or after a circle of such are left out. Pointers double in every round, so rounds grow with the logarithm of the longest chain."""
    way = materialize(single.withColumn("dist", F.lit(1).cast("long")).withColumn("done", F.lit(False)))
    was = -1
    while True:
        step = way.alias("a").join(way.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.needs") == F.col("b.id")), "left")
        way = materialize(step.select(
            "a.conv_id", "a.id", F.coalesce("b.needs", "a.needs").alias("needs"), (F.col("a.dist") + F.coalesce("b.dist", F.lit(0))).alias("dist"), F.col("b.id").isNull().alias("done"),
        ))
        done, every = way.agg(F.count_if("done"), F.count("*")).first()
        if done in (was, every):
            return way.where("done").drop("done")
        was = done


def _levels(calls: DataFrame) -> DataFrame:
    """calls with level: 0 if a call depends on no other of its conversation, else one more than the highest that it depends on; null on or after a cycle.
    A call depends on the ids in depends_on and on those that an argument names as "$id". Chains are followed by doubling; beyond that, rounds grow with the longest
    way over calls that depend on several, and a round reads and writes what is still open and what it has settled, no more."""
    named = F.concat(
        F.coalesce(F.from_json("depends_on", "array<string>"), F.array().cast("array<string>")),
        F.coalesce(F.regexp_extract_all("arguments", F.lit(r'"\$([A-Za-z0-9_-]+)'), F.lit(1)), F.array().cast("array<string>")),
    )
    ids = calls.where("id IS NOT NULL").select("conv_id", "id").distinct()
    edges = calls.where("id IS NOT NULL").select("conv_id", "id", F.explode(F.array_distinct(named)).alias("needs")).distinct()
    edges = materialize(edges.alias("e").join(ids.withColumnRenamed("id", "needs").alias("i"), _same("e", "i", "conv_id", "needs"), "left_semi"))
    if edges.isEmpty():
        return calls.withColumn("level", F.lit(0))
    degree = materialize(edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("needs").alias("needs")))
    ends = _ends(degree.where("n = 1").select("conv_id", "id", "needs"))
    settled = materialize(ids.alias("a").join(degree.alias("e"), _same("a", "e", "conv_id", "id"), "left_anti").withColumn("level", F.lit(0).cast("long")))
    # What depends on several, with the ends of the chains that it depends on in their place; chains that end nowhere stay open.
    several = edges.alias("e").join(degree.where("n > 1").alias("d"), _same("e", "d", "conv_id", "id"), "left_semi")
    far = several.alias("s").join(ends.select("conv_id", F.col("id").alias("needs"), F.col("needs").alias("end"), "dist").alias("x"), _same("s", "x", "conv_id", "needs"), "left")
    open_ = materialize(far.select("s.conv_id", "s.id", F.coalesce("x.end", "s.needs").alias("needs"), (F.coalesce("x.dist", F.lit(0)) + 1).alias("dist"), F.lit(None).cast("long").alias("top")))
    levels, new = [settled], settled
    while not open_.isEmpty():
        met = open_.alias("o").join(new.withColumnRenamed("id", "needs").alias("n"), _same("o", "n", "conv_id", "needs"), "left")
        met = materialize(met.select("o.conv_id", "o.id", "o.needs", "o.dist", F.coalesce("o.top", F.col("n.level") + F.col("o.dist")).alias("top")))
        new = materialize(met.groupBy("conv_id", "id").agg(F.max("top").alias("level"), F.count_if(F.col("top").isNull()).alias("open")).where("open = 0").drop("open"))
        if new.isEmpty():
            break
        levels.append(new)
        open_ = materialize(met.alias("m").join(new.alias("n"), _same("m", "n", "conv_id", "id"), "left_anti"))
    level = levels[0]
    for more in levels[1:]:
        level = level.unionByName(more)
    chained = ends.alias("e").join(level.withColumnRenamed("id", "needs").alias("l"), _same("e", "l", "conv_id", "needs")).select("e.conv_id", "e.id", (F.col("l.level") + F.col("e.dist")).alias("level"))
    level = level.unionByName(chained)
    return calls.alias("c").join(level.alias("l"), _same("c", "l", "conv_id", "id"), "left").select("c.*", F.when(F.col("c.id").isNull(), F.lit(0)).otherwise(F.col("level")).cast("int").alias("level"))


def _first_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, id, turn, r): for the turns of calls, the first result of their id in a later one, as struct(turn, m1, m2) of its message (of several in one turn, that
    of the smallest m1 and m2). Turns of one id are looked through in
    blocks, and blocks by the first result in each, so that neither a call nor a result meets all of its id's others."""
    key = ["conv_id", "id"]
    asked = calls.where("id IS NOT NULL AND turn IS NOT NULL").select(*key, "turn").distinct().withColumn("r", F.lit(None).cast("struct<turn: bigint, m1: bigint, m2: int>"))
    given = results.where("turn IS NOT NULL").groupBy(*key, "turn").agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), "m1", "m2")).alias("r"))
    rows = asked.withColumn("asks", F.lit(True)).unionByName(given.withColumn("asks", F.lit(False))).withColumn("block", F.floor(F.col("turn") / TURNS))
    later = Window.partitionBy(*key, "block").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.last("r", ignorenulls=True).over(later)).where("asks")
    per_block = rows.groupBy(*key, "block").agg(F.min("r").alias("least"))
    after = Window.partitionBy(*key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    per_block = per_block.withColumn("next", F.min("least").over(after))
    out = found.alias("f").join(per_block.alias("b"), _same("f", "b", "conv_id", "id", "block"), "left")
    return out.select("f.conv_id", "f.id", "f.turn", F.coalesce("f.found", "b.next").alias("r")).where("r IS NOT NULL")


def link_tool_calls(messages: DataFrame) -> DataFrame:
    """A row for each row of messages: conv_id, turn, role, n_calls, n_linked (calls with a result in a later turn), n_invalid (whose arguments break
    the declared schema, at any depth; not those whose validity can't be told, see json_schema), n_cyclic, linked (for a result: whether it has its call; else null) and line, the message as canonical JSON.

    A line holds content, role and turn; of a message with calls, tool_calls too, by level and place: arguments, id, level, name, result (the first one in a later turn; of several in that turn, any one, always the same),
    valid; of a result, tool_call_id. A null text has no content; a text that is no JSON object of these forms is content as it stands, however
    long. Null ids link with nothing; of several calls with one id, all get its result; rows that repeat are equal in all
    they return. Other columns are not read."""
    spark = messages.sparkSession
    own = messages.select("conv_id", "turn", "role", "text")
    rows = materialize(spark.sql(_PARSED, rows=own))
    calls = materialize(spark.sql(_CALLS, rows=rows))
    results = rows.where("call_id IS NOT NULL").select("conv_id", "turn", "m1", "m2", F.col("call_id").alias("id"), "content")
    tools = spark.sql(_TOOLS, rows=rows).groupBy("conv_id", "name").agg(F.min_by("parameters", F.struct("turn", "parameters")).alias("parameters"), F.lit(True).alias("conv"))
    calls = _levels(_validated(calls, materialize(tools)))
    first = _first_results(calls, results.drop("content")).join(results.select(F.col("m1").alias("r1"), F.col("m2").alias("r2"), "content").dropDuplicates(["r1", "r2"]), F.expr("r.m1 = r1 AND r.m2 = r2"))
    calls = calls.alias("c").join(first.alias("f"), _same("c", "f", "conv_id", "id", "turn"), "left").select("c.*", F.col("f.r1").isNotNull().alias("has"), F.col("f.content").alias("result"))
    item = F.struct(
        F.coalesce("level", F.lit(2**31 - 1)).alias("at"), "pos", "arguments", "id", "level", "name", "result", "valid", "has",
    )
    per = calls.groupBy("m1", "m2").agg(F.array_sort(F.collect_list(item)).alias("calls"))
    # A result has its call if one of its id stands in an earlier turn.
    begun = calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("turn").alias("begun"))
    linked = results.alias("r").join(begun.alias("b"), _same("r", "b", "conv_id", "id") & (F.col("begun") < F.col("r.turn")), "left_semi").select("m1", "m2").distinct().withColumn("met", F.lit(True))
    out = rows.drop("calls", "tools").join(per, ["m1", "m2"], "left").join(linked, ["m1", "m2"], "left")
    out = out.withColumn("made", F.col("calls").isNotNull())
    inner = F.expr("try_parse_json(content)")
    listed = F.expr(
        "transform(calls, c -> named_struct('arguments', try_parse_json(c.arguments), 'id', c.id, 'level', c.level, 'name', c.name, 'result', try_parse_json(c.result), 'valid', c.valid))"
    )
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))
    with_calls = F.to_json(F.struct(inner.alias("content"), "role", listed.alias("tool_calls"), "turn"))
    a_result = F.to_json(F.struct(inner.alias("content"), "role", F.col("call_id").alias("tool_call_id"), "turn"))
    line = F.when(F.col("made"), with_calls).when(F.col("call_id").isNotNull(), a_result).otherwise(plain)
    tally = lambda test: F.coalesce(F.size(F.filter("calls", test)), F.lit(0)).cast("long")
    none = F.when(~F.col("made"), F.lit(0).cast("long"))
    return out.select(
        "conv_id", "turn", "role",
        F.coalesce(none, F.size("calls").cast("long")).alias("n_calls"),
        F.coalesce(none, tally(lambda c: c["has"])).alias("n_linked"),
        F.coalesce(none, tally(lambda c: ~F.coalesce(c["valid"], F.lit(True)))).alias("n_invalid"),
        F.coalesce(none, tally(lambda c: c["level"].isNull())).alias("n_cyclic"),
        F.when(F.col("call_id").isNotNull(), F.coalesce("met", F.lit(False))).alias("linked"), line.alias("line"),
    )


# Fixed value: the tool of with_calls().
REPLY = '{"name":"reply","parameters":{"additionalProperties":false,"properties":{"chars":{"maximum":300,"minimum":1,"type":"integer"},"tone":{"enum":["short","long"]}},"required":["chars"],"type":"object"}}'


def with_calls(messages: DataFrame) -> DataFrame:
    """Conversations between people and an assistant as tool use: conv_id, turn, role and text of every row of messages. A user's message calls the tool REPLY with its length in
    characters, and a tone: short below 100, long below 300, else endless; its id is call- and the turn, and it depends on the call two turns before. An assistant's message is the result of the call in the turn before.
    Other roles stay as they are. A null text has no content and calls with nothing; a null turn gives no id."""
    chars = F.char_length("text")
    tone = F.when(chars < 100, "short").when(chars < 300, "long").when(chars.isNotNull(), "endless")
    name = lambda back: F.concat(F.lit("call-"), F.col("turn") - back)
    call = F.struct(F.struct(chars.alias("chars"), tone.alias("tone")).alias("arguments"), F.array(name(2)).alias("depends_on"), name(0).alias("id"), F.lit("reply").alias("name"))
    asks = F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"), F.array(F.parse_json(F.lit(REPLY))).alias("tools")))
    gives = F.to_json(F.struct(F.col("text").alias("content"), name(1).alias("tool_call_id")))
    return messages.select("conv_id", "turn", "role", F.when(F.col("role") == "user", asks).when(F.col("role") == "assistant", gives).otherwise(F.col("text")).alias("text"))
