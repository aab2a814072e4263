"""Chat formatting by tool-call linking (native: DataFrame functions only).

Messages carry calls (id, name, arguments as JSON, ids they depend on) or are the result of a
call. Calls and results of a conversation are hash-joined by identifier; every event gets the
level of its longest chain of dependencies (a result follows its call, a call follows what it
depends on); arguments are validated against the tool's schema; and each message is written as
canonical JSON: keys in code-point order, no spaces, numbers and escapes in one form. Output
is a row a message with a sort key (turn, level), so that no conversation, however long, has
to fit one task; ``ORDER BY conv_id, turn, level`` is the chat.

Cases: an id called twice in a conversation belongs to its least turn, later calls of it are
``duplicate``; a result without a call, or before it, is unlinked; arguments that aren't a
JSON object, an unknown tool, a missing or undeclared parameter or one of another type are
invalid, with the reason; calls on a dependency cycle have level null; null texts are JSON
null; null ids never link (a call of a null conversation is unlinked, of level 0); repeated rows are kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Schemas are broadcast up to this many tools, else they join by shuffle.
BROADCAST_TOOLS = 10_000
#: Blocks of calls have so many turns, then so many times more; larger ones than so many
#: dependencies aren't folded, nor calls into more terms.
BLOCK, WIDER, BLOCK_EDGES, TERMS = 64, 16, 4_096, 16


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _type_ok(kind: Column, wanted: Column) -> Column:
    return (
        (wanted == "any")
        | ((wanted == "string") & (kind == "STRING"))
        | ((wanted == "integer") & (kind == "BIGINT"))
        | ((wanted == "number") & (kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")))
        | ((wanted == "boolean") & (kind == "BOOLEAN"))
        | ((wanted == "object") & kind.startswith("OBJECT"))
        | ((wanted == "array") & kind.startswith("ARRAY"))
    )


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` (name, arguments) with ``problem``: null if the arguments fit the schema
    (name, params: array of struct(name, type, required))."""
    known = schemas.select(F.col("name").alias("_tool"), F.col("params").alias("_params")).dropDuplicates(["_tool"])
    if known.count() <= BROADCAST_TOOLS:
        known = F.broadcast(known)
    given = F.from_json("arguments", "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    out = calls.join(known, F.col("name") == F.col("_tool"), "left").withColumn("_given", F.when(is_object, given))
    kinds = F.coalesce(F.transform_values("_given", lambda _, v: F.schema_of_variant(v)), F.create_map().cast("map<string,string>"))
    out = out.withColumn("_kinds", kinds)
    names = F.transform("_params", lambda p: p["name"])
    missing = F.filter("_params", lambda p: p["required"] & ~F.map_contains_key("_kinds", p["name"]))
    extra = F.array_except(F.map_keys("_kinds"), names)
    wrong = F.filter(
        "_params",
        lambda p: F.map_contains_key("_kinds", p["name"]) & ~_type_ok(F.element_at("_kinds", p["name"]), p["type"]))
    problem = (
        F.when(F.col("_tool").isNull(), "unknown tool")
        .when(F.col("_given").isNull(), "arguments are no object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.element_at(F.transform(missing, lambda p: p["name"]), 1)))
        .when(F.size(extra) > 0, F.concat(F.lit("undeclared "), F.array_min(extra)))
        .when(F.size(wrong) > 0, F.concat(F.lit("type of "), F.element_at(F.transform(wrong, lambda p: p["name"]), 1)))
    )
    return out.withColumn("problem", problem).drop("_tool", "_params", "_given", "_kinds")


def _folded(edges: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """``edges`` with the calls of each block of ``width`` turns written in terms of calls outside
    it: in the order of turns, what a call needs is replaced by what that needs in its turn. Blocks
    of more than BLOCK_EDGES edges, calls without a turn and calls that would need more than TERMS
    others stay as they are, which is as right."""
    block = ["conv_id", "block"]
    edges = edges.join(turns, ["conv_id", "call_id"]).withColumn("block", F.floor(F.col("turn") / width))
    edges = common.materialize(edges.join(edges.groupBy(*block).agg(F.count("*").alias("size")), block, "left"), "chat-blocks")
    small = F.coalesce(F.col("size") <= BLOCK_EDGES, F.lit(False))
    calls = edges.filter(small).groupBy(*block, "turn", "call_id").agg(F.collect_list(F.struct("needs", "step")).alias("terms"))
    blocks = calls.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("turn", "call_id", "terms"))).alias("calls"))

    def term(needs: Column, step: Column) -> Column:
        return F.struct(needs.alias("needs"), step.alias("step"))

    def replaced(known: Column, t: Column) -> Column:
        inner = F.transform(F.try_element_at(known, t["needs"]), lambda u: term(u["needs"], u["step"] + t["step"]))
        return F.coalesce(inner, F.array(term(t["needs"], t["step"])))

    def longest(terms: Column) -> Column:
        steps = lambda n: F.transform(F.filter(terms, lambda t: t["needs"].eqNullSafe(n)), lambda t: t["step"])
        return F.transform(F.array_distinct(F.transform(terms, lambda t: t["needs"])), lambda n: term(n, F.array_max(steps(n))))

    def fold(known: Column, call: Column) -> Column:
        terms = longest(F.flatten(F.transform(call["terms"], lambda t: replaced(known, t))))
        terms = F.when(F.size(terms) <= TERMS, terms).otherwise(call["terms"])
        return F.map_concat(known, F.create_map(call["call_id"], terms))

    none = F.expr("cast(map() as map<string, array<struct<needs: string, step: int>>>)")
    done = blocks.select("conv_id", F.explode(F.aggregate("calls", none, fold)).alias("call_id", "terms"))
    done = done.select("conv_id", "call_id", F.inline("terms"))
    return common.materialize(done.unionByName(edges.filter(~small).select("conv_id", "call_id", "needs", "step")), "chat-edges")


def _settled(edges: DataFrame, longest: int) -> DataFrame:
    """(conv_id, call_id, level) of the calls that are on no cycle nor behind one.
    Only round a cycle are there more than ``longest`` steps, so they are counted no further.

    A call settles when all it needs has. An unsettled call that needs one other is passed on to
    what that one needs, so a chain takes as many rounds as its length has binary digits; calls
    that need several take a round each. Where no call settles in so many rounds, only cycles are
    left."""
    key = ["conv_id", "call_id"]
    done = edges.select(*key, F.col("step").alias("level")).limit(0)
    most = edges.groupBy("conv_id").agg(F.countDistinct("call_id").alias("n")).agg(F.max("n")).head()[0] or 0
    patience, idle = most.bit_length() + 1, 0
    while idle <= patience:
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        state = common.materialize(_reached(edges, known), "chat-state")
        ready, waiting = state.filter("n = k").select(*key, "level"), state.filter("n > k")
        if ready.head(1):
            idle = 0
            done = done.unionByName(ready)
        else:
            idle += 1
        if not waiting.head(1):
            break
        hop = waiting.filter("n = 1").select("conv_id", F.col("call_id").alias("needs"), "one", "far")
        edges = edges.join(waiting.select(*key), key, "left_semi").join(hop, ["conv_id", "needs"], "left")
        step = F.least(F.col("step") + F.coalesce("far", F.lit(0)), F.lit(longest + 2))
        edges = edges.select(*key, F.coalesce("one", "needs").alias("needs"), step.alias("step"))
        edges = common.materialize(edges.groupBy(*key, "needs").agg(F.max("step").alias("step")), "chat-edges")
    return done


def _reached(edges: DataFrame, known: DataFrame) -> DataFrame:
    """For each call the number n of its terms, k of those with a level, and the highest of them."""
    level = F.when(F.col("needs").isNull(), F.col("step")).otherwise(F.col("level") + F.col("step"))
    return edges.join(known, ["conv_id", "needs"], "left").withColumn("level", level).groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n"), F.count("level").alias("k"), F.max("level").alias("level"), F.min("needs").alias("one"), F.min("step").alias("far"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies on known calls, else two more than
    the highest (the result lies between); null on or behind a cycle. ``calls`` has conv_id,
    call_id, depends_on and, if known, turn.

    Dependencies mostly go to earlier turns near by. So the calls of a block of turns are first
    written in terms of the few calls before the block; of these calls alone wider blocks are
    made, until none or one block is left. What remains (dependencies on later turns) settles call by
    call, and the levels are put in, block by block, on the way back. A conversation of any length
    and any number of dependencies takes a few rounds, and no task more than a block."""
    key = ["conv_id", "call_id"]
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    turns = F.min("turn") if "turn" in calls.columns else F.min(F.lit(None))
    calls = calls.groupBy(*key).agg(turns.cast("long").alias("turn"))
    edges = edges.join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
    if not edges.head(1):  # nothing depends on anything
        return calls.select(*key, F.lit(0).alias("level"))
    edges = common.materialize(edges, "chat-edges")
    # What needs a call without dependencies has a level already: a term without ``needs``.
    inner = edges.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("inner")).distinct()
    first = edges.join(inner, ["conv_id", "needs"], "left").select(*key, F.when(F.col("inner"), F.col("needs")).alias("needs"))
    rest = common.materialize(first.distinct().withColumn("step", F.lit(2)), "chat-edges")
    span = calls.agg(F.max("turn") - F.min("turn")).head()[0]
    width, steps = BLOCK, []
    while span is not None and rest.head(1):
        steps.append(_folded(rest, calls, width))
        wanted = steps[-1].select("conv_id", F.col("needs").alias("call_id")).filter("call_id is not null").distinct()
        rest = common.materialize(steps[-1].join(wanted, key, "left_semi"), "chat-edges")
        if width > span:
            break
        width *= WIDER
    longest = 2 * calls.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    done = _settled(rest, longest) if rest.head(1) else rest.select(*key, F.col("step").alias("level"))
    for step in reversed(steps):
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        done = common.materialize(_reached(step, known).filter("n = k").select(*key, "level"), "chat-levels")
    roots = calls.join(edges, key, "left_anti").select(*key, F.lit(0).alias("level"))
    return calls.select(*key).join(done.unionByName(roots), key, "left")


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, content, call_id, name, arguments, depends_on,
    result_of) as rows of kind call, result or message with link, level and canonical JSON."""
    m = messages.select(
        "conv_id", "turn", "role", "content", "call_id", "name", "arguments", "depends_on", "result_of",
        F.when(F.col("call_id").isNotNull(), "call").when(F.col("result_of").isNotNull(), "result").otherwise("message").alias("kind"))
    calls = m.filter("kind = 'call'").drop("result_of")
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    level = levels(calls)
    key = ["conv_id", "call_id"]
    # Left joins: calls of a null conversation match nothing and stay.
    calls = validate(calls, schemas).join(first, key, "left").join(level, key, "left")
    calls = calls.select(
        *key, "turn", "role", "kind", F.coalesce(F.col("turn") == F.col("call_turn"), F.lit(False)),
        F.when(F.col("conv_id").isNull(), 0).otherwise(F.col("level")), "problem",
        F.to_json(F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "kind", "name", "role", "turn",
        ), {"ignoreNullFields": "false"}).alias("json"),
    ).toDF(*key, "turn", "role", "kind", "linked", "level", "problem", "json")
    results = m.filter("kind = 'result'").withColumn("call_id", F.col("result_of"))
    results = results.join(first, key, "left").join(level, key, "left")
    linked = F.coalesce(F.col("call_turn") < F.col("turn"), F.lit(False))
    results = results.withColumn("linked", linked).select(
        *key, "turn", "role", "kind", "linked", F.when(linked, F.col("level") + 1).alias("level"),
        F.when(~linked, F.lit("no call")).alias("problem"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), "kind", "linked", "role", "turn"), {"ignoreNullFields": "false"}).alias("json"))
    plain = m.filter("kind = 'message'").select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), "turn", "role", "kind", F.lit(False).alias("linked"),
        F.lit(0).alias("level"), F.lit(None).cast("string").alias("problem"),
        F.to_json(F.struct("content", "kind", "role", "turn"), {"ignoreNullFields": "false"}).alias("json"))
    return calls.unionByName(results).unionByName(plain)


def from_turns(turns: DataFrame) -> DataFrame:
    """Plain turns as events. A user turn is a call: of ``explain`` (text, lines) if it has several
    lines, else of ``reply`` (text, words); of more than LONG words, with the mark ``long``, which
    ``reply`` doesn't declare. It depends on the user turns two and four turns before, where these
    are. The assistant's next turn is the result of that call, other turns are messages."""
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    n, lines = common.word_count(F.col("text")), F.size(F.split("text", "\n")).cast("long")
    several = F.coalesce(lines > 1, F.lit(False))
    given = F.to_json(F.struct(
        F.when(several, lines).alias("lines"), F.when(n > LONG, True).alias("long"), "text", F.when(~several, n).alias("words")))
    call = lambda back: F.concat_ws("-", F.lit("call"), (F.col("turn") - back).cast("string"))
    return turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").alias("content"),
        F.when(user, call(0)).alias("call_id"), F.when(user, F.when(several, "explain").otherwise("reply")).alias("name"),
        F.when(user, given).alias("arguments"), F.when(user, F.array(call(2), call(4))).alias("depends_on"),
        F.when(assistant, call(1)).alias("result_of"))


LONG = 60
SCHEMA = "name string, params array<struct<name string, type string, required boolean>>"
TOOLS = (
    ("reply", (("text", "string", True), ("words", "integer", True))),
    ("explain", (("text", "string", True), ("lines", "integer", True), ("long", "boolean", False))),
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tools = spark.createDataFrame([(n, list(p)) for n, p in TOOLS], SCHEMA)
    return link(from_turns(turns), tools).select("conv_id", "turn", "level", "kind", "call_id", "linked", "problem", "json")


ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result'
             ELSE 'message' END AS kind, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
             coalesce(len(text) - len(replace(text, chr(10), '')) + 1, 0) AS lines FROM conversations),
k AS (SELECT DISTINCT conv_id, turn FROM c WHERE kind = 'call' AND conv_id IS NOT NULL AND turn IS NOT NULL),
w AS (SELECT conv_id, turn, 0 AS level FROM k UNION SELECT k.conv_id, k.turn, w.level + 2 FROM w JOIN k ON k.conv_id = w.conv_id AND k.turn IN (w.turn + 2, w.turn + 4)),
v AS (SELECT conv_id, turn AS call_turn, 'call-' || turn AS id, max(level) AS level FROM w GROUP BY ALL),
e AS (SELECT c.*, CASE kind WHEN 'call' THEN 'call-' || turn WHEN 'result' THEN 'call-' || (turn - 1) END AS call_id, words > 60 AS long FROM c),
l AS (SELECT e.*, v.call_turn, v.level, CASE kind WHEN 'call' THEN true WHEN 'result' THEN coalesce(v.call_turn < e.turn, false) ELSE false END AS linked
      FROM e LEFT JOIN v ON v.conv_id = e.conv_id AND v.id = e.call_id)
SELECT conv_id, turn, (CASE WHEN kind = 'call' THEN level WHEN kind = 'message' THEN 0 WHEN linked THEN level + 1 END)::INT AS level, kind, call_id, linked,
  CASE WHEN kind = 'result' AND NOT linked THEN 'no call' WHEN kind <> 'call' THEN NULL WHEN text IS NULL THEN 'missing text' WHEN lines < 2 AND long THEN 'undeclared long' END AS problem,
  CASE kind
    WHEN 'call' THEN '{"arguments":{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END || CASE WHEN long THEN '"long":true,' ELSE '' END
      || coalesce('"text":' || to_json(text)::VARCHAR, '') || CASE WHEN lines > 1 THEN '' WHEN text IS NULL THEN '"words":0' ELSE ',"words":' || words END
      || '},"id":"' || call_id || '","kind":"call","name":"' || CASE WHEN lines > 1 THEN 'explain' ELSE 'reply' END || '","role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}'
    WHEN 'result' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || call_id || '","kind":"result","linked":' || linked || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}'
    ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"kind":"message","role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' END AS json
FROM l
"""
