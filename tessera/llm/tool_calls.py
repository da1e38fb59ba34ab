"""Tool calls in chat logs: linked to their results, put in order, validated and written as canonical JSON.

A message may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``, and results, ``<tool_result>{"call_id",
"content"}</tool_result>``. Every message becomes events: its plain content, its calls and its results, a row each, so that
no conversation, however long, has to fit in one row or one task. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

#: A wrapper ends at the first closing tag outside the strings of its JSON; if there is none, at the first closing tag. Outside of
#: strings no other opening tag of its kind may come before that: one that isn't closed is plain text. So what is read from one opening
#: tag is not read again from the next, and a text takes time in proportion to its length.
_WRAPPED = r"(?s)<{0}>((?:[^\"<\\]++|\\.|\"(?:[^\"\\]++|\\.)*+\"|<(?!/?{0}>))*+(?=</{0}>)|(?:[^<]++|<(?!/?{0}>))*+(?=</{0}>))</{0}>"
CALL, RESULT = _WRAPPED.format("tool_call"), _WRAPPED.format("tool_result")
#: An argument of this form stands for the result of the call it names, which must come first.
REFERENCE = r"\$\{([^}]+)\}"


def events(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, part, role, kind, raw, body): kind is message, call or result; body is the parsed JSON of the latter two."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), text.alias("text"))
    tagged = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
    found = F.concat(tagged("call", CALL), tagged("result", RESULT))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", CALL, ""), RESULT, ""))
    has = F.contains("text", F.lit("<tool_"))
    none = F.array().cast("array<struct<kind:string,raw:string>>")
    both = base.withColumn("found", F.when(has, found).otherwise(none)).withColumn("plain", F.when(has, plain).otherwise(F.col("text")))
    message = F.array(F.struct(F.lit("message").alias("kind"), F.col("plain").alias("raw")))
    parts = F.concat(F.when((F.col("plain") != "") | (F.size("found") == 0), message).otherwise(none), F.col("found"))
    out = both.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "e"))
    return out.select("conv_id", "turn", "part", "role", "e.kind", "e.raw", F.when(F.col("e.kind") != "message", F.try_parse_json("e.raw")).alias("body"))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("body", f"$.{path}", kind)


def _type_name(value: Column) -> Column:
    """The JSON schema's name for a value's type."""
    s = F.schema_of_variant(value)
    return (
        F.when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("null")
    )


def _problems(schema: Column, args: Column) -> Column:
    """What is wrong with a call's arguments: array<string>, sorted."""
    missing = F.transform(F.filter(F.map_entries(schema), lambda p: p["value"]["required"] & ~F.map_contains_key(args, p["key"])), lambda p: F.concat(F.lit("missing:"), p["key"]))
    unknown = F.transform(F.filter(F.map_keys(args), lambda k: ~F.map_contains_key(schema, k)), lambda k: F.concat(F.lit("unknown:"), k))

    def mistyped(a):
        want, is_ = F.element_at(schema, a["key"])["type"], _type_name(a["value"])
        return F.map_contains_key(schema, a["key"]) & (is_ != want) & ~((want == "number") & (is_ == "integer"))

    wrong = F.transform(F.filter(F.map_entries(args), mistyped), lambda a: F.concat(F.lit("type:"), a["key"]))
    return F.array_sort(F.concat(missing, unknown, wrong))


def _key(turn: Column, level: Column | int) -> Column:
    return F.struct(turn.cast("bigint").alias("turn"), (level if isinstance(level, Column) else F.lit(level)).cast("bigint").alias("level"))


def _later(key: Column, by: Column | int) -> Column:
    return _key(key["turn"], key["level"] + by)


def _order(ends: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """ends with order keys for each call and its result: (turn, level), a call after the results it needs, a result after its call.

    Keys start from the turns, and only conversations where that doesn't satisfy a need are looked at further. There, calls
    without open needs are peeled off round by round, each raising the keys of what needs it. A need of a call that itself
    has a single open need is replaced by that one, and what both demand of the key is put together: so chains get half as
    long each round, and rounds grow with their logarithm, not with the conversation. A round that peels nothing is the last
    one: what is left goes round in a circle, or needs what does, and keeps its own place.
    """
    ends = scratch.write(ends.withColumn("base", _key(F.coalesce(F.col("call_at.turn"), F.col("result_at.turn")), 0)))
    # A call's key is at least floor, and at least add levels after the key of the call it needs.
    first = ends.select("conv_id", F.col("call_id").alias("need"), F.col("base").alias("needed"), F.when(F.col("result_at").isNotNull(), _key(F.col("result_at.turn"), 1)).alias("floor"), F.when(F.col("result_at").isNotNull(), 2).otherwise(1).cast("bigint").alias("add"))
    edges = needs.join(first, ["conv_id", "need"]).join(ends.select("conv_id", "call_id", "base"), ["conv_id", "call_id"])
    edges = scratch.write(edges.withColumn("early", F.col("base") < F.greatest("floor", _later(F.col("needed"), F.col("add")))).drop("base", "needed"))
    astray = scratch.write(edges.where("early").select("conv_id").distinct())
    finals = None
    if not astray.isEmpty():
        nodes = scratch.write(ends.join(astray, "conv_id", "left_semi").select("conv_id", "call_id", F.col("base").alias("key")))
        waits = scratch.write(edges.join(astray, "conv_id", "left_semi").drop("early"))
        while True:
            waiting = waits.select("conv_id", "call_id").distinct()
            peeled = nodes.join(waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", F.col("call_id").alias("need"), F.col("key").alias("known"))
            step = scratch.write(waits.join(peeled, ["conv_id", "need"], "left"))
            if step.where("known is not null").isEmpty():
                finals = nodes.join(waiting.withColumn("circular", F.lit(True)), ["conv_id", "call_id"], "left")
                break
            raised = step.where("known is not null").groupBy("conv_id", "call_id").agg(F.max(F.greatest("floor", _later(F.col("known"), F.col("add")))).alias("raised"))
            nodes = scratch.write(nodes.join(raised, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("key", "raised").alias("key")))
            left = step.where("known is null").drop("known")
            single = left.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max(F.struct("need", "floor", "add")).alias("up")).where("n = 1")
            single = single.join(nodes, ["conv_id", "call_id"]).select("conv_id", F.col("call_id").alias("need"), "up", "key")
            jumped = left.join(single, ["conv_id", "need"], "left")
            past = F.col("up").isNotNull()
            floor = F.when(past, F.greatest("floor", _later(F.greatest("key", "up.floor"), F.col("add")))).otherwise(F.col("floor"))
            waits = jumped.select("conv_id", "call_id", F.coalesce("up.need", "need").alias("need"), floor.alias("floor"), (F.col("add") + F.coalesce("up.add", F.lit(0))).alias("add"))
            waits = scratch.write(waits.groupBy("conv_id", "call_id", "need").agg(F.max("floor").alias("floor"), F.max("add").alias("add")))
    if finals is None:
        keyed = ends.withColumn("circular", F.lit(False)).withColumn("call_key", F.col("base"))
    else:
        keyed = ends.join(finals, ["conv_id", "call_id"], "left").withColumn("circular", F.coalesce("circular", F.lit(False))).withColumn("call_key", F.coalesce("key", "base")).drop("key")
    result = F.when(F.col("result_at").isNotNull(), F.greatest(_key(F.col("result_at.turn"), 0), _later(F.col("call_key"), 1)))
    return keyed.withColumn("result_key", result).drop("base")


def link(messages: DataFrame, schemas: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per event: conv_id, turn, part, role, kind, call_id, name, linked_turn, status, problems, order_turn, order_level, json.

    schemas has a row (name, param, type, required) for each parameter of each tool, and one with a null param for a tool
    without parameters. Sorting a conversation by (order_turn, order_level, turn, part) gives an order in which calls precede
    their results and follow the results they refer to. json is canonical: sorted keys, no spaces.

    status of calls: ok, invalid (see problems), unknown_tool, duplicate (an earlier call has its id), unanswered, circular (it needs
    its own result, by way of others perhaps, or that of such a call; it keeps its place);
    of results: ok, orphan (no such call), duplicate; of both: malformed (no JSON object, or no id). Messages are ok. Null and
    empty texts are empty messages. Null conversations are never linked. Repeated rows repeat their events, of which the
    first is the one linked. Other columns are ignored; an empty table gives no rows.
    """
    e = events(messages, conv_col, turn_col, role_col, text_col)
    e = e.withColumn("call_id", F.when(F.col("kind") == "call", _get("id", "string")).when(F.col("kind") == "result", _get("call_id", "string")))
    e = e.withColumn("name", F.when(F.col("kind") == "call", _get("name", "string")))
    e = scratch.write(e)
    at = F.struct("turn", "part")
    named = e.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    # First calls and first results by identifier: at most one row each, so the hash join can't multiply rows.
    calls = named.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(at).alias("call_at"))
    results = named.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(at).alias("result_at"))
    ends = calls.hint("shuffle_hash").join(results, ["conv_id", "call_id"], "full")
    args = _get("arguments", "variant")
    needs = named.where("kind = 'call'").join(calls, ["conv_id", "call_id"]).where(at == F.col("call_at"))
    needs = needs.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all(F.to_json(args), F.lit(REFERENCE), F.lit(1)))).alias("need"))
    ends = _order(ends, needs, scratch)
    tools = schemas.groupBy("name").agg(F.map_from_entries(F.filter(F.collect_list(F.struct(F.col("param"), F.struct("type", "required"))), lambda p: p["param"].isNotNull())).alias("schema"))
    out = e.join(ends, ["conv_id", "call_id"], "left").join(tools, "name", "left")
    given = F.coalesce(_get("arguments", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    problems = F.when(is_call & F.col("schema").isNotNull(), _problems(F.col("schema"), given)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("problems", problems)
    status = (
        F.when(F.col("kind") == "message", "ok").when(F.col("call_id").isNull(), "malformed").when(F.col("conv_id").isNull(), "orphan")
        .when(is_call & (at != F.col("call_at")), "duplicate").when(is_result & F.col("call_at").isNull(), "orphan").when(is_result & (at != F.col("result_at")), "duplicate")
        .when(F.col("circular"), "circular").when(is_call & F.col("schema").isNull(), "unknown_tool").when(F.size("problems") > 0, "invalid")
        .when(is_call & F.col("result_at").isNull(), "unanswered").otherwise("ok")
    )
    own = F.when(is_call & (at == F.col("call_at")), F.col("call_key")).when(is_result & (at == F.col("result_at")) & F.col("call_at").isNotNull(), F.col("result_key"))
    own = F.when(~F.col("circular"), own)
    shown = (
        F.when(F.col("body").isNull(), F.to_json(F.struct(F.col("raw").alias("content"), F.col("role"))))
        .when(is_call, F.to_json(F.struct(args.alias("arguments"), F.col("call_id").alias("id"), "name", "role", F.lit("tool_call").alias("type"))))
        .otherwise(F.to_json(F.struct("call_id", _get("content", "variant").alias("content"), "role", F.lit("tool_result").alias("type"))))
    )
    return out.select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "name", F.when(is_call, F.col("result_at.turn")).when(is_result, F.col("call_at.turn")).alias("linked_turn"), status.alias("status"),
        F.concat_ws(",", "problems").alias("problems"), F.coalesce(own["turn"], F.col("turn")).alias("order_turn"), F.coalesce(own["level"], F.lit(0).cast("bigint")).alias("order_level"), shown.alias("json"),
    )


def as_tool_log(conversations: DataFrame) -> DataFrame:
    """Question-and-answer turns as a tool log that has all that a log can have, by rules on the length of a turn's text.

    A user turn calls ``reply`` under an id made of conversation and turn, an assistant turn is the result of the turn before
    it, other turns stay messages. Of a user turn of L characters the call

    * refers to the result of two turns before if 3 divides L, and of two turns later, which is out of order, if 5 does;
    * leaves out its prompt if L mod 7 is 1, gives n_chars as a string if it is 2, and has an argument too many if 11 divides L;
    * has the id of the turn two before if 17 divides L, and names an unknown tool if 19 does.

    Of an assistant turn the result has no id if 29 divides L, and is another one for the call three turns before if 31 does.
    """
    turn_id = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn, n = F.col("turn"), F.char_length(F.coalesce("text", F.lit("")))
    reference = lambda word, t: F.concat(F.lit(word + " ${"), turn_id(t), F.lit("}"))
    context = F.concat_ws(" ", F.when((n % 3 == 0) & (turn >= 2), reference("after", turn - 2)), F.when(n % 5 == 0, reference("before", turn + 2)))
    arguments = lambda n_chars: F.struct(F.when(n % 7 != 1, F.col("text")).alias("prompt"), n_chars.alias("n_chars"), F.nullif(context, F.lit("")).alias("context"), F.when(n % 11 == 0, "x").alias("note"))
    head = F.when((n % 17 == 0) & (turn >= 2), turn_id(turn - 2)).otherwise(turn_id(turn)).alias("id"), F.when(n % 19 == 0, "lookup").otherwise("reply").alias("name")
    written = lambda n_chars: F.to_json(F.struct(*head, arguments(n_chars).alias("arguments")))
    call = F.when(n % 7 == 2, written(n.cast("string"))).otherwise(written(n))
    of = F.when(n % 29 != 0, F.when((n % 31 == 0) & (turn >= 3), turn_id(turn - 3)).otherwise(turn_id(turn - 1)))
    result = F.to_json(F.struct(of.alias("call_id"), F.col("text").alias("content")))
    wrapped = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
    text = F.when(F.col("role") == "user", wrapped("tool_call", call)).when(F.col("role") == "assistant", wrapped("tool_result", result)).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def op6_tool_calls(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tool-calls")
    schemas = [("reply", "prompt", "string", True), ("reply", "n_chars", "integer", True), ("reply", "context", "string", False)]
    schemas = spark.createDataFrame(schemas, "name string, param string, type string, required boolean")
    out = link(as_tool_log(table(spark, sf_dir, "conversations")), schemas, scratch)
    return out.select("conv_id", "turn", F.col("part").cast("bigint").alias("part"), "role", "kind", "call_id", "name", "linked_turn", "status", "problems", "order_turn", "order_level", "json")


OP6_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn::BIGINT AS turn, role, text, length(coalesce(text, '')) AS n FROM conversations),
e AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
             CASE WHEN role = 'user' THEN conv_id || ':' || CASE WHEN n % 17 = 0 AND turn >= 2 THEN turn - 2 ELSE turn END
                  WHEN role = 'assistant' AND n % 29 <> 0 THEN conv_id || ':' || CASE WHEN n % 31 = 0 AND turn >= 3 THEN turn - 3 ELSE turn - 1 END END AS call_id,
             CASE WHEN role = 'user' THEN CASE WHEN n % 19 = 0 THEN 'lookup' ELSE 'reply' END END AS name,
             CASE WHEN role = 'user' AND n % 3 = 0 AND turn >= 2 THEN conv_id || ':' || (turn - 2) END AS needs_before,
             CASE WHEN role = 'user' AND n % 5 = 0 THEN conv_id || ':' || (turn + 2) END AS needs_later FROM u),
c AS (SELECT conv_id, call_id, min(turn) AS called FROM e WHERE kind = 'call' GROUP BY 1, 2),
r AS (SELECT conv_id, call_id, min(turn) AS answered FROM e WHERE kind = 'result' AND call_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT conv_id, call_id, called, answered, coalesce(called, answered) AS base FROM c FULL JOIN r USING (conv_id, call_id)),
n AS (SELECT e.conv_id, e.call_id AS b, need AS a FROM e JOIN c ON c.conv_id = e.conv_id AND c.call_id = e.call_id AND c.called = e.turn AND e.kind = 'call', unnest([needs_before, needs_later]) AS t(need)
      JOIN x ON x.conv_id = e.conv_id AND x.call_id = need),
reach AS (SELECT conv_id, a, b FROM n UNION SELECT reach.conv_id, reach.a, n.b FROM reach JOIN n ON n.conv_id = reach.conv_id AND n.a = reach.b),
circular AS (SELECT DISTINCT z.conv_id, z.b AS call_id FROM reach y JOIN reach z ON y.conv_id = z.conv_id AND y.a = y.b AND z.a = y.a),
walk AS (
  SELECT conv_id, call_id AS node, base AS t, 0::BIGINT AS l, [call_id] AS path FROM x
  UNION ALL
  SELECT w.conv_id, n.b, CASE WHEN xb.base > after_t THEN xb.base ELSE after_t END, CASE WHEN xb.base > after_t THEN 0 ELSE after_l END, list_append(path, n.b)
  FROM (SELECT walk.*, CASE WHEN answered > t THEN answered ELSE t END AS after_t, CASE WHEN answered IS NULL THEN l + 1 WHEN answered > t THEN 1 ELSE l + 2 END AS after_l FROM walk JOIN x ON x.conv_id = walk.conv_id AND x.call_id = walk.node) w
  JOIN n ON n.conv_id = w.conv_id AND n.a = w.node JOIN x xb ON xb.conv_id = n.conv_id AND xb.call_id = n.b WHERE NOT list_contains(path, n.b)),
k AS (SELECT conv_id, node AS call_id, max(t * 100000 + l) // 100000 AS t, max(t * 100000 + l) % 100000 AS l FROM walk GROUP BY 1, 2),
o AS (SELECT x.conv_id, x.call_id, called, answered, t, l, circular.call_id IS NOT NULL AS circular, CASE WHEN answered > t THEN answered ELSE t END AS rt, CASE WHEN answered > t THEN 0 ELSE l + 1 END AS rl
      FROM x JOIN k USING (conv_id, call_id) LEFT JOIN circular USING (conv_id, call_id)),
p AS (SELECT e.*, called, answered, t, l, rt, rl, circular,
             CASE WHEN kind = 'call' THEN nullif(concat_ws(' ', 'after ${' || needs_before || '}', 'before ${' || needs_later || '}'), '') END AS context,
             CASE WHEN kind = 'call' AND name = 'reply' THEN concat_ws(',', CASE WHEN n % 7 = 1 THEN 'missing:prompt' END, CASE WHEN n % 7 = 2 THEN 'type:n_chars' END, CASE WHEN n % 11 = 0 THEN 'unknown:note' END) ELSE '' END AS problems
      FROM e LEFT JOIN o ON o.conv_id = e.conv_id AND o.call_id = e.call_id)
SELECT conv_id, turn, 0::BIGINT AS part, role, kind, call_id, name, CASE kind WHEN 'call' THEN answered WHEN 'result' THEN called END AS linked_turn,
       CASE WHEN kind = 'message' THEN 'ok' WHEN call_id IS NULL THEN 'malformed' WHEN kind = 'call' AND turn <> called THEN 'duplicate' WHEN kind = 'result' AND called IS NULL THEN 'orphan'
            WHEN kind = 'result' AND turn <> answered THEN 'duplicate' WHEN circular THEN 'circular' WHEN name = 'lookup' THEN 'unknown_tool' WHEN problems <> '' THEN 'invalid'
            WHEN kind = 'call' AND answered IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       problems,
       CASE WHEN circular THEN turn WHEN kind = 'call' AND turn = called THEN t WHEN kind = 'result' AND turn = answered AND called IS NOT NULL THEN rt ELSE turn END AS order_turn,
       CASE WHEN circular THEN 0 WHEN kind = 'call' AND turn = called THEN l WHEN kind = 'result' AND turn = answered AND called IS NOT NULL THEN rl ELSE 0 END::BIGINT AS order_level,
       CASE kind WHEN 'message' THEN '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(role) || '}'
                 WHEN 'call' THEN '{"arguments":{' || concat_ws(',', '"context":' || to_json(context), '"n_chars":' || CASE WHEN n % 7 = 2 THEN '"' || n || '"' ELSE n::VARCHAR END, CASE WHEN n % 11 = 0 THEN '"note":"x"' END, CASE WHEN n % 7 <> 1 THEN '"prompt":' || to_json(text) END)
                      || '},"id":' || to_json(call_id) || ',"name":' || to_json(name) || ',"role":' || to_json(role) || ',"type":"tool_call"}'
                 ELSE '{' || concat_ws(',', '"call_id":' || to_json(call_id), '"content":' || to_json(text), '"role":' || to_json(role)) || ',"type":"tool_result"}' END AS json
FROM p
"""
