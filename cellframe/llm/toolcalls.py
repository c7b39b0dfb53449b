"""Tool calls of conversations, linked to their results, ordered, validated and serialised, in DataFrame functions only.

Calls are rows (conv_id, call_id, name, arguments, waits_for, turn) and results rows (conv_id, call_id, content, turn).
``waits_for`` names the call of the same conversation whose result the call needs, or is null.

* Linking: a hash join of calls and results on (conv_id, call_id). A call without result is ``unanswered``, a result
  without call an ``orphan``; of several results of a call the one of the first turn (then the least content) is linked
  and the others are ``repeated``. Of several calls with one identifier the first counts, the others are ``repeated``.
* Order: depth is the number of calls that a call waits for, one after the other. Pointers are doubled in every round
  (a call's distance to the call it points at, then that call's own pointer), so a chain of n calls takes about log2 n
  rounds and no conversation is gathered in one task. A call that waits for itself in a circle, or for an unknown
  call, has no depth: ``circular`` or ``dangling``. (depth, turn, call_id) is an order in which every call follows
  what it waits for; a result has its call's depth.
* Validation: arguments are parsed as JSON and checked against the tool's fields (name, field, kind, required):
  ``unknown tool``, ``not an object``, then ``missing f``, ``unknown f`` and ``kind of f`` in order of the fields.
* Canonical JSON: keys sorted, no white space, one line for each call or result.

Nulls: a null call_id can't be linked; such a call is ``unnamed``, such a result an ``orphan``. Null arguments are not
an object, null content is serialised as null. Columns beside these are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.session import cut

#: Fields of the tools that the query on conversations uses: tool, field, kind, required.
TOOLS = (("answer", "limit", "integer", True), ("answer", "question", "string", True), ("answer", "strict", "boolean", False), ("lookup", "language", "string", False), ("lookup", "words", "integer", True))
ROLES = ("user", "assistant", "system")
#: The names that schema_of_variant gives to the kinds.
KINDS = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def json_text(c: Column) -> Column:
    """A string as JSON, null as null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth and fault (circular, dangling or null) of calls with distinct (conv_id, call_id)."""
    nodes = calls.select("conv_id", "call_id", F.col("waits_for").alias("to"))
    known = nodes.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("found"))
    # far: steps to the call that ``to`` names; a call that waits for nothing points nowhere
    state = nodes.join(known, ["conv_id", "to"], "left").select(
        "conv_id", "call_id", F.when(F.col("found"), F.col("to")).alias("to"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("far"), (F.col("to").isNotNull() & F.col("found").isNull()).alias("lost")
    )
    state = cut(state)
    longest = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length())):
        if state.where(F.col("to").isNotNull()).isEmpty():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("lost").alias("ahead_lost"))
        state = cut(state.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("next").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), (F.col("lost") | F.coalesce("ahead_lost", F.lit(False))).alias("lost")))
    fault = F.when(F.col("to").isNotNull(), "circular").when(F.col("lost"), "dangling")
    return state.select("conv_id", "call_id", F.when(fault.isNull(), F.col("far")).alias("depth"), fault.alias("fault"))


def problems(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """The calls with ``problems``, an array of what is wrong with their arguments, and ``canonical`` arguments."""
    value = F.try_parse_json(F.col("arguments"))
    is_object = F.schema_of_variant(F.col("value")).startswith("OBJECT")
    parsed = calls.withColumn("value", value).withColumn("fields", F.when(F.col("value").isNotNull() & is_object, F.sort_array(F.map_keys(F.from_json(F.col("arguments"), "map<string,string>")))))
    # a tool's fields are configuration, bounded and joined as one array
    shapes = tools.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("field", "kind", "required"))).alias("shape"))
    checked = parsed.join(shapes, parsed["name"] == shapes["tool"], "left")
    path = lambda f: F.concat(F.lit("$['"), f, F.lit("']"))
    kind_of = lambda f: F.schema_of_variant(F.variant_get(F.col("value"), path(f), "variant"))
    fits = lambda x: F.coalesce(*[F.when((x["kind"] == k) & F.array_contains(F.array(*[F.lit(n) for n in names]), F.regexp_extract(kind_of(x["field"]), "^[A-Z]+", 0)), F.lit(True)) for k, names in KINDS.items()], F.lit(False))
    present = lambda x: F.array_contains("fields", x["field"])
    missing = F.transform(F.filter("shape", lambda x: x["required"] & ~present(x)), lambda x: F.concat(F.lit("missing "), x["field"]))
    unknown = F.transform(F.array_except("fields", F.transform("shape", lambda x: x["field"])), lambda f: F.concat(F.lit("unknown "), f))
    wrong = F.transform(F.filter("shape", lambda x: present(x) & ~fits(x)), lambda x: F.concat(F.lit("kind of "), x["field"]))
    found = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("fields").isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(missing, unknown, wrong))
    return checked.select(*[parsed[c] for c in calls.columns], found.alias("problems"), F.when(F.col("value").isNotNull(), F.to_json("value")).otherwise("null").alias("canonical"))


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for every call and result: conv_id, kind, call_id, turn, depth, status and json."""
    calls = calls.select("conv_id", "call_id", "name", "arguments", "waits_for", "turn")
    results = results.select("conv_id", "call_id", "content", "turn")
    named = problems(calls, tools).withColumn("row", F.struct("turn", "name", "canonical", "waits_for", "problems"))
    # equal rows of one identifier: the least is linked, the others are numbered by how many they are
    counted = cut(named.groupBy("conv_id", "call_id", "row").agg(F.count("*").alias("times")))
    least = counted.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("row").alias("least"))
    first = least.select("conv_id", "call_id", "least.*")
    order = depths(first)
    replies = results.withColumn("row", F.struct("turn", "content")).groupBy("conv_id", "call_id", "row").agg(F.count("*").alias("times"))
    reply = replies.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("row").alias("reply"))
    of_call = cut(least.join(order, ["conv_id", "call_id"]).join(reply, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "least", "depth", "fault", "reply"))

    status = (
        F.when(F.col("call_id").isNull(), "unnamed").when(~F.col("is_first"), "repeated").when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.size("row.problems") > 0, F.concat(F.lit("invalid: "), F.array_join("row.problems", ", "))).when(F.col("reply").isNull(), "unanswered").otherwise("ok")
    )
    text = F.concat(
        F.lit('{"arguments":'), F.col("row.canonical"), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("row.name")), F.lit(',"type":"tool_call","waits_for":'), json_text(F.col("row.waits_for")), F.lit("}")
    )
    copies = F.explode(F.expr("sequence(1, times)")).alias("copy")
    sent = counted.select("*", copies).join(of_call, ["conv_id", "call_id"], "left").withColumn("is_first", (F.col("row") == F.col("least")) & (F.col("copy") == 1))
    sent = sent.select("conv_id", F.lit("call").alias("kind"), "call_id", F.col("row.turn").alias("turn"), F.when(F.col("is_first"), F.col("depth")).alias("depth"), status.alias("status"), text.alias("json"))
    state = F.when(F.col("least").isNull(), "orphan").when((F.col("row") == F.col("reply")) & (F.col("copy") == 1), "ok").otherwise("repeated")
    given = replies.select("*", copies).join(of_call, ["conv_id", "call_id"], "left")
    reply_text = F.concat(F.lit('{"content":'), json_text(F.col("row.content")), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"type":"tool_result"}'))
    given = given.select("conv_id", F.lit("result").alias("kind"), "call_id", F.col("row.turn").alias("turn"), F.when(state == "ok", F.col("depth")).alias("depth"), state.alias("status"), reply_text.alias("json"))
    return sent.unionByName(given)


def other_turns(rows: DataFrame) -> DataFrame:
    """A row like those of :func:`linked` for every turn whose role is null or none of ROLES: kind ``turn``, status ``unknown role``."""
    other = rows.where(F.col("role").isNull() | ~F.col("role").isin(*ROLES))
    text = F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(',"role":'), json_text(F.col("role")), F.lit(',"type":"turn"}'))
    return other.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit("turn").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"),
        F.lit(None).cast("long").alias("depth"), F.lit("unknown role").alias("status"), text.alias("json"))


def from_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for the turns of plain conversations.

    A user's turn is a call of ``answer`` with the turn's text as the question, an assistant's turn its result; a
    system turn is a call of ``lookup`` without a result. A call waits for the user's turn two before it. So that every
    check has work, the turn and conversation numbers leave out, mistype or misname some fields. Turns of other roles are
    neither; :func:`other_turns` has them.
    """
    t, c, text = F.col("turn").cast("long"), F.col("conv_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = rows.where(F.col("role").isin(*ROLES)).select(c.alias("conv_id"), t.alias("turn"), "role", text.alias("text"))
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    limit = F.when(F.col("conv_id") % 7 == 0, F.lit("")).when(F.col("conv_id") % 11 == 0, F.lit('"limit": "ten", ')).otherwise(F.concat(F.lit('"limit": '), (F.col("turn") * 10).cast("string"), F.lit(", ")))
    strict = F.when(F.col("conv_id") % 13 == 0, F.lit(', "extra": [1, {"b": 2, "a": null}]')).when(F.col("conv_id") % 2 == 0, F.lit(', "strict": true')).otherwise(F.lit(""))
    ask = F.concat(F.lit("{ "), limit, F.lit('"question": '), json_text(F.col("text")), strict, F.lit(" }"))
    look = F.concat(F.lit('{"words": '), F.length("text").cast("string"), F.lit(', "language": "x"'), F.when(F.col("conv_id") % 17 == 0, F.lit(",,")).otherwise(F.lit("")), F.lit("}"))
    user, system = F.col("role") == "user", F.col("role") == "system"
    calls = rows.where(user | system).select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.when(F.col("conv_id") % 19 == 0, "search").when(user, "answer").otherwise("lookup").alias("name"), F.when(user, ask).otherwise(look).alias("arguments"),
        F.when(user & (F.col("turn") >= 2), name(F.col("turn") - 2)).alias("waits_for"), "turn",
    )
    results = rows.where(F.col("role") == "assistant").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), "turn")
    return calls, results


def tool_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TOOLS), "tool string, field string, kind string, required boolean")


#: The query's rows in DuckDB's SQL ((conv_id, turn) distinct, as in the given table).
ORACLE_SQL = """
with recursive r as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations where role in ('user', 'assistant', 'system')),
calls as (
  select *, case when conv_id % 19 = 0 then 'search' when role = 'user' then 'answer' else 'lookup' end as name,
    case when role = 'user' and turn >= 2 then turn - 2 end as waits,
    not (role = 'system' and conv_id % 17 = 0) as parses from r where role <> 'assistant'),
chain as (
  select conv_id, turn, 0::bigint as depth from calls where waits is null
  union all select c.conv_id, c.turn, p.depth + 1 from calls c join chain p on c.conv_id = p.conv_id and c.waits = p.turn),
args as (
  select c.*, chain.depth,
    case when not parses then 'null'
      when role = 'user' then '{' || case when conv_id % 13 = 0 then '"extra":[1,{"a":null,"b":2}],' else '' end
        || case when conv_id % 7 = 0 then '' when conv_id % 11 = 0 then '"limit":"ten",' else '"limit":' || (turn * 10) || ',' end
        || '"question":' || to_json(text) || case when conv_id % 13 <> 0 and conv_id % 2 = 0 then ',"strict":true' else '' end || '}'
      else '{"language":"x","words":' || length(text) || '}' end as canonical,
    case when name = 'search' then 'unknown tool' when not parses then 'not an object'
      when role = 'system' then ''
      else concat_ws(', ', case when conv_id % 7 = 0 then 'missing limit' end, case when conv_id % 13 = 0 then 'unknown extra' end,
        case when conv_id % 7 <> 0 and conv_id % 11 = 0 then 'kind of limit' end) end as problems
  from calls c left join chain using (conv_id, turn))
select a.conv_id, 'call' as kind, 'c' || a.turn as call_id, a.turn, a.depth,
  case when a.depth is null then 'dangling' when problems <> '' then 'invalid: ' || problems when s.turn is null then 'unanswered' else 'ok' end as status,
  '{"arguments":' || canonical || ',"id":"c' || a.turn || '","name":"' || name || '","type":"tool_call","waits_for":' || coalesce('"c' || waits || '"', 'null') || '}' as json
from args a left join r s on s.conv_id = a.conv_id and s.turn = a.turn + 1 and s.role = 'assistant'
union all
select s.conv_id, 'result', 'c' || (s.turn - 1), s.turn, a.depth, case when a.turn is null then 'orphan' else 'ok' end,
  '{"content":' || to_json(s.text) || ',"id":"c' || (s.turn - 1) || '","type":"tool_result"}'
from r s left join args a on a.conv_id = s.conv_id and a.turn = s.turn - 1 where s.role = 'assistant'
union all
select conv_id, 'turn', null, turn, null, 'unknown role', '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || ',"type":"turn"}'
from conversations where role is null or role not in ('user', 'assistant', 'system')
"""
