"""Chat formatting: tool calls and their results, linked, ordered, validated and written as canonical JSON.

DataFrame and SQL functions only. Calls and results meet in a hash join by conversation and call id. A call comes after all calls
that its `after` names: its level is the longest way to a call without such, found level by level. Arguments are checked against the
fields of the tool's schema. JSON has sorted keys, no blanks and no nulls.

Null call ids link with nothing. Of several results for a call the one of the smallest turn counts (ties: smallest content); of
repeated calls each gets it. Calls in a cycle have no level. Names in `after` that no call of the conversation has are ignored. Null
texts leave no content. Arguments that are null, no JSON or no object are invalid, as are unknown tools. Further columns don't matter.
Rounds grow with the longest chain of calls, not with the number of conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.common import cut_lineage

KEY = ["conv_id", "call_id"]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with result_turn and result (null without one), which take the place of columns of these names."""
    first = results.where(F.col("call_id").isNotNull()).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("_r"))
    first = first.select(*KEY, F.col("_r.turn").alias("result_turn"), F.col("_r.content").alias("result"))
    return calls.drop("result_turn", "result").join(first, KEY, "left")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): level 0 needs no other call; null in a cycle."""
    ids = cut_lineage(calls.where(F.col("call_id").isNotNull()).select(*KEY).distinct())
    needs = calls.where(F.col("call_id").isNotNull()).select(*KEY, F.explode("after").alias("dep")).distinct()
    there = ids.select("conv_id", F.col("call_id").alias("dep"))
    open_ = cut_lineage(needs.join(there, ["conv_id", "dep"], "left_semi"))
    ready = ids.join(open_.select(*KEY), KEY, "left_anti")
    done, level = None, 0
    while True:
        ready = cut_lineage(ready.withColumn("level", F.lit(level)))
        done = ready if done is None else done.unionAll(ready)
        if open_.isEmpty() or ready.isEmpty():
            break
        rest = cut_lineage(open_.join(ready.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti"))
        ready = open_.select(*KEY).distinct().join(rest.select(*KEY), KEY, "left_anti")
        open_, level = rest, level + 1
    return ids.join(done, KEY, "left")


def errors(arguments: Column, fields: Column) -> Column:
    """Sorted complaints about JSON arguments; fields: array of (field, type, required), null for an unknown tool.

    Types: string, integer, number, boolean, array, object.
    """
    given = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    name = lambda v: F.schema_of_variant(v)
    kind = lambda v: (
        F.when(name(v) == "STRING", "string").when(name(v) == "BIGINT", "integer").when(name(v) == "BOOLEAN", "boolean")
        .when(name(v).startswith("ARRAY"), "array").when(name(v).startswith("OBJECT"), "object").when(name(v) == "VOID", "null").otherwise("number")
    )
    value = lambda f: F.try_element_at(given, f["field"])
    fits = lambda f: (kind(value(f)) == f["type"]) | ((f["type"] == "number") & (kind(value(f)) == "integer"))
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.array_contains(F.map_keys(given), f["field"])), lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.transform(F.filter(fields, lambda f: F.array_contains(F.map_keys(given), f["field"]) & ~fits(f)), lambda f: F.concat(F.lit("type "), f["field"]))
    known = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.filter(F.map_keys(given), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown "), k))
    found = F.array_sort(F.concat(missing, wrong, extra))
    return F.when(fields.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("no object"))).otherwise(found)


def as_json(text: str) -> Column:
    """A string column as a JSON string."""
    return F.expr(f"substring(to_json(struct({text} AS x)), 6, length(to_json(struct({text} AS x))) - 6)")


#: JSON strings, or what stands between them
_TOKEN = r'"(?:[^"\\]|\\.)*+"|[^"]+'
#: numbers so long that a parsed one might be rounded, and the mark under which they go through the parser as strings
_LONG_NUMBER, _MARK = r"(-?[0-9][0-9.eE+-]{14,})", "\\u0001number "


def canonical(arguments: str) -> Column:
    """The JSON text of a string column with sorted keys and no blanks; text that is no JSON becomes a JSON string.

    Numbers of 16 and more characters keep their text. (Not in arguments that hold the character U+0001, escaped, which marks them.)
    """
    text = F.col(arguments)
    marked = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, _LONG_NUMBER, f'"{_MARK}$1"'.replace("\\", "\\\\"))))
    parsed = F.when(text.rlike(_LONG_NUMBER) & ~F.lower(text).contains("\\u0001"), F.try_parse_json(F.array_join(marked, ""))).otherwise(F.try_parse_json(text))
    whole = F.when(F.try_parse_json(text).isNotNull(), F.regexp_replace(F.to_json(parsed), r'"\\u0001number ([^"]*)"', "$1"))
    return F.coalesce(whole, as_json(arguments))


def tools(schemas: DataFrame) -> DataFrame:
    """schemas (name, field, type, required) as one row for each tool; a tool's fields are few by nature."""
    return schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))


def format_messages(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, role, call_id, level, result_turn, errors, valid, json: one row for each message and call of it.

    messages (conv_id, turn, role, text); calls (conv_id, call_id, turn, name, arguments, after); results (conv_id, call_id, turn,
    content). A message with neither call nor result is written alone. Within a conversation, (level, turn) is a topological order.
    """
    calls, results = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"), results.select("conv_id", "call_id", "turn", "content")
    linked = link(calls, results).join(levels(calls), KEY, "left").join(tools(schemas), "name", "left")
    ready = linked.select("conv_id", "turn", "call_id", "name", "arguments", "level", "result_turn", errors(F.col("arguments"), F.col("fields")).alias("errors"))
    answers = results.select("conv_id", "turn", F.col("call_id").alias("answers")).where(F.col("answers").isNotNull()).distinct()
    known = answers.join(calls.select("conv_id", F.col("call_id").alias("answers")).distinct(), ["conv_id", "answers"], "left_semi")
    met = messages.select("conv_id", "turn", "role", "text").join(ready, ["conv_id", "turn"], "left").join(known, ["conv_id", "turn"], "left")
    parts = F.array_compact(F.array(
        F.when(F.col("answers").isNotNull(), F.concat(F.lit('"answers":'), as_json("answers"))),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"call":{"arguments":'), F.coalesce(canonical("arguments"), F.lit("{}")), F.lit(',"id":'), as_json("call_id"), F.lit(',"name":'), F.coalesce(as_json("name"), F.lit('""')), F.lit("}"))),
        F.when(F.col("text").isNotNull(), F.concat(F.lit('"content":'), as_json("text"))),
        F.when(F.col("role").isNotNull(), F.concat(F.lit('"role":'), as_json("role"))),
    ))
    json = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    valid = F.when(F.col("call_id").isNotNull(), F.size("errors") == 0)
    return met.select("conv_id", "turn", "role", "call_id", "level", "result_turn", F.array_join("errors", ",").alias("errors"), valid.alias("valid"), json.alias("json"))
