"""Chat formatting: tool calls linked to their results, in DataFrame operations only.

Calls and results meet in a shuffled hash join on the call's identifier. A call may name the calls that it follows; its
place in the topological order is the length of the longest way to it from a call that follows none. Where each call
follows one at most this takes pointer doubling, so a chain of n calls takes about log2(n) joins; else a round takes away
the calls that nothing left precedes. Arguments are checked against the tool's schema, nested objects too, and calls are
written as canonical JSON.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: For each tool its fields: JSON type (string, integer, number, boolean, array, object) and whether it is required. Fields
#: of an object may stand in the type's place, and so may a list of the texts or numbers allowed.
Fields = dict[str, tuple["str | list | Fields", bool]]
Schemas = dict[str, Fields]
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "summarize": {"text": ("string", True), "max_words": ("integer", True), "style": ("string", False)},
    "translate": {"text": ("string", True), "target": ("string", True)},
}
_TYPES = {"string": "^STRING", "integer": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def depths(calls: DataFrame) -> DataFrame:
    """id and depth (0: follows no known call; null: on or behind a cycle) for calls with unique id, and parent.

    parent: the id of the call before, or an array of several ids; those that aren't known, and nulls, count for nothing.
    """
    if dict(calls.dtypes)["parent"].startswith("array"):
        known = calls.select(F.col("id").alias("_id"))
        ways = calls.select("id", F.explode("parent").alias("parent")).distinct().join(known, F.col("parent") == F.col("_id"), "left_semi")
        ways = written(ways, "calls-ways")
        if ways.groupBy("id").count().filter("count > 1").isEmpty():
            calls = calls.select("id").join(ways.withColumnRenamed("id", "_child"), F.col("id") == F.col("_child"), "left").select("id", "parent")
        else:
            return _levels(calls.select("id"), ways)
    n = calls.count()
    known = calls.select(F.col("id").alias("_id"))
    state = calls.join(known, calls["parent"] == known["_id"], "left").select("id", F.col("_id").alias("up"), F.when(F.col("_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = written(state, "calls-depth")
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        if state.filter("up is not null").isEmpty():
            break
        over = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = written(state.join(over, state["up"] == over["_id"], "left").select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "calls-depth")
    return state.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _levels(left: DataFrame, ways: DataFrame) -> DataFrame:
    """id, depth of a graph (ways: id, parent): in round k the ids with no way left to them have depth k; null if never."""
    done, k = None, 0
    while True:
        ready = written(left.join(ways.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_anti"), "calls-ready")
        if ready.isEmpty():
            break
        level = ready.withColumn("depth", F.lit(k).cast("long"))
        done = level if done is None else done.unionByName(level)
        gone = ready.select(F.col("id").alias("_id"))
        left = written(left.join(gone, F.col("id") == F.col("_id"), "left_anti"), "calls-left")
        ways = written(ways.join(gone, F.col("parent") == F.col("_id"), "left_anti"), "calls-ways")
        k += 1
    circling = left.select("id", F.lit(None).cast("long").alias("depth"))
    return circling if done is None else done.unionByName(circling)


def _wrong(text: Column, fields: Fields, path: str = "") -> Column:
    """Array of what is wrong with an object, given as JSON text, in what isn't an array of texts null."""
    keys = F.json_object_keys(text)
    checks, deeper = [], []
    for field, (kind, required) in fields.items():
        there, name = F.array_contains(keys, field), path + field
        value = F.try_variant_get(F.try_parse_json(text), f"$['{field}']", "variant")
        type_ = F.schema_of_variant(value)
        if isinstance(kind, dict):
            fits = type_.rlike(_TYPES["object"])
            deeper.append(F.when(there & F.coalesce(fits, F.lit(False)), _wrong(F.to_json(value), kind, name + ".")).otherwise(F.array().cast("array<string>")))
        elif isinstance(kind, list):
            fits = F.try_variant_get(value, "$", "string").isin([str(x) for x in kind]) & type_.rlike(_TYPES["string" if isinstance(kind[0], str) else "number"])
        else:
            fits = type_.rlike(_TYPES[kind])
            if kind == "integer":  # by value: 1.0 and 1e2 are integers
                number = F.try_variant_get(value, "$", "double")
                fits &= F.coalesce(number == F.floor(number), F.lit(False)) | type_.rlike("^BIGINT")
        checks.append(F.when(~there, F.lit(f"missing:{name}") if required else F.lit(None)).when(~F.coalesce(fits, F.lit(False)), f"type:{name}"))
    more = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>")), lambda k: F.concat(F.lit(f"unknown:{path}"), k))
    return F.concat(F.array_compact(F.array(*checks)).cast("array<string>"), more, *deeper)


def errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong: unknown_tool, invalid_json, missing:field, type:field, unknown:field (a.b if nested).

    A value that isn't among those allowed counts as one of another type.
    """
    json = F.try_parse_json(arguments)
    out = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("unknown_tool")))
    out = out.when(json.isNull() | F.json_object_keys(arguments).isNull(), F.array(F.lit("invalid_json")))
    for tool, fields in schemas.items():
        out = out.when(name == tool, F.array_sort(_wrong(arguments, fields)))
    return out


def canonical(text: Column) -> Column:
    """JSON text with sorted keys, without white space, and whole numbers without a fraction; null for what isn't JSON.

    Equal numbers from 0.001 to 10,000,000 have one form (1, 1.0 and 1e0 are 1); others keep an exponent they are written with."""
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?[0-9]+)\.0(?![0-9Ee])', "$1$2")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas = SCHEMAS) -> DataFrame:
    """One row per call id and per result id without a call: id, conv_id, turn, depth, errors, n_results, status, json.

    calls: id, parent, conv_id, turn, name, arguments (JSON text). results: id, turn, content. Of calls with one id the
    first by (conv_id, turn, name, arguments, parent) counts, of results the first by (turn, content). A result without
    its call has status orphan, a call on or behind a cycle cycle, else invalid, unanswered or linked; only what isn't an
    orphan has JSON. parent may be an array of ids. Sorting by (depth, turn, id) gives a topological order. Rows with a null id are left out, as nothing
    can refer to them. Empty tables give no rows.
    """
    fields = ["conv_id", "turn", "name", "arguments", "parent"]
    first = calls.filter("id is not null").groupBy("id").agg(F.min(F.struct(*fields)).alias("c")).select("id", *[F.col(f"c.{f}").alias(f) for f in fields])
    first = written(first, "calls-first")
    answers = results.filter("id is not null").groupBy(F.col("id").alias("rid")).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    placed = first.join(depths(first.select("id", "parent")).withColumnRenamed("id", "_id").hint("shuffle_hash"), F.col("id") == F.col("_id"))
    both = placed.join(answers.hint("shuffle_hash"), F.col("id") == F.col("rid"), "full_outer")
    wrong = errors(F.col("name"), F.col("arguments"), schemas)
    both = both.withColumn("errors", F.when(F.col("id").isNotNull(), wrong))
    status = (
        F.when(F.col("id").isNull(), "orphan").when(F.col("depth").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("rid").isNull(), "unanswered").otherwise("linked")
    )
    # keys in alphabetical order; parsed arguments come out with sorted keys and without white space
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.array("arguments")))
    line = F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.expr("substring(to_json(named_struct('depth', depth, 'id', id, 'name', name, 'parent', parent, 'result', r.content, 'status', status)), 2)"))
    return both.withColumn("status", status).select(
        F.coalesce("id", "rid").alias("id"), "conv_id", F.coalesce("turn", "r.turn").alias("turn"), "depth", F.array_join("errors", ",").alias("errors"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "status", F.when(F.col("id").isNotNull(), line).alias("json"),
    )


def calls_of(conversations: DataFrame) -> DataFrame:
    """A tool call for each user turn: the tool by the text's length, and some arguments that break its schema."""
    size = F.length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(F.lit("search"), F.lit("summarize"), F.lit("translate")), (size % 3 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    search = F.to_json(F.struct(text.alias("query"), F.col("turn").alias("limit")))
    words = F.when(size % 5 == 0, F.to_json(F.struct(text.alias("text"), size.cast("string").alias("max_words")))).otherwise(F.to_json(F.struct(text.alias("text"), size.alias("max_words"))))
    target = F.when(size % 7 == 0, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(text.alias("text"), F.lit("en").alias("target"))))
    call = lambda turn: F.concat_ws("-", "conv_id", turn)
    return conversations.filter("role = 'user'").select(
        call(F.col("turn")).alias("id"), F.when(F.col("turn") >= 2, call(F.col("turn") - 2)).alias("parent"), "conv_id", "turn", name.alias("name"),
        F.when(name == "search", search).when(name == "summarize", words).otherwise(target).alias("arguments"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """A result for each assistant turn, of the call one turn earlier."""
    return conversations.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("id"), "turn", F.col("text").alias("content"))


ORACLE = """
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn >= 2 THEN conv_id || '-' || (turn - 2) END AS parent, conv_id, turn, ['search', 'summarize', 'translate'][n % 3 + 1] AS name, t, n FROM u),
b AS (SELECT *, CASE name WHEN 'search' THEN json_object('limit', turn, 'query', t)
        WHEN 'summarize' THEN CASE WHEN n % 5 = 0 THEN json_object('max_words', n::VARCHAR, 'text', t) ELSE json_object('max_words', n, 'text', t) END
        ELSE CASE WHEN n % 7 = 0 THEN json_object('text', t) ELSE json_object('target', 'en', 'text', t) END END AS arguments,
      CASE WHEN name = 'summarize' AND n % 5 = 0 THEN 'type:max_words' WHEN name = 'translate' AND n % 7 = 0 THEN 'missing:target' ELSE '' END AS errors FROM a),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn, name, arguments, parent) AS k FROM b) WHERE k = 1),
r AS (SELECT conv_id || '-' || (turn - 1) AS rid, min(turn) AS rturn, arg_min(text, {'a': turn, 'b': text}) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY 1),
d AS (SELECT id, 0::BIGINT AS depth FROM c WHERE parent IS NULL OR parent NOT IN (SELECT id FROM c)
      UNION ALL SELECT c.id, d.depth + 1 FROM c JOIN d ON c.parent = d.id),
e AS (SELECT c.*, d.depth, r.*, CASE WHEN c.id IS NULL THEN 'orphan' WHEN c.errors <> '' THEN 'invalid' WHEN rid IS NULL THEN 'unanswered' ELSE 'linked' END AS status
      FROM c JOIN d USING (id) FULL JOIN r ON c.id = r.rid)
SELECT coalesce(id, rid) AS id, conv_id, coalesce(turn, rturn) AS turn, depth, errors, coalesce(n_results, 0) AS n_results, status,
  CASE WHEN id IS NOT NULL THEN '{"arguments":' || arguments::VARCHAR || ',"depth":' || depth || ',"id":"' || id || '","name":"' || name || '"'
    || CASE WHEN parent IS NULL THEN '' ELSE ',"parent":"' || parent || '"' END || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || ',"status":"' || status || '"}' END AS json
FROM e
"""
