"""Tool calls of conversations: linked to their results, ordered, validated, serialised."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, read, written

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict}


def _is(value, kind: str) -> bool:
    if kind == "null":
        return value is None
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, ()))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of value breaks schema: type, enum, minimum, maximum, maxLength, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: above maximum")
    if isinstance(value, str) and len(value) > schema.get("maxLength", math.inf):
        out.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        out += [x for k in sorted(known) if k in value for x in violations(value[k], known[k], f"{at}.{k}")]
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and text as it is; where text holds half a surrogate pair, all of it is escaped."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if not out.isascii() and any("\ud800" <= c <= "\udfff" for c in out):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed_json(text: str | None):
    """The value of a JSON text; ValueError for anything else: NaN, infinities, numbers or nesting beyond what can be read."""
    try:
        return json.loads(text or "", parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def levels(nodes: DataFrame) -> DataFrame:
    """conv_id, call_id, level: how many parents stand above each call; null on or behind a cycle.

    nodes: conv_id, call_id, parent_id, without repeats or nulls in the first two.
    Parents that are not there count as none. Pointers double in each round, so a
    chain of n calls takes log2(n) joins, and no conversation meets in a task.
    """
    ids = nodes.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    now = written(nodes.join(ids, ["conv_id", "parent_id"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up")).select("*", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")))
    most = now.count()
    for _ in range(max(1, most).bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        after = written(now.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        discard(now)
        now = after
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call with its result, its place in the order, what is wrong with it, and its canonical JSON.

    calls: conv_id, call_id, parent_id, name, arguments (JSON text); results:
    conv_id, call_id, content; schemas: name, schema (JSON text). Returns conv_id,
    call_id, level, n_results, errors array<string>, json.

    level orders a conversation: a call stands after the one whose result it
    takes (parent_id). It is null, with an error, on or behind a cycle, and for
    calls without an id or with an id that the conversation has twice. Of several
    results the smallest content is taken and an error noted; so for none.
    Arguments that are no JSON stay text in json. Results without a call are left out.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "parent_id", "name", "arguments")
    count = calls.where("call_id is not null and conv_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n_same"), F.min("parent_id").alias("parent_id"))
    level = levels(count.where("n_same = 1").select(*key, "parent_id"))
    found = results.where("call_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("result"))
    tools = schemas.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema"))
    rows = calls.drop("parent_id").join(count.select(*key, "n_same"), key, "left").join(level, key, "left").join(found, key, "left").join(tools, "name", "left").select(*key, "level", "n_same", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "name", "arguments", "result", "schema")
    conv, call = rows.schema["conv_id"].dataType.simpleString(), rows.schema["call_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                errors = []
                if r["call_id"] is None:
                    errors.append("no id")
                elif (r["n_same"] or 0) > 1:
                    errors.append("id is not unique")
                elif r["level"] is None:
                    errors.append("cycle")
                if r["n_results"] != 1:
                    errors.append("no result" if not r["n_results"] else "several results")
                try:
                    arguments = parsed_json(r["arguments"])
                    canonical(arguments)  # what is nested too deeply for that stays text
                except (ValueError, RecursionError):
                    arguments = r["arguments"]
                    errors.append("arguments are no JSON")
                else:
                    if r["schema"] is None:
                        errors.append("unknown tool")
                    else:
                        if r["schema"] not in parsed:
                            try:
                                parsed[r["schema"]] = parsed_json(r["schema"])
                            except ValueError:
                                parsed[r["schema"]] = None
                        schema = parsed[r["schema"]]
                        try:
                            errors += violations(arguments, schema) if isinstance(schema, dict) else ["schema is no JSON object"]
                        except (AttributeError, TypeError, RecursionError):  # what a schema means by such a value is not known
                            errors.append("schema cannot be applied")
                errors = [e.encode("utf-8", "backslashreplace").decode() for e in errors]
                out.append((r["conv_id"], r["call_id"], r["level"], r["n_results"], errors, canonical({"arguments": arguments, "id": r["call_id"], "name": r["name"], "result": r["result"]})))
            cols = zip(*out) if out else [()] * 6
            kinds = [batch.schema.field("conv_id").type, batch.schema.field("call_id").type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["conv_id", "call_id", "level", "n_results", "errors", "json"])

    return rows.mapInArrow(run, f"conv_id {conv}, call_id {call}, level long, n_results long, errors array<string>, json string")


#: The tools of the query: a question and a statement, with limits that some messages break.
SCHEMAS = {
    "ask": {"type": "object", "properties": {"text": {"type": "string", "maxLength": 600}, "words": {"type": "integer", "minimum": 1}}, "required": ["text", "words"], "additionalProperties": False},
    "tell": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1, "maximum": 40}}, "required": ["text", "words"], "additionalProperties": False},
}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages as calls, each taking the answer to the one two turns before; the answers as their results.

    A message is a call of "ask" if it holds a comma, else of "tell".
    """
    turns = read(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.lit("call"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("words")))
    calls = turns.where("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"), F.when(F.coalesce("text", F.lit("")).contains(","), "ask").otherwise("tell").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame([(k, json.dumps(v)) for k, v in SCHEMAS.items()], "name string, schema string")
    found = link_calls(calls, results, schemas)
    return found.select("conv_id", "call_id", "level", "n_results", F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


QUERIES = {"op5_tool_calls": op5_tool_calls}

ORACLES = {
    "op5_tool_calls": """
WITH calls AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
         CASE WHEN contains(coalesce(text, ''), ',') THEN 'ask' ELSE 'tell' END AS name,
         CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS BIGINT) AS words
  FROM conversations WHERE role = 'user'),
islands AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls),
leveled AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS BIGINT) AS level FROM islands),
results AS (
  SELECT conv_id, turn - 1 AS turn, CAST(count(*) AS BIGINT) AS n, min(text) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
linked AS (
  SELECT l.*, coalesce(r.n, 0) AS n_results, r.result FROM leveled l LEFT JOIN results r ON l.conv_id = r.conv_id AND l.turn = r.turn)
SELECT conv_id, 'call-' || turn AS call_id, level, n_results,
       array_to_string(list_filter([
         CASE WHEN n_results = 0 THEN 'no result' WHEN n_results > 1 THEN 'several results' END,
         CASE WHEN name = 'ask' AND length(text) > 600 THEN '$.text: too long' END,
         CASE WHEN words < 1 THEN '$.words: below minimum' END,
         CASE WHEN name = 'tell' AND words > 40 THEN '$.words: above maximum' END], lambda e: e IS NOT NULL), '; ') AS errors,
       sha256('{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '},"id":"call-' || turn || '","name":"' || name || '","result":'
              || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}') AS json_sha256
FROM linked""",
}
