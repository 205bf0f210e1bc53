"""Payloads, argument lists and tools as exact JSON text, read by Python's own readers in Arrow batches.

Spark's variant sorts keys, shortens numbers and rejects repeated keys, so what goes into
messages is read here: keys keep their order, of repeated keys the last value counts, 1.0
stays 1.0, NaN stays NaN, and `(1)` is a number while `(1,)` is a list. Texts are compact JSON.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: What Python's readers raise on texts that are no literals, too deep or of too many digits.
UNREADABLE = (ValueError, SyntaxError, TypeError, RecursionError, MemoryError)


def compact(value) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        out.encode()
    except UnicodeEncodeError:  # half a surrogate pair has no UTF-8
        out = json.dumps(value, separators=(",", ":"))
    return out


def literal(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.literal_eval(text)


def _payload(text: str) -> str | None:
    """The JSON value that a text starts with or, where it starts with none, the Python dict that it is."""
    text = text.strip()
    try:
        value = json.JSONDecoder().raw_decode(text)[0]
    except UNREADABLE:
        value = literal(text)
        value = value if isinstance(value, dict) else None
    return None if value is None else compact(value)


def _api_list(text: str) -> str | None:
    """The Python list behind "APIs:"."""
    at = text.find("APIs:")
    value = literal(text[at + 5 :].strip()) if at >= 0 else None
    return compact(value) if isinstance(value, list) else None


def _json(text: str) -> str:
    return compact(json.loads(text))


def _calls(text: str) -> list[dict]:
    return [{"name": a["name"], "arguments": compact(a["arguments"])} for a in json.loads(text)]


def _schema(tool: dict) -> dict:
    """A raw tool with nested parameters as a function schema: properties keep all their keys but
    examples and empty descriptions; names required of no property go."""
    given = tool.get("parameters") or {}
    fields = given.get("properties") or {}
    kept = {n: {k: v for k, v in f.items() if k != "example_value" and (v or k != "description")} if isinstance(f, dict) else {"type": "string"} for n, f in fields.items()}
    needed = {"required": r} if (r := [n for n in given.get("required") or () if n in kept]) else {}
    return {"type": "function", "function": {"name": tool["name"], "description": tool.get("description", ""), "parameters": {"type": "object", "properties": kept, **needed}}}


def _tools(text: str) -> list[str]:
    return [compact(_schema(t)) for t in json.loads(text)]


def _apply(read: Callable, value, known: dict):
    """known: what was read of the batch's texts so far; lists of tools and empty arguments repeat."""
    if value is None:
        return None
    if isinstance(value, list):
        return [_apply(read, v, known) for v in value]
    if value not in known:
        try:
            known[value] = read(value)
        except (*UNREADABLE, KeyError, AttributeError):
            known[value] = None
    return known[value]


def _reader(read: Callable, kind: str, arrow: pa.DataType):
    def run(texts: pa.Array) -> pa.Array:
        known: dict = {}
        return pa.array([_apply(read, x, known) for x in texts.to_pylist()], arrow)

    return arrow_udf(run, kind)


def payload(c: Column) -> Column:
    """A payload as JSON text; null if it does not parse or is null."""
    return _reader(_payload, "string", pa.string())(c)


def payloads(c: Column) -> Column:
    """payload of each text of an array."""
    return _reader(_payload, "array<string>", pa.list_(pa.string()))(c)


def payloads_of_turns(c: Column) -> Column:
    """payload of each text of an array of arrays."""
    return _reader(_payload, "array<array<string>>", pa.list_(pa.list_(pa.string())))(c)


def api_list(c: Column) -> Column:
    """The list of tools in a system turn as JSON text; null without one."""
    return _reader(_api_list, "string", pa.string())(c)


def json_text(c: Column) -> Column:
    """JSON text in compact form, keys in order; null if it does not parse."""
    return _reader(_json, "string", pa.string())(c)


def calls(c: Column) -> Column:
    """array<struct<name, arguments>> of a JSON array of calls; null if it does not parse."""
    return _reader(_calls, "array<struct<name: string, arguments: string>>", pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())])))(c)


def tool_schemas(c: Column) -> Column:
    """array<string>: the function schemas, as JSON text, of a JSON array of raw tools."""
    return _reader(_tools, "array<string>", pa.list_(pa.string()))(c)
