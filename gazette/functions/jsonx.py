"""Reading JSON that a text model returned: in prose, cut off, or of varying shape."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole string, a brace, a quote that opens a string without an end, or what lies between these.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"|[{}]|"|[^"{}]++'


def salvage(raw: Column) -> Column:
    """The whole objects of the first array in a text, as JSON; null if there are none. Objects that are not valid JSON are left out.

    The text is cut into strings, braces and the rest; a string without an end ends it. Depth is counted over these tokens, and an object ends where it is back at none.
    """
    begin = F.instr(raw, F.lit("["))
    tokens = F.regexp_extract_all(F.substr(raw, begin + 1), F.lit("(?s)" + _TOKENS), F.lit(0))
    open_ = F.array_position(tokens, '"')
    tokens = F.when(open_ > 0, F.slice(tokens, 1, F.greatest(open_ - 1, F.lit(0)).cast("int"))).otherwise(tokens)

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when((t == "}") & (s["depth"] > 0), -1).otherwise(0)
        own = F.when(s["depth"] + depth > 0, F.concat(s["own"], t)).otherwise("")
        done = (depth == 0) & (s["depth"] > 0)
        return F.struct(depth.cast("int").alias("depth"), F.when(done, "").otherwise(own).alias("own"), F.when(done, F.array_append(s["found"], own)).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("own"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(tokens, start, step, lambda s: s["found"])
    valid = F.filter(F.transform(found, lambda o: F.to_json(F.try_parse_json(o))), lambda o: o.isNotNull())
    return F.when((begin > 0) & (F.size(valid) > 0), valid)


def readable(text: str | None) -> bool:
    """Whether items() finds an object in a text: Python's own parser, tried where one may begin."""
    for part in filter(None, (text, (m := re.search(r"\[.*\]|\{.*\}", text or "", re.S)) and m.group())):
        try:
            if isinstance(found := json.loads(part), list) and found:
                return True
        except ValueError:
            pass
    at = (text or "").find("[")
    while at >= 0 and (at := text.find("{", at + 1)) >= 0:
        try:
            json.JSONDecoder().raw_decode(text, at)
            return True
        except ValueError:
            continue
    return False


def json_block(c: Column) -> Column:
    """The text from the first bracket to the last one of its kind."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))


def items(raw: Column) -> Column:
    """Array of JSON objects in a model's answer: all of it, its first block, or what can be salvaged; null if nothing can.

    A block that is a single object inside a cut-off array counts as an array of one.
    """
    whole = lambda c: F.when(F.trim(c).startswith("["), F.from_json(c, "array<variant>"))
    texts = lambda c: F.transform(c, lambda v: F.to_json(v))
    parsed = F.coalesce(texts(whole(F.trim(raw))), texts(whole(json_block(raw))))
    return F.when(F.size(parsed) > 0, parsed).otherwise(salvage(raw))


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def flattened(entry: Column, element: str) -> Column:
    """A list, or an object of lists by region, given as JSON text: one list."""
    as_list = F.from_json(entry, f"array<{element}>")
    as_map = F.from_json(entry, f"map<string, array<{element}>>")
    return F.when(F.ltrim(entry).startswith("["), as_list).otherwise(F.flatten(F.map_values(as_map)))
