"""Answers of a model as JSON (P7): found in a text, held against a JSON schema, and what to ask again.

The schema (draft-07: type, enum, const, minLength, maxLength, pattern, minimum, maximum, minItems, maxItems, items,
uniqueItems, required, properties, additionalProperties) is compiled on the driver into one expression over a
VARIANT, which gives the errors with their paths in the order of the schema. No UDF runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is asked of the model again.
NO_JSON = "Your previous response was not valid JSON. Return ONLY the JSON object described in the OUTPUT FORMAT section, with no prose, no markdown fence and no explanation."
FIX = "Your previous response did not satisfy the required schema. Fix exactly these problems and return ONLY the corrected JSON object:\n"
MOST_ASKED = 10
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def _balanced(text: Column) -> Column:
    """From the first brace or bracket to its partner; those in strings don't count."""
    at = F.regexp_instr(text, F.lit(r"[{\[]"))
    rest = F.substring(text, at, F.length(text))
    opener = F.substring(rest, 1, 1)
    closer = F.when(opener == "{", "}").otherwise("]")
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("depth", 0), ("quoted", False), ("escaped", False), ("at", 0), ("end", 0))))

    def step(s: Column, x: Column) -> Column:
        plain = ~s["quoted"]
        depth = s["depth"] + F.when(plain & (x == opener), 1).when(plain & (x == closer), -1).otherwise(0)
        here = s["at"] + 1
        return F.struct(
            depth.alias("depth"),
            F.when(s["quoted"], (x != '"') | s["escaped"]).otherwise(x == '"').alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (x == "\\")).alias("escaped"),
            here.alias("at"),
            F.when((s["end"] == 0) & plain & (x == closer) & (depth == 0), here).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(F.filter(F.split(rest, ""), lambda x: x != ""), start, step)["end"]
    return F.when((at > 0) & (end > 0), F.substring(rest, F.lit(1), end))


def extract_json(text: Column) -> Column:
    """The JSON of a response as text: the whole of it, else its first fenced block, else its
    first balanced object or array; null if none of them parses."""
    whole = F.trim(text)
    fenced = F.trim(F.nullif(F.regexp_extract(whole, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1), F.lit("")))
    parses = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parses(whole), _bound(fenced, parses), _bound(_balanced(whole), parses))


def _bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v computed once, however often f names it."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def _child(v: Column, key: str) -> Column:
    if '"' in key and "'" in key:
        raise ValueError(f"a property can't be read whose name has both kinds of quotes: {key}")
    mark = "'" if '"' in key else '"'
    return F.try_variant_get(v, f"$[{mark}{key}{mark}]", "variant")


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null, as JSON has it."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _is(v: Column, type_: str) -> Column:
    if type_ == "integer":
        n = F.try_variant_get(v, "$", "double")
        return (kind(v) == "number") & F.coalesce(n == F.floor(n), F.lit(False))
    return kind(v) == type_ if type_ in ("object", "array", "string", "number", "boolean", "null") else F.lit(True)


def _equal(v: Column, value) -> Column:
    if value is None:
        return kind(v) == "null"
    if isinstance(value, bool):
        return (kind(v) == "boolean") & (F.to_json(v) == json.dumps(value))
    if isinstance(value, (int, float)):
        return (kind(v) == "number") & (F.try_variant_get(v, "$", "double") == float(value))
    return (kind(v) == "string") & (F.try_variant_get(v, "$", "string") == value)


def errors(v: Column, schema: dict, path: Column | str = "$") -> Column:
    """array<string> of what is wrong with a variant; empty if nothing is."""
    path = F.lit(path) if isinstance(path, str) else path
    say = lambda *x: F.concat(path, F.lit(": "), *(F.lit(p) if isinstance(p, str) else p for p in x))
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    one = lambda when, *x: F.when(F.coalesce(when, F.lit(False)), say(*x))
    k, string = kind(v), F.try_variant_get(v, "$", "string")
    number, length = F.try_variant_get(v, "$", "double"), F.length(F.try_variant_get(v, "$", "string"))
    flat: list[Column] = []
    if "enum" in schema:
        known = F.lit(False)
        for x in schema["enum"]:
            known = known | F.coalesce(_equal(v, x), F.lit(False))
        flat.append(one(~known, F.to_json(v), f" is not one of {text(schema['enum'])}"))
    if "const" in schema:
        flat.append(one(~F.coalesce(_equal(v, schema["const"]), F.lit(False)), f"must equal {text(schema['const'])}"))
    is_text, is_number, is_list, is_object = (k == x for x in ("string", "number", "array", "object"))
    if schema.get("minLength") is not None:
        flat.append(one(is_text & (length < schema["minLength"]), f"shorter than {schema['minLength']}"))
    if schema.get("maxLength") is not None:
        flat.append(one(is_text & (length > schema["maxLength"]), f"longer than {schema['maxLength']} (", length.cast("string"), ")"))
    if schema.get("pattern"):
        flat.append(one(is_text & ~string.rlike(schema["pattern"]), f"does not match /{schema['pattern']}/"))
    if schema.get("minimum") is not None:
        flat.append(one(is_number & (number < schema["minimum"]), f"below minimum {schema['minimum']}"))
    if schema.get("maximum") is not None:
        flat.append(one(is_number & (number > schema["maximum"]), f"above maximum {schema['maximum']}"))
    none = F.array().cast("array<string>")
    parts: list[Column] = [F.array_compact(F.array(*flat))] if flat else []
    items = F.try_variant_get(v, "$", "array<variant>")
    if schema.get("minItems") is not None:
        parts.append(F.array_compact(F.array(one(is_list & (F.size(items) < schema["minItems"]), f"needs at least {schema['minItems']} items"))))
    if schema.get("maxItems") is not None:
        parts.append(F.array_compact(F.array(one(is_list & (F.size(items) > schema["maxItems"]), f"at most {schema['maxItems']} items"))))
    if schema.get("items"):
        each = F.flatten(F.transform(items, lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        parts.append(F.when(is_list, each).otherwise(none))
    if schema.get("uniqueItems"):
        said = F.transform(items, lambda x: F.to_json(x))
        parts.append(F.array_compact(F.array(one(is_list & (F.size(F.array_distinct(said)) < F.size(said)), "items must be unique"))))
    at = lambda key: F.concat(path, F.lit(f".{key}"))
    inner: list[Column] = []
    if schema.get("required"):
        inner.append(F.array_compact(F.array(*(F.when(_child(v, key).isNull(), F.concat(at(key), F.lit(": required property missing"))) for key in schema["required"]))))
    below = lambda key, sub: _bound(_child(v, key), lambda x: F.when(x.isNotNull(), errors(x, sub, at(key))).otherwise(none))
    inner += [below(key, sub) for key, sub in (schema.get("properties") or {}).items()]
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        odd = F.array_except(keys, F.array(*(F.lit(x) for x in schema.get("properties") or {})).cast("array<string>"))
        inner.append(F.transform(odd, lambda x: F.concat(path, F.lit("."), x, F.lit(": unexpected property"))))
    if inner:
        parts.append(F.when(is_object, F.concat(*inner)).otherwise(none))
    out = F.concat(*parts) if parts else none
    if schema.get("type"):
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for x in types:
            fits = fits | _is(v, x)
        out = F.when(~fits, F.array(say(f"expected {'|'.join(types)}, got ", k))).otherwise(out)
    return out


def parse_response(text: Column, schema: dict | None = None, label: str = "AI response") -> Column:
    """struct(ok, data, errors, retry_prompt): data is the JSON as text (null if there is none).
    A null text has no JSON; lengths are in characters; unexpected properties come by name."""

    def judged(data: Column, found: Column) -> Column:
        nothing = found.isNull() | (F.to_json(data) == "null")
        wrong = F.array().cast("array<string>") if schema is None else errors(data, schema)
        return F.when(nothing, F.array(F.lit(f"{label}: no JSON object found in the response"))).otherwise(wrong)

    def answer(wrong: Column, data: Column, found: Column) -> Column:
        nothing = found.isNull() | (F.to_json(data) == "null")
        ask = F.concat(F.lit(FIX), F.array_join(F.transform(F.slice(wrong, 1, MOST_ASKED), lambda e: F.concat(F.lit("- "), e)), "\n"))
        return F.struct(
            (F.size(wrong) == 0).alias("ok"), F.when(~nothing, found).alias("data"), wrong.alias("errors"), F.when(nothing, NO_JSON).when(F.size(wrong) > 0, ask).alias("retry_prompt")
        )

    return _bound(extract_json(text), lambda found: _bound(F.try_parse_json(found), lambda data: _bound(judged(data, found), lambda wrong: answer(wrong, data, found))))
