import json

from pyspark.sql import functions as F

from leadspark.functions import contract as K


def parsed(spark, texts, schema=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.r for r in df.select("i", K.parse_response(F.col("t"), schema).alias("r")).orderBy("i").collect()]


def test_finding_the_json(spark):
    texts = ['{"a": 1}', ' [1, 2] ', 'So:\n```json\n{"a": "x"}\n```\nok', 'Sure {"a": "}{\\"", "b": {"c": [1]}} and {"z": 2}', "take [1, {\"a\": 2}] now {", "{broken", "none", None, "", "null", "```\n[]\n```", 'x {"a": } y {"b": 1}']
    got = parsed(spark, texts)
    want = [{"a": 1}, [1, 2], {"a": "x"}, {"a": '}{"', "b": {"c": [1]}}, [1, {"a": 2}], None, None, None, None, None, [], None]
    assert [r.data and json.loads(r.data) for r in got] == want
    assert all(r.ok == (w is not None) for r, w in zip(got, want))
    assert got[6].retry_prompt == K.NO_JSON and got[6].errors == ["AI response: no JSON object found in the response"] and got[0].retry_prompt is None


def test_keywords(spark):
    schema = {
        "type": "object", "required": ["a", "q\"k"], "additionalProperties": False,
        "properties": {
            "a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"const": "x"}, "c": {"enum": [1, "1", True, None]}, "d": {"type": ["array", "null"], "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number"}}}},
            "e": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^é"}, "q\"k": {}, "f": {"type": "boolean"},
        },
    }
    ok = {"a": 3, "q\"k": None}
    cases = [
        (ok, []), ([], ["$: expected object, got array"]), ("s", ["$: expected object, got string"]), ({}, ["$.a: required property missing", '$.q"k: required property missing']),
        (ok | {"a": 1.0, "b": "x", "c": True, "d": None, "e": "éa", "f": False}, []), (ok | {"a": 1.5}, ["$.a: expected integer, got number"]), (ok | {"a": 0}, ["$.a: below minimum 1"]), (ok | {"a": 6}, ["$.a: above maximum 5"]),
        (ok | {"b": "y"}, ['$.b: must equal "x"']), (ok | {"c": "x"}, ['$.c: "x" is not one of [1,"1",true,null]']), (ok | {"c": False}, ['$.c: false is not one of [1,"1",true,null]']), (ok | {"c": 1.0}, []),
        (ok | {"d": []}, ["$.d: needs at least 1 items"]), (ok | {"d": [{"n": 1}, {"n": 1}, {}]}, ["$.d: at most 2 items", "$.d[2].n: required property missing", "$.d: items must be unique"]), (ok | {"d": [5, {"n": "x"}]}, ["$.d[0]: expected object, got number", "$.d[1].n: expected number, got string"]),
        (ok | {"e": "x"}, ["$.e: shorter than 2", "$.e: does not match /^é/"]), (ok | {"e": "éabc"}, ["$.e: longer than 3 (4)"]), (ok | {"f": 1, "zz": 1, "y": 2}, ["$.f: expected boolean, got number", "$.y: unexpected property", "$.zz: unexpected property"]),
    ]
    got = parsed(spark, [json.dumps(v) for v, _ in cases], schema)
    for r, (v, want) in zip(got, cases):
        assert r.errors == want, v
        assert r.ok == (not want) and (r.retry_prompt is None) == (not want)
    assert got[3].retry_prompt.endswith('\n- $.a: required property missing\n- $.q"k: required property missing')
