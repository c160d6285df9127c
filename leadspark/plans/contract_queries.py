"""Contract checks of responses derived from `events`, with SQL over DuckDB's own JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import dealt
from leadspark.functions import contract as K
from leadspark.plans.inputs import table, with_sql

c = F.col
CLASSES = ["interested", "pricing", "unclear", "not_now"]
SCHEMA = {
    "type": "object",
    "required": ["classification", "intent", "stop"],
    "additionalProperties": False,
    "properties": {
        "classification": {"type": "string", "enum": CLASSES},
        "intent": {"type": "string", "minLength": 3, "maxLength": 12, "pattern": "^[a-z ]+$"},
        "objection": {"type": ["string", "null"], "enum": ["price", "timing", None]},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "count": {"type": "integer"},
        "stop": {"type": "boolean"},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "maxLength": 4}},
        "extracted": {"type": "object", "required": ["to"], "properties": {"to": {"type": ["string", "null"]}}},
    },
}
#: The response to each message, with faults by its number, by an expression that both engines read.
RESPONSE = (
    "concat(case event_id % 11 when 0 then 'Sure, here: ' when 1 then '```json ' when 2 then 'no answer' else '' end, case when event_id % 11 = 2 then '' else concat('{', "
    "case when event_id % 13 <> 3 then concat('\"classification\": \"', coalesce(classification, 'unclear'), '\", ') else '' end, '\"intent\": \"', "
    "case event_id % 7 when 0 then 'a' when 1 then 'far too long an intent' when 2 then 'With CAPS' else 'ask price' end, '\"', case when event_id % 5 > 0 then concat(', \"objection\": ', case event_id % 5 when 1 then '\"price\"' when 2 then 'null' when 3 then '\"other\"' else '5' end) else '' end, "
    "', \"confidence\": ', case event_id % 6 when 0 then '1.5' when 1 then '-1' when 2 then '\"high\"' else '0.5' end, ', \"count\": ', case event_id % 4 when 0 then '2' when 1 then '2.5' else '7' end, "
    "case when event_id % 9 <> 4 then concat(', \"stop\": ', case when event_id % 9 = 5 then 'null' else 'true' end) else '' end, ', \"tags\": ', case event_id % 8 when 0 then '[]' when 1 then '[\"a\", \"b\", \"a\"]' when 2 then '[\"a\", 5, \"toolong\", \"d\"]' when 3 then '{}' else '[\"a\"]' end, "
    "case event_id % 10 when 0 then ', \"extracted\": {}' when 1 then ', \"extracted\": {\"to\": 3}' when 2 then ', \"extra\": 1, \"also\": {\"x\": \"}\"}' else '' end, '}') end, "
    "case event_id % 11 when 0 then ' ok {x}' when 1 then ' ```' else '' end)"
)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "messages"), "event_id").select("event_id", F.expr(RESPONSE).alias("response"))
    out = rows.select("event_id", K.parse_response(c("response"), SCHEMA).alias("r"))
    return out.select("event_id", "r.ok", F.array_join("r.errors", "; ").alias("errors"), "r.retry_prompt")


QUERIES = {"p07_contract": _responses}


def _sql() -> str:
    t = lambda key: f"json_type(j, '$.{key}')"
    js = "case {t} when 'NULL' then 'null' when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' else 'number' end"
    said = lambda key: js.format(t=t(key))
    text = lambda key: f"json_extract_string(j, '$.{key}')"
    num = lambda key: f"cast(json_extract_string(j, '$.{key}') as double)"
    is_num = lambda x: f"{x} in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    tag = lambda i: (
        f"case when json_type(j, '$.tags[{i}]') is null then null when json_type(j, '$.tags[{i}]') <> 'VARCHAR' then '$.tags[{i}]: expected string, got ' || {js.format(t=f'''json_type(j, '$.tags[{i}]')''')}"
        f" when length(json_extract_string(j, '$.tags[{i}]')) > 4 then '$.tags[{i}]: longer than 4 (' || length(json_extract_string(j, '$.tags[{i}]')) || ')' end"
    )
    tags = f"{t('tags')} = 'ARRAY'"
    checks = [
        *(f"case when {t(k)} is null then '$.{k}: required property missing' end" for k in ("classification", "intent", "stop")),
        f"case when {text('classification')} not in ('interested', 'pricing', 'unclear', 'not_now') then '$.classification: \"' || {text('classification')} || '\" is not one of [\"interested\",\"pricing\",\"unclear\",\"not_now\"]' end",
        f"case when length({text('intent')}) < 3 then '$.intent: shorter than 3' end",
        f"case when length({text('intent')}) > 12 then '$.intent: longer than 12 (' || length({text('intent')}) || ')' end",
        f"case when not regexp_matches({text('intent')}, '^[a-z ]+$') then '$.intent: does not match /^[a-z ]+$/' end",
        f"case when {t('objection')} not in ('VARCHAR', 'NULL') then '$.objection: expected string|null, got ' || {said('objection')} when {t('objection')} = 'VARCHAR' and {text('objection')} not in ('price', 'timing') then '$.objection: \"' || {text('objection')} || '\" is not one of [\"price\",\"timing\",null]' end",
        f"case when {t('confidence')} = 'VARCHAR' then '$.confidence: expected number, got string' when {num('confidence')} < 0 then '$.confidence: below minimum 0' when {num('confidence')} > 1 then '$.confidence: above maximum 1' end",
        f"case when {is_num(t('count'))} and {num('count')} <> floor({num('count')}) then '$.count: expected integer, got number' end",
        f"case when {t('stop')} <> 'BOOLEAN' then '$.stop: expected boolean, got ' || {said('stop')} end",
        f"case when {t('tags')} <> 'ARRAY' then '$.tags: expected array, got ' || {said('tags')} end",
        f"case when {tags} and json_array_length(j, '$.tags') < 1 then '$.tags: needs at least 1 items' end",
        f"case when {tags} and json_array_length(j, '$.tags') > 3 then '$.tags: at most 3 items' end",
        *(tag(i) for i in range(4)),
        f"case when {tags} and len(list_distinct(cast(json_extract(j, '$.tags') as json[]))) < json_array_length(j, '$.tags') then '$.tags: items must be unique' end",
        f"case when {t('extracted')} = 'OBJECT' and {t('extracted.to')} is null then '$.extracted.to: required property missing' when {t('extracted.to')} not in ('VARCHAR', 'NULL') then '$.extracted.to: expected string|null, got number' end",
        *(f"case when {t(k)} is not null then '$.{k}: unexpected property' end" for k in ("also", "extra")),
    ]
    no = "AI response: no JSON object found in the response"
    return with_sql(
        f"""select event_id, n = 0 as ok, array_to_string(wrong, '; ') as errors, case when j is null then '{K.NO_JSON}' when n > 0 then '{K.FIX.strip()}' || chr(10) || array_to_string([('- ' || x) for x in wrong[1:10]], chr(10)) end as retry_prompt
    from (select event_id, j, len(wrong) as n, wrong from (select event_id, j, case when j is null then ['{no}'] else list_filter([{', '.join(checks)}], lambda x: x is not null) end as wrong
    from (select event_id, case when event_id % 11 = 2 then null else cast(regexp_replace(regexp_replace(response, '^(Sure, here: |```json )', ''), '( ok [{{]x[}}]| ```)$', '') as json) end as j from (select event_id, {RESPONSE} as response from messages) a) b) d) e"""
    )


ORACLES = {"p07_contract": _sql()}
