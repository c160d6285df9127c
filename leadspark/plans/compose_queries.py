"""First messages over the leads and signals derived from `pages`, with SQL that joins tables of openers and wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.config import openers as O
from leadspark.operators import compose as CO
from leadspark.operators import research as E
from leadspark.plans import research_queries as RQ

c = F.col
SENDER, COMPANY = "Sam", "North Desk"
#: Columns of a lead that its message needs, by expressions that both engines read.
MORE = {
    "company_name": "concat(case lead_id % 3 when 0 then 'Glow ' when 1 then 'É Bar ' else 'Bright Skin ' end, lead_id)",
    "business_instagram": "case when lead_id % 4 <> 1 then concat('glow', lead_id) end",
    "owner_name": "case lead_id % 6 when 0 then 'Dana Whitfield' when 1 then '  Jo-Ann  X' when 2 then '1234' when 3 then '' when 4 then 'É' end",
    "recommended_offer": "case lead_id % 7 when 0 then 'BOTH' when 1 then 'AI_VOICE' when 2 then 'AI_VOICE' when 3 then 'CUSTOMER_SUPPORT' when 4 then 'CUSTOMER_SUPPORT' when 5 then 'NONE' end",
}


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = RQ._known(spark, sf_dir).withColumn("signals", E.signals()).select("lead_id", "category", "signals", *(F.expr(e).alias(n) for n, e in MORE.items()))
    out = CO.compose(leads, SENDER, COMPANY)
    checks = ("opens_with_verified_observation", "no_assumed_pain", "ends_with_question", "under_max_chars", "no_gendered_pronouns")
    return out.select("lead_id", "message", "observation_used", "capability_mentioned", "why_this_message", *(c(f"self_check.{k}").alias(k) for k in checks))


QUERIES = {"r13_messages": _messages}


def _t(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    openers = ", ".join(f"({i}, {_t(signal)}, {_t(service)}, {_t(kind)})" for i, (signal, service, kind, _, _) in enumerate(O.OPENERS))
    wordings = ", ".join(f"({i}, {part}, {n}, {k}, {_t(text)})" for i, o in enumerate(O.OPENERS) for part, texts in ((0, o[3]), (1, o[4])) for n in [len(texts)] for k, text in enumerate(texts))
    pick = lambda texts, seed: f"[{', '.join(_t(x) for x in texts)}][({seed}) % {len(texts)} + 1]"
    cut = "case when length(q0) > 64 then regexp_replace(q0[1:64], '\\s+\\S*$', '') else q0 end"
    service = "case when offer = 'BOTH' then 'AI_VOICE' else offer end"
    both = lambda table: f"case when service = 'AI_VOICE' then {_t(table[O.VOICE])} else {_t(table[O.SUPPORT])} end"
    return f"""with {RQ._sql_known()}, sigs as materialized (select row_number() over () as n, * from ({RQ._sql_signals()}) s),
    openers(i, signal, service, kind) as (values {openers}), wordings(i, part, n, k, line) as (values {wordings}),
    people as (select lead_id, category, {', '.join(f'{e} as {n}' for n, e in MORE.items() if n != 'recommended_offer')}, {MORE['recommended_offer']} as offer from known),
    seeded as (select *, {service} as service, list_reduce(list_prepend(5381::bigint, list_transform(list_filter(string_split(coalesce(company_name, '') || '|' || coalesce(business_instagram, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)), lambda h, x: (h * 33 + x) % 4294967296) as seed from people),
    tried as (select p.lead_id, o.i, o.kind, o.service as of, s.signal, s.evidence, s.confidence, s.source, trim(regexp_replace(regexp_extract(evidence, '"([^"]{{3,120}})"', 1), '\\s+', ' ', 'g')) as q0,
      list_filter(string_split_regex(regexp_extract(evidence, 'present on the website: (.+?)\\.?$', 1), ',\\s*'), lambda x: regexp_matches(x, '{O.CONTACT}', 'i')) as ways
      from seeded p join (select lead_id, signal, arg_min({{'evidence': evidence, 'confidence': confidence, 'source': source}}, n) as s0, arg_min(evidence, n) as evidence, arg_min(confidence, n) as confidence, arg_min(source, n) as source from sigs where confidence <> 'LOW' group by 1, 2) s using (lead_id) join openers o using (signal)),
    cleaned as (select *, regexp_replace(regexp_replace({cut}, '[?!]', '', 'g'), '[\\s,;:.\\-]+$', '') as q from tried),
    fragments as (select *, case kind when 'none' then '' when 'booking' then nullif(regexp_extract(evidence, 'detected: (.+?)\\.?$', 1), '') when 'chat' then nullif(regexp_extract(evidence, '^(.+?) chat widget', 1), '')
      when 'calls' then case when try_cast(regexp_extract(evidence, '(\\d+) click-to-call', 1) as bigint) >= 2 then regexp_extract(evidence, '(\\d+) click-to-call', 1) end
      when 'products' then case when try_cast(regexp_extract(evidence, '(\\d+) product', 1) as bigint) >= 1 then regexp_extract(evidence, '(\\d+) product', 1) end
      when 'channels' then case when len(ways) >= 2 then array_to_string(ways[1:len(ways) - 1], ', ') || ' and ' || ways[len(ways)] end
      else case when length(q) >= 8 and not starts_with(q, '...') and not ends_with(q, '...') and not regexp_matches(q, {_t(O.NOT_COPY)}, 'i') and not regexp_matches(q, {_t(O.PHONE_NUMBER)}) and not regexp_matches(q, {_t(O.SITE_CHROME)}, 'i')
        and len(string_split_regex(q, '\\s+')) >= 2 and regexp_matches(q, '[a-z]{{3}}') then q end end as x from cleaned),
    chosen as (select p.*, f.i, f.x, f.signal, f.evidence, f.confidence, f.source from seeded p left join (select f.* from fragments f join seeded p using (lead_id) where x is not null
      qualify row_number() over (partition by f.lead_id order by case when f.of = p.service then 0 else 1 end, f.i) = 1) f using (lead_id)),
    worded as (select c.*, replace(a.line, '{{x}}', x) as opening, replace(b.line, '{{x}}', x) as question,
      coalesce(nullif(trim(regexp_replace(lower(coalesce(category, 'clinic')), '[^a-z /+&-]', '', 'g')), ''), 'clinic') as kindof, regexp_split_to_array(trim(coalesce(owner_name, '')), '\\s+')[1] as name
      from chosen c left join wordings a on a.i = c.i and a.part = 0 and a.k = seed % a.n left join wordings b on b.i = c.i and b.part = 1 and b.k = (seed // 8) % b.n),
    composed as (select *, case when service in ('AI_VOICE', 'CUSTOMER_SUPPORT') then trim(regexp_replace(case when regexp_matches(name, {_t(O.FIRST_NAME)}) then name || ' - ' else '' end ||
      coalesce(opening, replace({pick(O.GENERAL, 'seed')}, '{{x}}', kindof)) || ' ' || replace(replace({pick(O.INTRODUCTIONS, 'seed // 128')}, '{{name}}', {_t(SENDER)}), '{{company}}', {_t(COMPANY)}) || ' ' ||
      case when service = 'AI_VOICE' then {pick(O.CAPABILITIES[O.VOICE], 'seed // 32')} else {pick(O.CAPABILITIES[O.SUPPORT], 'seed // 32')} end || '. ' || regexp_replace(coalesce(question, {_t(O.GENERAL_QUESTION)}), '[\\s.!?]+$', '') || '?', '\\s+', ' ', 'g')) else '' end as message,
      coalesce(service in ('AI_VOICE', 'CUSTOMER_SUPPORT'), false) as offered from worded)
    select lead_id, message, case when offered then evidence end as observation_used, case when offered then {both(O.MENTIONED)} end as capability_mentioned,
      case when not offered then {_t(O.NO_MESSAGE)} when i is null then {_t(O.NO_SIGNAL)} else 'Opens on the "' || signal || '" signal (' || confidence || ' confidence, from ' || source || ') and names one ' || {both(O.NAMED)} || ' capability against it.' end as why_this_message,
      case when offered then i is not null end as opens_with_verified_observation, case when offered then not list_bool_or([contains(lower(message), p) for p in [{', '.join(_t(p) for p in O.BANNED)}]]) end as no_assumed_pain,
      case when offered then ends_with(message, '?') and length(message) - length(replace(message, '?', '')) = 1 end as ends_with_question, case when offered then length(message) <= {O.MOST_CHARACTERS} end as under_max_chars,
      case when offered then not regexp_matches(message, {_t(O.GENDERED)}, 'i') end as no_gendered_pronouns from composed"""


ORACLES = {"r13_messages": _sql()}
