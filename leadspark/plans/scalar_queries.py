"""The normalisers over raw rows, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions import scalars as S
from leadspark.plans.inputs import table, with_sql

col = F.col
NOW = "2026-01-01 00:00:00"
TERMS = ["seo agency", "call center", "botox", "filler", "aesthetics", "medspa", "dm"]


def _rows(make: Callable[[], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, "raw").select("id", *(c.alias(n) for n, c in make().items()))


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _clean(x: str) -> str:
    plain = rf"regexp_replace(strip_accents({x}), '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0F}}\x{{200D}}]', ' ', 'g')"
    return rf"nullif(trim(regexp_replace(regexp_replace({plain}, '[|•·–—]+', ' ', 'g'), '\s+', ' ', 'g')), '')"


def _key(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(replace(lower({_clean(x)}), '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in {_list(S.NAME_NOISE)})"
    out = f"array_to_string({words}, ' ')"
    for two, one in (("med spa", "medspa"), ("day spa", "dayspa"), ("be commerce", "ecommerce")):
        out = rf"regexp_replace({out}, '\b{two}\b', '{one}', 'g')"
    return f"nullif({out}, '')"


def _handle(x: str) -> str:
    inside = rf"case when regexp_extract(trim({x}), '(?i)instagram\.com/([^/?#]+)', 1) <> '' then regexp_extract(trim({x}), '(?i)instagram\.com/([^/?#]+)', 1) else trim({x}) end"
    bare = f"lower(trim(split_part(regexp_replace(regexp_replace({inside}, '^@+', ''), '/+$', ''), '?', 1)))"
    return f"case when regexp_matches({bare}, '^[a-z0-9._]{{1,30}}$') and {bare} not in {_list(S.RESERVED_HANDLES)} then {bare} end"


_PARTS = r"'(?i)^(https?)://([^/?#:@]+)(?::\d+)?([^?#]*)(?:\?([^#]*))?'"
_URLS = rf"""
  a as (select *, case when trim(website) not in ('', '-') and lower(trim(website)) <> 'n/a' then
          case when regexp_matches(trim(website), '(?i)^https?://') then trim(website) else 'https://' || trim(website) end end as r from raw),
  b as (select *, lower(regexp_extract(r, {_PARTS}, 1)) as sch, lower(regexp_extract(r, {_PARTS}, 2)) as host, regexp_replace(regexp_extract(r, {_PARTS}, 3), '/+$', '') as path,
          array_to_string(list_filter(string_split(regexp_extract(r, {_PARTS}, 4), '&'), lambda p: p <> '' and not regexp_matches(p, '(?i)^(utm_|fbclid|gclid|mc_|ref|source)')), '&') as q from a),
  u as (select *, case when regexp_matches(host, '^[a-z0-9.-]+\.[a-z]{{2,}}$') then sch || '://' || host || path || case when q <> '' then '?' || q else '' end end as url from b),
  v as (select *, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '') as bare from u)"""
_DOMAIN = f"case when bare <> '' and bare not in {_list(S.SHARED_HOSTS)} then bare end"

_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_NATIONAL = f"case when length({_DIGITS}) = 11 and {_DIGITS} like '1%' then substr({_DIGITS}, 2) else {_DIGITS} end"
_PHONE = rf"""case when not regexp_matches(phone, '(?i)ext|x\d{{3,}}') and trim(phone) like '+%' and regexp_matches(regexp_replace(phone, '[^0-9+]', '', 'g'), '^\+\d{{8,15}}$')
    then regexp_replace(phone, '[^0-9+]', '', 'g')
  when length({_NATIONAL}) = 10 and not regexp_matches({_NATIONAL}, '^[01]') and {_NATIONAL} not in {_list([d * 10 for d in "0123456789"])} then '+1' || {_NATIONAL} end"""
_EMAIL = rf"""case when regexp_matches(regexp_replace(lower(trim(email)), '^mailto:', ''), '^[^\s@]+@[^\s@]+\.[a-z]{{2,}}$')
  and split_part(regexp_replace(lower(trim(email)), '^mailto:', ''), '@', 1) not in {_list(S.ROLE_MAILBOXES)} then regexp_replace(lower(trim(email)), '^mailto:', '') end"""
_SK = r"trim(regexp_replace(lower(strip_accents(trim(state))), '[^a-z\s]', '', 'g'))"
_STATE = (
    f"case when upper(trim(state)) in {_list(list(S.STATES.values()))} then upper(trim(state)) "
    + " ".join(f"when {_SK} = '{n}' then '{c}'" for n, c in S.STATES.items())
    + " "
    + " ".join(f"when length({_SK}) >= 4 and starts_with('{n}', {_SK}) then '{c}'" for n, c in S.STATES.items())
    + " end"
)
_CITY = r"""array_to_string(list_transform(string_split(lower(trim(regexp_replace(regexp_replace(strip_accents(city), '[^\p{L}\s.''-]', ' ', 'g'), '\s+', ' ', 'g'))), ' '),
   lambda w: case when length(w) > 2 or w in ('st', 'ft') then upper(substr(w, 1, 1)) || substr(w, 2) else w end), ' ')"""
_COUNT = r"regexp_extract(regexp_replace(lower(followers), '[,\s]', '', 'g'), '^([0-9.]+)([km])?$', {0})"
_COUNTED = f"cast(floor(try_cast(nullif({_COUNT.format(1)}, '') as double) * case {_COUNT.format(2)} when 'k' then 1e3 when 'm' then 1e6 else 1.0 end + 0.5) as bigint)"


def _term_array() -> Column:
    return S.term_hits(F.lower(F.coalesce("bio", F.lit(""))), TERMS)


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name pairs that share a city bucket and follow each other."""
    rows = table(spark, sf_dir, "raw").select("id", S.name_key(col("name")).alias("k"))
    other = rows.select((col("id") - 35).alias("id"), col("k").alias("k2"))
    return rows.join(other, "id").select("id", F.round(S.name_similarity(col("k"), col("k2")), 9).alias("similarity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s01_text": _rows(lambda: {"folded": S.fold(col("name")), "squeezed": S.squeeze(col("name"))}),
    "s02_clean_name": _rows(lambda: {"clean": S.clean_name(col("name"))}),
    "s03_name_key": _rows(lambda: {"key": S.name_key(col("name"))}),
    "s04_handle": _rows(lambda: {"handle_key": S.handle(col("handle")), "profile": S.profile_url(col("handle"))}),
    "s05_url": _rows(lambda: {"url": S.url(col("website"))}),
    "s06_domain": _rows(lambda: {"domain": S.domain(col("website")), "shared": S.is_shared_host(S.host_of(S.url(col("website"))))}),
    "s07_phone": _rows(lambda: {"e164": S.phone(col("phone"))}),
    "s08_email": _rows(lambda: {"address": S.email(col("email"))}),
    "s09_state": _rows(lambda: {"code": S.state(col("state"))}),
    "s10_city": _rows(lambda: {"town": S.city(col("city")), "slug": S.slug(col("name"))}),
    "s11_count": _rows(lambda: {"n": S.count(col("followers"))}),
    "s13_products": _rows(lambda: {"items": F.array_join(S.product_list(col("products")), "|")}),
    "s14_term_hits": _rows(lambda: {"hits": F.array_join(_term_array(), "|")}),
    "s15_name_similarity": _similar,
    "s16_wording_seed": _rows(lambda: {"seed": S.wording_seed(col("email")), "opener": S.pick(["a", "b", "c"], S.wording_seed(col("email")))}),
    "s20_role": _rows(lambda: {"role": S.role(col("title"))}),
    "s21_retry": _rows(
        lambda: {
            "kind": S.error_type(col("status"), col("message")),
            "retry": S.error_type(col("status"), col("message")).isin(S.RETRYABLE) & (col("attempt") < 3),
            "delay_ms": F.when(S.error_type(col("status"), col("message")).isin(S.RETRYABLE), S.backoff_ms(col("attempt"))).otherwise(0),
        }
    ),
    "s12_days_since": lambda spark, d: table(spark, d, "leads").select("lead_id", S.days_since(col("replied_at"), NOW).alias("days")),
    "s22_resume": lambda spark, d: table(spark, d, "leads").select(
        "lead_id", S.resume_stage().alias("resume"), S.is_terminal(col("stage")).alias("terminal"), S.can_advance(col("stage"), F.lit("REPLIED")).alias("may_reply"),
        F.array_join(F.transform(F.filter(S.progress(), lambda p: p["done"]), lambda p: p["step"]), ", ").alias("done"),
    ),
    "s22_stage": lambda spark, d: table(spark, d, "leads").select("lead_id", S.stage_position(col("stage")).alias("position"), S.next_stage(col("stage")).alias("following")),
}

_KIND = r"""case when status = 429 then 'rate_limit' when status = 408 or regexp_matches(message, '(?i)timeout|etimedout|esockettimedout|aborted') then 'timeout'
  when status in (401, 403) then 'auth' when status in (400, 422) then 'validation' when status >= 500 then 'provider_error'
  when regexp_matches(message, '(?i)econnreset|enotfound|econnrefused|socket hang up|network') then 'network'
  when regexp_matches(message, '(?i)schema|json|unexpected token|failed to parse') then 'ai_schema'
  when regexp_matches(message, '(?i)rate limit|too many requests|quota') then 'rate_limit' else 'unknown' end"""
_RETRYABLE = f"k in {_list(S.RETRYABLE)}"
_STAGE_CASE = "case stage " + " ".join(f"when '{s}' then {p}" for s, p, _ in S.STAGES) + " else -1 end"
_NEXT = [s for s, p, _ in S.STAGES if p <= 90]
_SEED = "list_reduce(list_prepend(5381::bigint, list_transform(list_filter(string_split(coalesce(email, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)), lambda h, x: (h * 33 + x) % 4294967296)"

ORACLES: dict[str, str] = {
    "s01_text": with_sql(r"select id, strip_accents(name) as folded, trim(regexp_replace(name, '\s+', ' ', 'g')) as squeezed from raw"),
    "s02_clean_name": with_sql(f"select id, {_clean('name')} as clean from raw"),
    "s03_name_key": with_sql(f"select id, {_key('name')} as key from raw"),
    "s04_handle": with_sql(f"select id, {_handle('handle')} as handle_key, 'https://www.instagram.com/' || {_handle('handle')} || '/' as profile from raw"),
    "s05_url": with_sql("select id, url from raw").replace(" select id, url from raw", f", {_URLS} select id, url from v"),
    "s06_domain": with_sql("select id from raw").replace(" select id from raw", f", {_URLS} select id, {_DOMAIN} as domain, coalesce(bare in {_list(S.SHARED_HOSTS)}, false) as shared from v"),
    "s07_phone": with_sql(f"select id, {_PHONE} as e164 from raw"),
    "s08_email": with_sql(f"select id, {_EMAIL} as address from raw"),
    "s09_state": with_sql(f"select id, {_STATE} as code from raw"),
    "s10_city": with_sql(f"select id, case when length({_CITY}) >= 2 then {_CITY} end as town, substr(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '', 'g'), 1, 40) as slug from raw"),
    "s11_count": with_sql(f"select id, {_COUNTED} as n from raw"),
    "s13_products": with_sql(
        r"select id, coalesce(array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '|'), '') as items from (select id,"
        r" list_filter(list_transform(regexp_split_to_array(products, '[,;|\n]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) between 2 and 120) as p from raw) t"
    ),
    "s14_term_hits": with_sql(
        "select id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(coalesce(bio, '')), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') then '{t}' end" for t in TERMS) + "], lambda x: x is not null), '|') as hits from raw"
    ),
    "s15_name_similarity": with_sql(
        f"select id, round(case when a is null or b is null then 0.0 when a = b then 1.0 else greatest(0.0, least(1.0, 0.5 * (1 - levenshtein(a, b) / greatest(length(a), length(b)))"
        " + 0.5 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))::double / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))))) end, 9) as similarity"
        f" from (select x.id, x.k as a, y.k as b from (select id, {_key('name')} as k from raw) x join (select id - 35 as id, {_key('name')} as k from raw) y on x.id = y.id) t"
    ),
    "s16_wording_seed": with_sql(f"select id, s as seed, ['a', 'b', 'c'][(s % 3 + 1)::int] as opener from (select id, {_SEED} as s from raw) t"),
    "s20_role": with_sql(
        "select id, case when title is null or title = '' then 'unknown' " + " ".join(f"when regexp_matches(title, '(?i){p}') then '{r}'" for r, p in S.ROLES) + " else 'other' end as role from raw"
    ),
    "s21_retry": with_sql(
        f"select id, k as kind, {_RETRYABLE} and attempt < 3 as retry, case when {_RETRYABLE} then cast(least(300000, 2000 * 2 ** greatest(0, attempt - 1)) as bigint) else 0 end as delay_ms from (select *, {_KIND} as k from raw) t"
    ),
    "s12_days_since": with_sql(f"select lead_id, cast(floor((epoch(timestamp '{NOW}') - epoch(replied_at)) / 86400) as bigint) as days from leads"),
    "s22_resume": with_sql(
        "select lead_id, case when cleaned_at is null then 'CLEANED' when enriched_at is null then 'ENRICHED' when qualified_at is null then 'QUALIFIED' when not qualified then null when researched_at is null then 'RESEARCHED'"
        " when message_generated_at is null then 'MESSAGE_GENERATED' when approved_at is null then 'PENDING_APPROVAL' when first_sent_at is null then 'READY_FOR_OUTREACH' end as resume,"
        f" stage in ('NOT_INTERESTED', 'CLOSED', 'DISQUALIFIED') as terminal, {_STAGE_CASE} <= 100 as may_reply, concat_ws(', ', 'Scraped', case when cleaned_at is not null then 'Cleaned' end,"
        " case when enriched_at is not null then 'Enriched' end, case when qualified_at is not null then 'Qualified' end, case when researched_at is not null then 'AI Research' end,"
        " case when message_generated_at is not null then 'Message Generated' end, case when approved_at is not null then 'Approved' end, case when first_sent_at is not null then 'Sent' end,"
        " case when replied_at is not null then 'Replied' end) as done from leads"
    ),
    "s22_stage": with_sql(f"select lead_id, {_STAGE_CASE} as position, case stage " + " ".join(f"when '{a}' then '{b}'" for a, b in zip(_NEXT, _NEXT[1:])) + " end as following from leads"),
}
