"""Contacts, accounts, routes, threads and hashtags, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions import scalars as S
from leadspark.operators import outreach as O
from leadspark.operators import people as P
from leadspark.operators import search as SE
from leadspark.plans import scalar_queries as Q
from leadspark.plans.research_queries import PAGES, _q

c = F.col
_TEAM = """concat(html, case page_id % 6
 when 0 then '<h2>Sarah Mitchell, Founder and owner.</h2> write to sarah.m@glow.co or info@glow.co (312) 555-0147'
 when 1 then '<p>Director of care: John Smith.</p> john@glow.co &nbsp; 312.555.0148 SARAH MITCHELL - Manager'
 when 2 then '<h3 class="product-title"> Deep  Facial </h3><a class="x service" href="/">botox, mini</a> "title": "Deep facial"'
 when 3 then '<meta name="description" content=" All  you need "> Dr. - Ann Mary Lee; Head of sales teams: Bo Lu' else '' end)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("cast(floor(page_id / 5) as bigint) as lead_id", "page_id % 5 as page_no", f"{_TEAM} as html", f"{PAGES['ok']} as ok")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_contacts(_pages(spark, sf_dir))[0]


def _company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_contacts(_pages(spark, sf_dir))[1].withColumn("products", F.array_join("products", "; "))


_PEOPLE = """array(named_struct('name', case when c_custkey % 3 = 0 then c_name end, 'first_name', 'Jo', 'last_name', case when c_custkey % 4 = 0 then 'Doe' end,
  'title', case c_custkey % 4 when 0 then 'Owner' when 1 then 'CEO' when 2 then 'Barista' end, 'seniority', 'c',
  'email', case c_custkey % 4 when 0 then 'jo@shop.co' when 1 then 'email_not_unlocked@domain.com' when 2 then '' end, 'phone_numbers', case when c_custkey % 5 = 0 then array(c_name) else array() end, 'linkedin_url', 'l'),
  named_struct('name', null, 'first_name', null, 'last_name', null, 'title', null, 'seniority', null, 'email', null, 'phone_numbers', null, 'linkedin_url', null))"""


def _provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as company_id", f"{_PEOPLE} as people")
    return P.provider_contacts(rows)


_KNOWN = "l_orderkey as company_id, cast(floor(l_extendedprice) as bigint) * 10000000 + l_partkey * 100 + l_linenumber as seq, concat('Name ', cast(l_partkey % 3 as string)) as full_name, case when l_partkey % 4 <> 0 then concat('M', cast(l_partkey % 3 as string), '@x.co') end as email, l_linestatus as title"
_FOUND = "l_orderkey as company_id, cast(floor(l_extendedprice) as bigint) * 10000000 + l_partkey * 100 + l_linenumber + 10 as seq, concat('Name ', cast(l_suppkey % 3 as string)) as full_name, case when l_suppkey % 3 <> 0 then concat('m', cast(l_suppkey % 3 as string), '@x.co') end as email, l_returnflag as title"


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cut = lambda e: lines.selectExpr(*_split(e))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as company_id", "concat('Name ', cast(o_custkey % 4 as string)) as full_name")
    return P.upsert_contacts(cut(_KNOWN), cut(_FOUND), orders)


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for x in columns:
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append("")
        else:
            out[-1] += x
    return out


_REPLIES = """event_id, event_id % 5 <> 0 as usable, case event_id % 9 when 0 then 'opt_out' when 1 then 'not_interested' when 2 then 'maybe_later' when 3 then 'auto_reply' when 4 then 'pricing' when 5 then 'interested' when 6 then 'wrong_person' else 'question' end as classification,
 event_type as intent, 'positive' as sentiment, 'high' as urgency, 'reply' as recommended_action, 'INTERESTED' as suggested_stage, event_id % 4 = 0 as requires_human, event_id % 8 = 0 as stop_followups, case when event_id % 7 <> 0 then event_id % 3 = 0 end as needs_review"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.route_replies(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_split(_REPLIES)))


_MESSAGES = "conv_id, turn as id, timestamp '2024-01-01 00:00:00' + (turn % 3) * interval '1' hour as sent_at, case when role = 'user' then 'inbound' else 'outbound' end as direction"
_THREADS = "conv_id, cast(conv_id % 4 as bigint) as message_count, timestamp '2023-01-01 00:00:00' as last_message_at, 'outbound' as last_direction, case conv_id % 3 when 0 then 'AWAITING_US' when 1 then 'AWAITING_PROSPECT' else 'CLOSED' end as state"


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    threads = rows.select("conv_id").distinct().selectExpr(*_split(_THREADS))
    return O.apply_messages(threads, rows.where("turn > 0 and conv_id % 10 <> 7").selectExpr(*_split(_MESSAGES)))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = "array('#medspa{city_slug}', '#glow', '#medspa', '#glow', '{city_slug}botox')"
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as campaign_id", f"case when c_custkey % 3 = 0 then array() when c_custkey % 3 = 1 then array('San José', 'la') else array(c_name, 'L.A', 'la') end as cities", f"{tags} as tags")
    return SE.hashtags(rows)


_ACCOUNT_LEADS = {
    "lead_id": "c_custkey",
    "company_name": "concat('Glow Spa ', cast(c_custkey % 7 as string))",
    "domain": "case c_custkey % 5 when 0 then 'glowspa.com' when 1 then 'ab.com' when 2 then concat('shop', cast(c_custkey as string), '.co') when 3 then 'blue-river.com' end",
    "instagram": "case c_custkey % 4 when 0 then '@Own.Account' when 1 then 'explore' end",
    "contact_name": "case when c_custkey % 2 = 0 then 'Jane Doe' end",
    "website_reachable": "c_custkey % 6 <> 0",
    "first_url": "case when c_custkey % 6 <> 0 then 'https://glow.example/' end",
    "source_file": "'leads.csv'",
    "original_row": "c_custkey + 2",
    "one": "case c_custkey % 11 when 0 then 'glowspa' when 1 then 'jane.doe' when 2 then 'https://instagram.com/p/xyz' when 3 then 'reels' when 4 then 'glow.spa' when 5 then 'other_brand' end",
    "two": "case c_custkey % 13 when 0 then 'jane_doe' when 1 then 'Glowspa' when 2 then 'third_place' when 3 then 'jane.doe' end",
}


def _account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*(f"{e} as {n}" for n, e in _ACCOUNT_LEADS.items()))
    found = P.accounts(rows.withColumn("instagrams", F.array_compact(F.array("one", "two"))).drop("one", "two"))
    names = ["business_instagram", "instagram_confidence", "instagram_evidence", "instagram_candidate", "owner_instagram", "owner_instagram_confidence"]
    return found.select("lead_id", *names, F.array_join("instagram_alternates", "; ").alias("alternates"))


QUERIES = {
    "e01_people": _people, "e01_company_facts": _company, "io04_provider_contacts": _provider, "d10_upsert_contacts": _upserts,
    "l10_route_replies": _routes, "l12_thread_counters": _threads, "p06_hashtags": _tags, "e05_accounts": _account_rows,
}

_ROLES = lambda t: f"case when {t} is null or {t} = '' then 'unknown' " + " ".join(f"when regexp_matches({t}, '(?i){p}') then '{r}'" for r, p in S.ROLES) + " else 'other' end"
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_PLAIN = r"trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>', ' ', 'gi'), '<style[\s\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'gi'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"


def _zip(i: int) -> str:
    p, name, title = P.PEOPLE[i]
    return (
        f"select lead_id, page_no, {i} as pat, unnest(regexp_extract_all(body, {_q(p)}, {name})) as name, unnest(regexp_extract_all(body, {_q(p)}, {title})) as title,"
        f" unnest(range(len(regexp_extract_all(body, {_q(p)}, {name})))) as pos from pg"
    )


_PG = f"""pg as (select *, {_PLAIN} as body from (select cast(floor(page_id / 5) as bigint) as lead_id, page_id % 5 as page_no, {_TEAM} as html, {PAGES["ok"]} as ok from pages) t where ok and html is not null),
 em as (select lead_id, email, min(page_no * 100000 + pos) as spot from (select lead_id, page_no, pos, {Q._EMAIL} as email from (select lead_id, page_no, unnest(regexp_extract_all(body, {_q(P.MAIL)})) as email,
   unnest(range(len(regexp_extract_all(body, {_q(P.MAIL)})))) as pos from pg) t) t where email is not null group by 1, 2),
 ph as (select lead_id, phone, min(page_no * 100000 + pos) as spot from (select lead_id, page_no, pos, {Q._PHONE} as phone from (select lead_id, page_no, unnest(regexp_extract_all(body, {_q(P.PHONE)})) as phone,
   unnest(range(len(regexp_extract_all(body, {_q(P.PHONE)})))) as pos from pg) t) t where phone is not null group by 1, 2)"""
_GOODS = " union all ".join(
    f"select lead_id, page_no, {i} as pat, unnest(regexp_extract_all(html, {_q(p)}, 1)) as label, unnest(range(len(regexp_extract_all(html, {_q(p)}, 1)))) as pos from pg" for i, p in enumerate(P.PRODUCTS)
)
_DESC = r"""<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']+)["'']"""
_UPSERT_KEY = "coalesce('@' || lower(email), '#' || lower(full_name), '?' || seq)"
_BAD = ", ".join(f"'{x}'" for x in P.NOT_ACCOUNTS)
_SLUG = lambda x: f"left(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '', 'g'), 40)"
_ALIKE = lambda a, b: (
    f"case when {a} is null or {b} is null then 0.0 when {a} = {b} then 1.0 else 0.5 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
    f" + 0.5 * len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))::double / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))) end"
)
_MEETS = lambda x: f"(coalesce({x}, '') <> '' and (contains(bare, {x}) or contains({x}, bare)))"
_ACCOUNTS = f"""with k as (select {", ".join(f"{e} as {n}" for n, e in _ACCOUNT_LEADS.items())} from customer),
 l as (select *, {Q._key("company_name")} as key, {Q._key("contact_name")} as who, {_SLUG("split_part(coalesce(domain, ''), '.', 1)")} as guess from k),
 v as (select lead_id, min(pos) as pos, h from (select lead_id, 1 as pos, {Q._handle("one")} as h from k union all select lead_id, 2, {Q._handle("two")} from k) t where h not in ({_BAD}) and length(h) >= 3 group by lead_id, h),
 g as (select lead_id, h as given from (select lead_id, {Q._handle("instagram")} as h from k) t where h not in ({_BAD}) and length(h) >= 3),
 w as (select lead_id, pos, h, regexp_replace(h, '[._]', '', 'g') as bare, {Q._key("regexp_replace(h, '[._]', ' ', 'g')")} as hk from v),
 x as (select w.*, case when {_MEETS("guess")} then 3 else 0 end + case when {_MEETS(_SLUG("key"))} then 2 else 0 end + {_ALIKE("hk", "key")} as score, {_ALIKE("hk", "who")} >= 0.6 as person from w join l using (lead_id)),
 y as (select *, row_number() over (partition by lead_id order by score desc, pos) as place from x),
 z as (select lead_id, count(*) as n, max(h) filter (where place = 1) as best, coalesce(max(score) filter (where place = 1) - max(score) filter (where place = 2) >= 1.5, true) as clear,
   string_agg(h, ', ' order by place) as names, string_agg(h, '; ' order by place) filter (where place > 1) as others, arg_min(h, pos) filter (where person and place > 1) as own from y group by lead_id),
 r as (select l.*, given, coalesce(n, 0) as n, best, clear, names, others, own, domain is not null and length(guess) >= 3 as guessed, coalesce(first_url, 'https://' || domain, 'null') as url from l left join z using (lead_id) left join g using (lead_id))
 select lead_id, coalesce(best, given) as business_instagram, case when n > 0 and clear then 'HIGH' when n > 1 or given is not null then 'MEDIUM' when guessed then 'LOW' else 'NOT_FOUND' end as instagram_confidence,
   case when n = 1 then 'Linked from the company''s own website (' || url || ').'
    when n > 1 and clear then 'Linked from the company''s own website (' || url || '); chosen over ' || (n - 1) || ' other linked account(s) because it matches the company name and domain.'
    when n > 1 then 'The website links ' || n || ' Instagram accounts (' || names || ') and none clearly belongs to the business over the others. Needs a human to pick.'
    when given is not null then 'Supplied in the source file ' || source_file || ' row ' || original_row || '; not confirmed against the company''s website.'
    when guessed then 'No Instagram link found on ' || domain || ' and none in the source file. "@' || guess || '" is a guess from the domain name and has NOT been verified - check it before using it.'
    when domain is not null then 'No Instagram link found on the pages read from ' || domain || case when website_reachable then '' else ' (the site could not be read)' end || ', and none supplied in the source file.'
    else 'No website in the source file and no Instagram supplied, so there was nothing to search.' end as instagram_evidence,
   case when n = 0 and given is null and guessed then guess end as instagram_candidate, case when contact_name is not null then own end as owner_instagram,
   case when contact_name is not null and own is not null then 'MEDIUM' else 'NOT_FOUND' end as owner_instagram_confidence, coalesce(others, '') as alternates from r"""

ORACLES = {
    "e05_accounts": _ACCOUNTS,
    "e01_people": f"""with {_PG}, n as ({_zip(0)} union all {_zip(1)}),
 m as (select lead_id, {_SQUEEZE("name")} as full_name, {_SQUEEZE("title")} as title, page_no * 1000000 + pat * 100000 + pos as spot from n),
 p as (select lead_id, lower(full_name) as low, arg_min(full_name, spot) as full_name, arg_min(title, spot) as title from m where len(string_split(full_name, ' ')) <= 3 group by 1, 2),
 e as (select p.lead_id, low, arg_min(email, spot) as email from p join em using (lead_id) where len([w for w in string_split(low, ' ') if length(w) > 2 and contains(split_part(email, '@', 1), w)]) > 0 group by 1, 2)
 select p.lead_id, full_name, split_part(full_name, ' ', 1) as first_name, split_part(full_name, ' ', -1) as last_name, regexp_replace(title, '^\\W+|\\W+$', '', 'g') as title,
   {_ROLES("title")} as role_category, email, 'website_scrape' as source, cast(0.55 as double) as source_confidence from p left join e using (lead_id, low)""",
    "e01_company_facts": f"""with {_PG}, g as (select lead_id, {_SQUEEZE("label")} as label, page_no * 1000000 + pat * 100000 + pos as spot from ({_GOODS}) t),
 h as (select lead_id, lower(label) as low, arg_min(label, spot) as label, min(spot) as spot from g where length(label) between 2 and 120 group by 1, 2),
 d as (select lead_id, page_no, nullif(left({_SQUEEZE(f"regexp_extract(html, '{_DESC}', 1, 'i')")}, 400), '') as told from pg)
 select l.lead_id, (select arg_min(told, page_no) from d where d.lead_id = l.lead_id) as website_description, (select arg_min(email, spot) from em where em.lead_id = l.lead_id) as email,
   (select arg_min(phone, spot) from ph where ph.lead_id = l.lead_id) as phone_e164, coalesce((select string_agg(label, '; ' order by spot) from h where h.lead_id = l.lead_id), '') as products
 from (select distinct lead_id from pg) l""",
    "io04_provider_contacts": f"""with r as (select c_custkey as company_id, 0 as seq, case when c_custkey % 3 = 0 then c_name when c_custkey % 4 = 0 then 'Jo Doe' else 'Jo' end as full_name, 'Jo' as first_name,
   case when c_custkey % 4 = 0 then 'Doe' end as last_name, case c_custkey % 4 when 0 then 'Owner' when 1 then 'CEO' when 2 then 'Barista' end as title, 'c' as seniority,
   case when c_custkey % 4 = 0 then 'jo@shop.co' end as email, case when c_custkey % 5 = 0 then c_name end as phone, 'l' as linkedin_url, case when c_custkey % 4 in (0, 1) then 0.9 else 0.7 end as source_confidence from customer
   union all select c_custkey, 1, null, null, null, null, null, null, null, null, 0.7 from customer)
 select company_id, seq, full_name, first_name, last_name, title, {_ROLES("title")} as role_category, seniority, email, phone, linkedin_url, 'apollo' as source, cast(source_confidence as double) as source_confidence from r""",
    "d10_upsert_contacts": f"""with b as (select *, 0 as fresh from (select {_KNOWN} from lineitem) t union all select *, 1 from (select {_FOUND} from lineitem) t),
 r as (select * from b qualify row_number() over (partition by company_id, {_UPSERT_KEY} order by fresh desc, seq) = 1),
 w as (select r.*, r.full_name = 'Name ' || (o_custkey % 4) as chosen from r join orders on o_orderkey = company_id)
 select company_id, seq, full_name, email, title, chosen and seq = min(case when chosen then seq end) over (partition by company_id) as "primary" from w""",
    "l10_route_replies": f"""with r as (select {_REPLIES} from events), s as (select * replace ("""
    + ", ".join(f"case when usable then {k} else '{v}' end as {k}" for k, v in O.UNUSABLE.items())
    + """, case when usable then requires_human else true end as requires_human, case when usable then stop_followups else true end as stop_followups) from r)
 select *, not usable as fallback, case classification when 'opt_out' then 'opt_out' when 'not_interested' then 'NOT_INTERESTED' when 'maybe_later' then 'NURTURE' when 'auto_reply' then 'none' else 'assistant' end as route,
   coalesce(needs_review, true) or classification in ('pricing', 'objection', 'opt_out', 'wrong_person', 'not_interested') as requires_human_review from s""",
    "l12_thread_counters": f"""with t as (select {_THREADS} from (select distinct conv_id from conversations) d), m as (select {_MESSAGES} from conversations where turn > 0 and conv_id % 10 <> 7),
 n as (select conv_id, count(*) as n, max(sent_at) as at_time, arg_max(direction, (sent_at, id)) as last, bool_or(direction = 'inbound') as any_in from m group by 1)
 select t.conv_id, message_count + coalesce(n, 0) as message_count, coalesce(at_time, last_message_at) as last_message_at, coalesce(last, last_direction) as last_direction,
   case when last = 'inbound' then 'AWAITING_US' when last = 'outbound' and (any_in or state = 'AWAITING_US') then 'AWAITING_PROSPECT' else state end as state from t left join n using (conv_id)""",
    "p06_hashtags": """with k as (select c_custkey as campaign_id, case when c_custkey % 3 = 0 then [] when c_custkey % 3 = 1 then ['sanjose', 'la'] else [left(regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g'), 40), 'la', 'la'] end as cities from customer),
 x as (select campaign_id, 0 as i, '#medspa' || unnest(cities) as tag, unnest(range(len(cities))) as j from k union all select campaign_id, 1, '#glow', 0 from k union all select campaign_id, 2, '#medspa', 0 from k
   union all select campaign_id, 4, unnest(cities) || 'botox', unnest(range(len(cities))) from k)
 select campaign_id, tag, cast(min(i * 100 + j) // 100 as int) as i, cast(min(i * 100 + j) % 100 as int) as j from x group by 1, 2""",
}
