"""Lead tables derived from the given tables, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.components import dealt

Named = dict[str, str]

#: Messy rows as scrapers deliver them.
RAW: Named = {
    "id": "c_custkey",
    "name": "concat(case c_custkey % 5 when 0 then 'Glow ' when 1 then 'THE  Bright ' when 2 then 'Café ' when 3 then 'É ' else '' end, c_name,"
    " case c_custkey % 7 when 0 then ' LLC' when 1 then ', Inc.' when 2 then ' Med Spa & Co' when 3 then ' | Official Shop' when 4 then ' Day Spa' when 5 then ' – USA' else '' end)",
    "handle": "case c_custkey % 7 when 0 then concat('@', c_name) when 1 then concat('https://www.instagram.com/shop.', cast(c_custkey % 300 as string), '/?hl=en')"
    " when 2 then 'instagram.com/p/xyz' when 3 then 'not a handle!' when 4 then concat('shop_', cast(c_custkey % 300 as string)) when 5 then null else '' end",
    "website": "case c_custkey % 8 when 0 then concat('HTTP://WWW.Shop', cast(c_custkey % 400 as string), '.com/about//?utm_source=x&id=3#top')"
    " when 1 then concat('shop', cast(c_custkey % 400 as string), '.com') when 2 then 'https://linktr.ee/me' when 3 then 'n/a' when 4 then 'http://bad_host/x'"
    " when 5 then concat('https://shop', cast(c_custkey % 400 as string), '.co.uk:8080/a?ref=1&b=2') when 6 then null else '-' end",
    "phone": "case c_custkey % 6 when 0 then concat('(', cast(200 + c_custkey % 700 as string), ') 555-', cast(1000 + c_custkey % 900 as string))"
    " when 1 then concat('+44 20 7946 ', cast(1000 + c_custkey % 50 as string)) when 2 then '5555555555' when 3 then concat('1-312-555-', cast(1000 + c_custkey % 40 as string))"
    " when 4 then 'call us' else null end",
    "email": "case c_custkey % 5 when 0 then concat(' Info', cast(c_custkey % 200 as string), '@Shop.COM ') when 1 then 'mailto:owner@shop.co' when 2 then 'noreply@shop.com' when 3 then 'broken@' else null end",
    "state": "case c_custkey % 8 when 0 then 'California' when 1 then 'tx' when 2 then ' New York ' when 3 then 'Calif.' when 4 then 'wash' when 5 then 'Ontario' when 6 then 'new' else null end",
    "city": "case c_custkey % 6 when 0 then 'los angeles' when 1 then 'St. PAUL' when 2 then 'ft worth' when 3 then 'san josé' when 4 then 'x' else 'la jolla!' end",
    "followers": "case c_custkey % 6 when 0 then '12.3k' when 1 then '2.1M' when 2 then '1,234' when 3 then cast(c_custkey * 7 % 30000 as string) when 4 then 'many' else null end",
    "products": "case c_custkey % 4 when 0 then 'Botox, Filler; botox |Facial' when 1 then 'a' when 2 then concat(c_mktsegment, ',', lower(c_mktsegment), ', Item ', cast(c_custkey % 9 as string)) else null end",
    "bio": "case c_custkey % 9 when 0 then 'Mom of two, my name is Jo' when 1 then 'Best SEO agency and call center' when 2 then 'botox and fillers, dm to order' when 3 then 'Content creator'"
    " when 4 then 'medspa marketing agency' when 5 then 'a fan page' when 6 then 'Aesthetics since 1999' else concat('We sell ', lower(c_mktsegment)) end",
    "category": "case c_custkey % 4 when 0 then 'Medical spa' when 1 then 'Skin clinic' when 2 then c_mktsegment else null end",
    "title": "case c_custkey % 10 when 0 then 'Co-Founder & CEO' when 1 then 'Practice Owner' when 2 then 'President' when 3 then 'Director of Operations' when 4 then 'CX lead'"
    " when 5 then 'Customer Service Manager' when 6 then 'Growth Manager' when 7 then 'Barista' when 8 then '' else null end",
    "status": "case c_custkey % 9 when 0 then 429 when 1 then 408 when 2 then 401 when 3 then 422 when 4 then 503 when 5 then 200 else null end",
    "message": "case c_custkey % 7 when 0 then 'ECONNRESET by peer' when 1 then 'Unexpected token in JSON' when 2 then 'quota reached' when 3 then 'ETIMEDOUT' else 'odd' end",
    "attempt": "cast(c_custkey % 5 + 1 as int)",
    "posts": "cast(c_custkey % 40 as int)",
    "following": "cast(c_custkey * 13 % 90000 as int)",
    "niche": "case c_custkey % 2 when 0 then 'medspas' else 'dental_clinics' end",
}

#: One lead for each order; its steps' days follow from the key.
LEADS: Named = {
    "lead_id": "o_orderkey",
    "company_id": "o_custkey",
    "campaign_id": "o_orderpriority",
    "stage": "case when o_orderkey % 11 = 0 then 'DISQUALIFIED' when o_orderkey % 13 = 0 then 'INTERESTED' when o_orderkey % 17 = 0 then 'NURTURE' when o_orderkey % 19 = 0 then 'NOT_INTERESTED'"
    " when o_orderstatus = 'O' then 'DM_SENT' when o_orderstatus = 'F' then 'REPLIED' else 'QUALIFIED' end",
    "status": "case o_orderkey % 5 when 0 then 'NEW' when 1 then 'PROCESSING' when 2 then 'ERROR' when 3 then 'REPLIED' else 'OPTED_OUT' end",
    "discovered_at": "o_orderdate",
    "cleaned_at": "case when o_orderkey % 10 < 9 then o_orderdate + interval '1' day end",
    "enriched_at": "case when o_orderkey % 10 < 8 then o_orderdate + interval '2' day end",
    "qualified_at": "case when o_orderkey % 10 < 7 then o_orderdate + interval '3' day end",
    "qualified": "case when o_orderkey % 10 < 7 then o_orderkey % 3 <> 0 end",
    "researched_at": "case when o_orderkey % 10 < 6 then o_orderdate + interval '4' day end",
    "message_generated_at": "case when o_orderkey % 10 < 5 then o_orderdate + interval '5' day end",
    "approved_at": "case when o_orderkey % 10 < 4 then o_orderdate + interval '6' day end",
    "first_sent_at": "case when o_orderkey % 10 < 3 then o_orderdate + interval '7' day end",
    "replied_at": "case when o_orderkey % 20 < 3 then o_orderdate + interval '9' day end",
    "icp_score": "case when o_orderkey % 6 <> 0 then cast(o_orderkey * 37 % 101 as int) end",
    "retry_count": "cast(o_orderkey % 4 as int)",
    "updated_at": "o_orderdate + interval '8' day",
}

#: One message draft for each order line.
OUTREACH: Named = {
    "lead_id": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "kind": "case l_linenumber when 1 then 'initial' when 2 then 'followup_1' when 3 then 'followup_2' else 'followup_3_final' end",
    "variation": "l_returnflag",
    "angle": "case l_suppkey % 3 when 0 then 'speed' when 1 then 'after_hours' else null end",
    "status": "case when l_linestatus = 'O' and l_partkey % 2 = 0 then 'APPROVED' when l_linestatus = 'O' then 'PENDING_REVIEW' else 'SENT' end",
    "created_at": "l_shipdate",
    "sent_at": "case when l_linestatus = 'F' then l_shipdate + interval '1' day end",
    "cost": "cast(l_extendedprice * 100 as bigint)",
}

COMPANIES: Named = {
    "company_id": "c_custkey",
    "name": "c_name",
    "state": "n_name",
    "niche": "c_mktsegment",
    "followers": "cast(floor(abs(c_acctbal)) * 3 as bigint)",
    "website_domain": "case when c_custkey % 3 <> 0 then concat('shop', cast(c_custkey % 60 as string), '.com') end",
    "phone": "case when c_custkey % 4 <> 0 then concat('+1', cast(2000000000 + c_custkey % 700 as string)) end",
}

EVENTS: Named = {
    "event_id": "event_id",
    "sent_at": "ts",
    "lead_id": "user_id",
    "kind": "event_type",
    "classification": "case event_id % 7 when 0 then 'interested' when 1 then 'pricing' when 2 then 'unclear' when 3 then 'complaint' when 4 then 'not_now' else null end",
    "direction": "case when event_id % 3 = 0 then 'outbound' else 'inbound' end",
    "objection": "case event_id % 5 when 0 then 'price' when 1 then 'timing' else null end",
    "value": "value",
}

#: Campaigns that no lead belongs to yet, one of them at rest.
QUIET: Named = {"campaign_id": "r_name", "status": "case when r_name = 'ASIA' then 'paused' else 'active' end"}

#: The whole view of leads: what LEADS and COMPANIES leave out, and the tables beside them.
FULL_LEADS: Named = LEADS | {
    "public_ref": "o_orderkey * 3 + 1",
    "contact_id": "case when o_orderkey % 3 <> 0 then o_custkey end",
    "icp_band": "case o_orderkey % 4 when 0 then 'HIGH_PRIORITY' when 1 then 'QUALIFIED' when 2 then 'REVIEW' end",
    "priority": "case o_orderkey % 3 when 0 then 'high' when 1 then 'low' end",
    "disqualified_reason": "case when o_orderkey % 11 = 0 then 'outside_target_niche' end",
    "recommended_service": "case when o_orderkey % 5 = 0 then 'Live chat' end",
    "outreach_angle": "case when o_orderkey % 6 = 0 then 'speed' end",
    "next_followup_at": "case when o_orderkey % 4 = 1 then o_orderdate + interval '12' day end",
    "followup_step": "cast(o_orderkey % 4 as int)",
    "last_error": "case when o_orderkey % 8 = 0 then 'timeout' end",
    "cleaning_flags": "case when o_orderkey % 9 = 0 then 'suspected_reseller' end",
    "notes": "case when o_orderkey % 10 = 0 then concat('note ', cast(o_orderkey as string)) end",
    "sheets_synced_at": "case when o_orderkey % 2 = 0 then o_orderdate + interval '20' day end",
}
FULL_COMPANIES: Named = {
    "company_id": "c_custkey",
    "name": "c_name",
    "instagram_handle": "case when c_custkey % 4 <> 0 then concat('shop.', cast(c_custkey as string)) end",
    "instagram_url": "case when c_custkey % 4 <> 0 then concat('https://instagram.com/shop.', cast(c_custkey as string)) end",
    "website": "case when c_custkey % 3 <> 0 then concat('https://shop', cast(c_custkey % 60 as string), '.com/') end",
    "website_domain": "case when c_custkey % 3 <> 0 then concat('shop', cast(c_custkey % 60 as string), '.com') end",
    "niche_id": "lower(c_mktsegment)",
    "state": "n_name",
    "city": "case when c_custkey % 5 <> 0 then concat('City ', cast(c_custkey % 40 as string)) end",
    "ig_followers": "cast(c_custkey * 31 % 9000 as bigint)",
    "ig_posts": "cast(c_custkey % 70 as int)",
    "products_count": "cast(c_custkey % 12 as int)",
    "products_services": "concat('item ', cast(c_custkey % 12 as string))",
    "email": "case when c_custkey % 2 = 0 then concat('info', cast(c_custkey as string), '@shop.com') end",
    "phone": "case when c_custkey % 4 <> 0 then concat('+1', cast(2000000000 + c_custkey % 700 as string)) end",
    "ig_last_post_at": "case when c_custkey % 6 <> 0 then timestamp '1996-01-01 00:00:00' end",
}
CONTACTS: Named = {
    "contact_id": "c_custkey",
    "full_name": "concat('Dr ', c_name)",
    "title": "case c_custkey % 3 when 0 then 'Owner' when 1 then 'CEO' end",
    "role_category": "case c_custkey % 3 when 0 then 'owner' when 1 then 'ceo' else 'unknown' end",
    "email": "case when c_custkey % 3 = 0 then concat('dr', cast(c_custkey as string), '@shop.com') end",
    "linkedin_url": "case when c_custkey % 7 = 0 then concat('https://linkedin.com/in/', cast(c_custkey as string)) end",
    "target_reason": "case when c_custkey % 2 = 0 then 'decides' end",
}
#: Histories of a lead; seq is total.
_SEQ = "concat(l_linenumber, ' ', l_partkey, ' ', l_suppkey, ' ', cast(l_extendedprice * 100 as bigint))"
VERDICTS: Named = {"lead_id": "l_orderkey", "created_at": "l_shipdate", "seq": _SEQ, "reason": "concat('fit ', l_partkey, ' by ', l_suppkey)", "first_pain": "case when l_partkey % 4 <> 0 then concat('pain ', l_partkey) end", "odd": "l_linenumber % 2"}
BRIEFS: Named = {"lead_id": "l_orderkey", "created_at": "l_shipdate", "seq": _SEQ, "business_summary": "case when l_partkey % 5 <> 0 then concat('sells ', l_partkey) end", "why_relevant": "concat('asks ', l_suppkey)", "odd": "l_linenumber % 3"}
DRAFTS: Named = {
    "lead_id": "l_orderkey", "created_at": "l_shipdate", "seq": _SEQ, "message": "concat('Hi ', l_partkey)", "variation": "l_returnflag", "status": OUTREACH["status"], "sent_at": OUTREACH["sent_at"],
}
RUNS: Named = {"workflow": "o_orderpriority", "status": "o_orderstatus", "items_ok": "o_orderkey % 50", "items_failed": "o_orderkey % 3", "started_at": "o_orderdate"}

_FROM = {
    "full_leads": (FULL_LEADS, "orders"),
    "full_companies": (FULL_COMPANIES, "customer join nation on c_nationkey = n_nationkey"),
    "contact_rows": (CONTACTS, "customer"),
    "verdicts": (VERDICTS, "lineitem"),
    "briefs": (BRIEFS, "lineitem"),
    "drafts": (DRAFTS, "lineitem"),
    "run_rows": (RUNS, "orders"),
    "raw": (RAW, "customer"),
    "leads": (LEADS, "orders"),
    "outreach": (OUTREACH, "lineitem"),
    "companies": (COMPANIES, "customer join nation on c_nationkey = n_nationkey"),
    "messages": (EVENTS, "events"),
    "quiet": (QUIET, "region"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    named, source = _FROM[name]
    base = source.split()[0]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if name == "raw":
        df = dealt(df, "c_custkey")
    if " join " in source:
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
        df = df.join(nation, df.c_nationkey == nation.n_nationkey)
    return df.selectExpr(*(f"{e} as {n}" for n, e in named.items()))


def with_sql(body: str) -> str:
    """DuckDB SQL with the derived tables ahead of it."""
    import re

    parts = []
    for name, (named, source) in _FROM.items():
        if re.search(rf"\b{name}\b", body):
            parts.append(f"{name} as (select {', '.join(f'{e} as {n}' for n, e in named.items())} from {source})")
    return f"with {', '.join(parts)} {body}" if parts else body
