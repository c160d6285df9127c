"""Customers resolved to companies that suppliers stand for, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import companies as CO

c = F.col

ROWS = {
    "seq": "cast(c_custkey as bigint)",
    "instagram_handle": "case c_custkey % 5 when 0 then concat('Shop', cast(c_custkey % 400 as string)) when 1 then '' end",
    "website_domain": "case c_custkey % 4 when 1 then concat('Shop', cast(cast(floor(c_custkey / 3) as int) as string), '.com') when 2 then concat('site', cast(c_custkey % 90 as string), '.com') end",
    "phone_e164": "case when c_custkey % 3 = 0 then concat('+1', cast(cast(floor(c_custkey / 6) as int) as string)) end",
    "email": "case when c_custkey % 7 < 2 then concat('Info', cast(cast(floor(c_custkey / 7) as int) as string), '@shop.co') end",
    "name_normalized": "case when c_custkey % 9 <> 4 then concat('glow ', cast(cast(floor(c_custkey / 2) as int) as string)) end",
    "city": "case c_custkey % 6 when 0 then 'Reno' when 1 then 'reno' when 2 then 'Ames' end",
    "state": "case c_custkey % 5 when 0 then 'nv' when 1 then 'NV' end",
    "bio": "case when c_custkey % 4 = 0 then c_mktsegment end",
    "products_count": "case when c_custkey % 3 <> 1 then cast(c_custkey % 17 as int) end",
    "ig_followers": "case when c_custkey % 2 = 0 then cast(c_custkey * 7 % 3000 as int) end",
}
KNOWN = {
    "company_id": "cast(s_suppkey as bigint)",
    "instagram_handle": "case when s_suppkey % 2 = 0 then concat('shop', cast(s_suppkey * 5 as string)) end",
    "website_domain": "case when s_suppkey % 3 <> 0 then concat('shop', cast(s_suppkey as string), '.com') end",
    "phone_e164": "case when s_suppkey % 4 = 1 then concat('+1', cast(s_suppkey as string)) end",
    "email": "cast(null as string)",
    "name_normalized": "lower(s_name)",
    "city": "case when s_suppkey % 5 = 0 then 'Troy' end",
    "state": "case when s_suppkey % 5 = 0 then 'NY' end",
    "bio": "cast(null as string)",
    "products_count": "cast(s_suppkey % 4 as int)",
    "ig_followers": "cast(null as int)",
}


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda name, named: spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*(f"{e} as {n}" for n, e in named.items()))
    companies = read("supplier", KNOWN)
    # The key table lacks the handles, so those are found by the companies' own columns.
    keys = companies.where("website_domain is not null").select(F.lit("website_domain").alias("key_type"), c("website_domain").alias("key_value"), "company_id")
    return CO.resolve(read("customer", ROWS), companies, keys)


QUERIES = {
    "d05_row_companies": lambda s, d: _resolved(s, d)[0],
    "d05_companies": lambda s, d: _resolved(s, d)[1],
    "d05_new_keys": lambda s, d: _resolved(s, d)[2],
}

_named = lambda named: ", ".join(f"{e} as {n}" for n, e in named.items())
_COLUMNS = [n for n in ROWS if n != "seq"]
_CASED = {"instagram_handle": "lower", "website_domain": "lower", "email": "lower", "state": "upper"}
_SQL = f"""with recursive raw as (select {_named(ROWS)} from customer), old as (select {_named(KNOWN)} from supplier),
  inc as (select seq, {", ".join(f"{_CASED[n]}({n}) as {n}" if n in _CASED else n for n in _COLUMNS)} from raw),
  known as (select 'website_domain' as key_type, website_domain as key_value, company_id from old where website_domain is not null),
  keys as (select * from (
    select seq, 0 as priority, 'instagram_handle' as key_type, instagram_handle as key_value from inc union all select seq, 1, 'website_domain', website_domain from inc
    union all select seq, 3, 'phone_e164', phone_e164 from inc union all select seq, 4, 'email', email from inc
    union all select seq, 5, 'name_city', name_normalized || '|' || coalesce(lower(city), '') || '|' || coalesce(state, '') from inc) k where key_value <> ''),
  firsts as (select key_type, key_value, min(seq) as first_seq from keys group by all),
  hits as (
    select seq, priority, company_id, case when company_id is null then first_seq end as parent
      from keys join firsts using (key_type, key_value) left join known using (key_type, key_value) where company_id is not null or first_seq < seq
    union all select seq, priority + 6, company_id, null from keys join
      (select 'instagram_handle' as key_type, instagram_handle as key_value, company_id from old union all select 'website_domain', website_domain, company_id from old
       union all select 'phone_e164', phone_e164, company_id from old) f using (key_type, key_value)),
  pointer as (select seq, company_id, parent from hits qualify row_number() over (partition by seq order by priority, company_id) = 1),
  up as (select seq, company_id, parent, seq as founder from inc left join pointer using (seq)
    union all select up.seq, p.company_id, p.parent, up.parent from up left join pointer p on p.seq = up.parent where up.parent is not null),
  placed as (select seq, coalesce(company_id, (select max(company_id) from old) + dense_rank() over (partition by company_id is null order by founder)) as company_id from up where parent is null)"""
_FILL = [f"arg_min({n}, seq) filter (where {n} is not null) as {n}" for n in ("instagram_handle", "website_domain", "phone_e164", "email", "city", "state")]
_FILL += [f"arg_max({n}, seq) filter (where {n} is not null) as {n}" for n in ("bio", "ig_followers")]
_FILL += ["first(name_normalized order by seq) as name_normalized", "case when count(*) > 1 then coalesce(greatest(max(products_count), 0), 0) else max(products_count) end as products_count"]

ORACLES = {
    "d05_row_companies": f"{_SQL} select seq, company_id from placed",
    "d05_companies": f"""{_SQL} select company_id, {", ".join(_FILL)} from (
  select company_id, -1 as seq, {", ".join(_COLUMNS)} from old union all select company_id, seq, {", ".join(_COLUMNS)} from inc join placed using (seq)) b group by company_id""",
    "d05_new_keys": f"""{_SQL} select key_type, key_value, arg_min(company_id, seq) as company_id from keys join placed using (seq)
  where (key_type, key_value) not in (select key_type, key_value from known) group by 1, 2""",
}
