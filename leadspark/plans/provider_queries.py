"""Provider rows as JSON, derived from `customer`, with SQL over the columns they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.plans.inputs import table
from leadspark.sources import providers as P

c = F.col


def _bodies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Maps rows (by odd ids) and account rows, each with the field names of its provider."""
    raw = table(spark, sf_dir, "raw")
    maps = F.to_json(F.struct(
        c("id").alias("fid"), c("name").alias("title"), F.when(c("id") % 2 == 1, c("website")).alias("website"), c("phone"), F.struct(c("state"), c("city")).alias("address"),
        F.when(c("id") % 3 == 0, F.array(c("email"))).alias("emails"), F.array(F.struct(c("category").alias("name"))).alias("categories"), F.struct((c("id") % 90).alias("lat")).alias("location"),
    ))
    accounts = F.to_json(F.struct(c("name").alias("fullName"), c("handle").alias("username"), c("bio").alias("biography"), c("followers").alias("followersCount"), (c("id") % 2 == 0).alias("verified"), c("products").alias("services")))
    return {"google_maps": raw.where("id % 2 = 1").select("id", maps.alias("body")), "instagram_search": raw.where("id % 2 = 0").select("id", accounts.alias("body"))}


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = P.discovered(_bodies(spark, sf_dir))
    return out.select("source", "business_name", "instagram_handle", "website_domain", "phone_e164", "email", "state", "city", "place_id", "latitude", "bio", "ig_followers", "ig_is_verified", F.array_join("products_services", "|").alias("products"), "products_count")


QUERIES = {"io3_provider_leads": _leads}


def _sql() -> str:
    from leadspark.plans.lead_queries import _LEADS

    maps = "id % 2 = 1"
    label = "trim(regexp_replace(category, '\\s+', ' ', 'g'))"
    return f"""{_LEADS} select * from (select case when {maps} then 'google_maps' else 'instagram_search' end as source, business_name, case when not {maps} then h end as instagram_handle, case when {maps} then domain end as website_domain,
      case when {maps} then phone_e164 end as phone_e164, case when {maps} and id % 3 = 0 then address end as email, case when {maps} then st end as state, case when {maps} then town end as city,
      case when {maps} then cast(id as varchar) end as place_id, case when {maps} then cast(id % 90 as double) end as latitude, case when not {maps} then bio end as bio, case when not {maps} then n end as ig_followers,
      case when not {maps} then id % 2 = 0 end as ig_is_verified,
      case when {maps} then coalesce(case when length({label}) between 2 and 120 then {label} end, '') else array_to_string(prods, '|') end as products,
      cast(nullif(case when {maps} then case when length({label}) between 2 and 120 then 1 else 0 end else len(prods) end, 0) as bigint) as products_count
      from lead2) x where business_name is not null or instagram_handle is not null"""


ORACLES = {"io3_provider_leads": _sql()}
