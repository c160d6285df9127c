"""Cleaning: which leads stay, and each reason why one does not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.functions import scalars as S
from leadspark.operators import niches as N


def _none() -> Column:
    return F.array().cast("array<string>")


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def haystack(*parts: str) -> Column:
    return F.lower(F.concat_ws(" \n ", *(F.coalesce(F.col(p), F.lit("")) for p in parts)))


def personal_score() -> tuple[Column, Column]:
    """Score and signal names of a personal account."""
    bio = F.lower(F.coalesce("bio", F.lit("")))
    signals = [(name, weight, bio.rlike(pattern)) for name, weight, pattern in R.PERSONAL_BIO]
    bare = F.col("website_domain").isNull() & F.col("category").isNull() & (F.size("products_services") == 0)
    signals.append(("no_business_markers", 2, bare))
    score = reduce(lambda a, b: a + b, (F.when(hit, w).otherwise(0) for _, w, hit in signals))
    return score, F.array_compact(F.array(*(F.when(hit, name) for name, _, hit in signals)))


def location_reason(campaign: dict) -> Column:
    city, state = F.lower("city"), F.col("state")
    known = state.isNotNull()
    out = F.when(city.isin(campaign["exclude_cities"]), "city_excluded")
    out = out.when(~known & city.isin(campaign["cities"]), "city_match_state_unknown").when(~known, "location_unknown")
    if campaign["states"]:
        out = out.when(~state.isin(campaign["states"]), "state_outside_target")
    if campaign["cities"]:
        out = out.when(city.isNotNull() & ~city.isin(campaign["cities"]), "state_match_city_outside_list")
    return out.otherwise("state_match")


LOCATION_OK = ["city_match_state_unknown", "state_match_city_outside_list", "state_match"]


def clean_leads(leads: DataFrame, campaign: dict | None = None, bounds: dict | None = None, terms: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Adds reasons, flags and keep; nothing is dropped. `key` is unique; terms: niches as in operators/niches.py
    (the stated ones, if none are given). A row without a niche isn't judged by one."""
    campaign, b = campaign or R.CAMPAIGN, bounds or R.BOUNDS
    terms = N.term_table(leads.sparkSession, R.NICHES) if terms is None else terms
    spoken = leads.withColumn("products_text", F.array_join("products_services", " "))
    spoken = spoken.select(key, "niche", "category", haystack("business_name", "bio", "category", "website_description", "products_text").alias("text"))
    rows = leads.join(N.match_niches(spoken, terms, key), key)
    text = haystack("business_name", "bio", "category", "website_description")
    score, signals = personal_score()
    following = F.col("ig_following") if "ig_following" in leads.columns else F.lit(None).cast("long")
    ratio = (F.col("ig_followers") > 0) & (following / F.nullif("ig_followers", F.lit(0)) > b["max_ratio"])
    rows = rows.withColumns(
        {
            "blocked_terms": S.term_hits(text, R.BLOCKED_TERMS),
            "suspected_reseller": _any(text, R.RESELLER_PATTERNS),
            "follow_ratio_suspicious": F.coalesce(ratio, F.lit(False)),
            "personal_score": score,
            "personal_signals": signals,
            "location_reason": location_reason(campaign),
        }
    ).withColumn("city_outside_list", F.col("location_reason") == "state_match_city_outside_list")
    followers, posts = F.col("ig_followers"), F.col("ig_posts")
    checks = [
        (F.col("business_name").isNull(), "missing_business_name"),
        (F.length("business_name") > b["max_name"], "name_too_long"),
        (F.col("instagram_handle").isNull(), "missing_instagram"),
        (followers < b["min_followers"], "below_absolute_min_followers"),
        (followers > b["max_followers"], "above_absolute_max_followers"),
        (posts < b["min_posts"], "too_few_posts"),
        (F.size("blocked_terms") > 0, "blocked_business_type"),
        (_any(text, R.FAN_PATTERNS), "fan_or_parody_account"),
        (F.col("personal_score") >= R.PERSONAL_THRESHOLD, "personal_account"),
        (F.col("niche").isNotNull() & (F.size("niche_negatives") > 0), "niche_negative_keyword"),
        (F.col("niche").isNotNull() & (F.size("niche_hits") == 0) & (F.size("niche_negatives") == 0), "outside_target_niche"),
        (~F.col("location_reason").isin(LOCATION_OK), "outside_target_location"),
    ]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(c, r) for c, r in checks))))
    return rows.withColumn("keep", F.size("reasons") == 0)


def drop_reasons(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def without_suppressed(companies: DataFrame, suppressions: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Companies with no suppressed key; keys: column -> key type. One equi-join for all kinds."""
    pairs = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key_type"), F.col(c).cast("string").alias("key_value"))) for c, k in keys.items())))
    exploded = companies.select("company_id", F.explode(pairs).alias("k")).select("company_id", "k.*")
    hit = exploded.join(suppressions.select("key_type", "key_value"), ["key_type", "key_value"], "left_semi").select("company_id").distinct()
    return companies.join(hit, "company_id", "left_anti")
