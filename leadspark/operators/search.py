"""Search terms of campaigns and batches of prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import scalars as S

c = F.col


def search_terms(campaigns: DataFrame) -> DataFrame:
    """campaigns: (campaign_id, templates, cities, states). One row for each distinct query and
    place, the first of equal ones in any case; `per_term` splits the daily target."""
    t = campaigns.select("*", F.posexplode("templates").alias("i", "template"))
    by_city = c("template").contains("{city") & (F.size("cities") > 0)
    places = F.when(by_city, F.transform("cities", lambda x: F.struct(x.alias("city"), F.get("states", F.lit(0)).alias("state")))).otherwise(
        F.transform("states", lambda x: F.struct(F.lit("").alias("city"), x.alias("state")))
    )
    rows = t.select("campaign_id", "i", "template", F.posexplode(places).alias("j", "p"))
    query = c("template")
    for name, value in (("city_slug", S.slug(c("p.city"))), ("state_slug", S.slug(c("p.state"))), ("city", c("p.city")), ("state", c("p.state"))):
        query = F.replace(query, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    rows = rows.select("campaign_id", "i", "j", S.squeeze(query).alias("query"), F.concat_ws(", ", F.nullif(c("p.city"), F.lit("")), "p.state").alias("location"))
    order = Window.partitionBy("campaign_id", F.lower(F.concat_ws("|", "query", "location"))).orderBy("i", "j")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def per_term_budget(terms: Column, target: int, most: int) -> Column:
    return F.least(F.lit(most), (F.ceil(F.lit(target) / terms) * 2).cast("int"))


_SLOT = re.compile(r"\{\{(?:(json|list):)?([\w.]+)(\?)?\}\}")


def rendered(template: str) -> tuple[Column, Column]:
    """(text, missing): the template over a row's columns, and the required values that lack."""
    parts: list[Column] = []
    missing: list[Column] = []
    at = 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        kind, path, optional = m.groups()
        value = c(path)
        text = F.to_json(value) if kind == "json" else F.array_join(F.transform(value, lambda x: F.concat(F.lit("- "), x)), "\n") if kind == "list" else value.cast("string")
        parts.append(F.coalesce(text, F.lit("")))
        if not optional:
            missing.append(F.when(value.isNull(), F.lit(path)))
        at = m.end()
    parts.append(F.lit(template[at:]))
    lacking = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    return F.concat(*parts), lacking


def hashtags(campaigns: DataFrame) -> DataFrame:
    """P6. campaigns: (campaign_id, cities, tags). Each tag of a campaign once, at its first place; a tag
    with {city_slug} stands for one of each city."""
    t = campaigns.select("campaign_id", "cities", F.posexplode("tags").alias("i", "tag"))
    filled = t.where(c("tag").contains("{city_slug}")).select("campaign_id", "i", F.posexplode("cities").alias("j", "city"), "tag")
    name = F.replace(F.replace(F.replace("tag", F.lit("{city_slug}"), S.slug(c("city"))), F.lit("{city}"), c("city")), F.lit("{state}"), F.lit(""))
    filled = filled.select("campaign_id", "i", "j", S.squeeze(F.replace(name, F.lit("{state_slug}"), F.lit(""))).alias("tag"))
    plain = t.where(~c("tag").contains("{city_slug}")).select("campaign_id", "i", F.lit(0).alias("j"), "tag")
    return filled.unionByName(plain).groupBy("campaign_id", "tag").agg(F.min(F.struct("i", "j")).alias("x")).select("campaign_id", "tag", "x.i", "x.j")
