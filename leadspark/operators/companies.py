"""Companies resolved from rows in their order, with ids for new ones.

A row belongs to the company that owns its strongest known key; if none is known it founds one.
Then all its keys are recorded, and the first owner of a key keeps it. A row records its own
keys only, so the owner of a key is known beforehand: a recorded one, or else the company of
the first row that carries it. Each row thus points at a company, at an earlier row, or at
nothing, and the pointers are followed by doubling: rounds grow with the logarithm of the
longest chain, and no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.components import settle
from leadspark.operators import identity as ID
from leadspark.operators.ranking import with_place

c = F.col
#: How a known company takes up a value of a later row; any other column keeps the founder's value.
GAPS = ["instagram_handle", "instagram_url", "website", "website_domain", "phone", "phone_e164", "email", "city", "state", "category", "niche_id"]
NEWEST = ["bio", "ig_followers", "ig_posts", "ig_last_post_at"]
LOW = ["instagram_handle", "website_domain", "email"]
#: Columns of a company that also find it where the key table does not.
COLUMNS = ["instagram_handle", "website_domain", "phone_e164"]


def _cased(rows: DataFrame) -> DataFrame:
    cased = {k: F.lower(k) for k in LOW if k in rows.columns} | ({"state": F.upper("state")} if "state" in rows.columns else {})
    return rows.withColumns(cased)


def _keys(rows: DataFrame) -> DataFrame:
    return ID.identity_keys(rows, "seq").where("key_value <> ''")


def _owners(rows: DataFrame, companies: DataFrame, known: DataFrame) -> DataFrame:
    """(seq, company_id, parent): the company that a row's strongest key has, or the earlier row that had it first."""
    keys = settle(_keys(rows))
    first = keys.groupBy("key_type", "key_value").agg(F.min("seq").alias("first"))
    recorded = known.groupBy("key_type", "key_value").agg(F.min("company_id").alias("owner"))
    own = first.join(recorded, ["key_type", "key_value"], "left")
    hits = keys.join(own, ["key_type", "key_value"]).where("owner is not null or first < seq")
    hits = hits.select("seq", "priority", "owner", F.when(c("owner").isNull(), c("first")).alias("parent"))
    named = F.array(*(F.struct(F.lit(k).alias("key_type"), c(k).alias("key_value")) for k in COLUMNS))
    filed = companies.select("company_id", F.explode(named).alias("k")).where("k.key_value <> ''").groupBy("k").agg(F.min("company_id").alias("owner")).select("k.*", "owner")
    later = keys.join(filed, ["key_type", "key_value"]).select("seq", (c("priority") + len(ID.PRIORITY)).alias("priority"), "owner", F.lit(None).cast("long").alias("parent"))
    best = hits.unionByName(later).groupBy("seq").agg(F.min(F.struct("priority", "owner", "parent")).alias("b"))
    return rows.select("seq").join(best, "seq", "left").select("seq", c("b.owner").alias("company_id"), c("b.parent").alias("parent"))


def _followed(owners: DataFrame) -> DataFrame:
    """(seq, company_id, founder): the ends of the pointers."""
    now = settle(owners.withColumn("founder", F.lit(None).cast("long")))
    while now.where("parent is not null").limit(1).count():
        up = now.select(c("seq").alias("parent"), c("company_id").alias("_company"), c("parent").alias("_next"), c("founder").alias("_founder"))
        # A parent that points nowhere and has no company is the founder.
        founder = F.when(c("_company").isNull() & c("_next").isNull(), F.coalesce("_founder", "parent"))
        new = now.join(up, "parent", "left").select("seq", F.coalesce("company_id", "_company").alias("company_id"), c("_next").alias("parent"), F.coalesce("founder", founder).alias("founder"))
        now = settle(new)
    return now


def resolve(incoming: DataFrame, companies: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """incoming: canonical rows with a unique long seq; companies: company_id and any of the same columns;
    known: (key_type, key_value, company_id). Returns (seq, company_id) of every row, the
    companies with gaps filled and new ones added, and the keys that are new. New companies get
    the ids after the largest one, in the order of their first rows. Empty keys find nothing."""
    rows = settle(_cased(incoming))
    ends = _followed(_owners(rows, companies, known))
    founded = ends.where("company_id is null and founder is null").select("seq")
    top = companies.agg(F.max("company_id")).first()[0] or 0
    fresh = with_place(founded, [], [c("seq")]).select(c("seq").alias("founder"), (F.lit(top).cast("long") + c("place")).alias("fresh"))
    ends = ends.withColumn("founder", F.when(c("company_id").isNull(), F.coalesce("founder", "seq")))
    into = settle(ends.join(fresh, "founder", "left").select("seq", F.coalesce("company_id", "fresh").alias("company_id"), (c("fresh").isNotNull() & (c("founder") == c("seq"))).alias("founds")))
    fields = [f for f in companies.schema if f.name != "company_id"]
    base = companies.select("company_id", *(f.name for f in fields), F.lit(-1).cast("long").alias("seq"))
    added = rows.join(into, "seq").select(c("company_id").cast(companies.schema["company_id"].dataType).alias("company_id"), *((c(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), "seq")
    both = base.unionByName(added)
    merged = both.groupBy("company_id").agg(*(_merged(f).alias(f.name) for f in fields))
    keys = _keys(rows).join(into, "seq").join(known.select("key_type", "key_value").distinct(), ["key_type", "key_value"], "left_anti")
    keys = keys.groupBy("key_type", "key_value").agg(F.min_by("company_id", "seq").alias("company_id"))
    return into.select("seq", "company_id"), merged, keys


def _merged(f: T.StructField) -> Column:
    value = c(f.name)
    if f.name in GAPS:
        return F.min_by(value, F.when(value.isNotNull(), c("seq")))
    if f.name in NEWEST:
        return F.max_by(value, F.when(value.isNotNull(), c("seq")))
    if f.name == "products_services":
        return F.max_by(value, F.struct(F.greatest(F.size(value), F.lit(0)), -c("seq")))
    if f.name == "products_count":
        # A founder without a count has none until a second row comes.
        return F.when(F.count("*") > 1, F.coalesce(F.greatest(F.max(value), F.lit(0).cast(f.dataType)), F.lit(0).cast(f.dataType))).otherwise(F.max(value))
    return F.min_by(value, c("seq"))
