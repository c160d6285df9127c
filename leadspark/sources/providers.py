"""Rows of any provider as JSON to canonical leads (IO3, U1), without a schema.

A row is one VARIANT. Each field takes the first of several dotted paths that has a value; what no
field asks for stays in `raw`, so providers with unknown fields need no change of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import scalars as S

c = F.col

# Where the fields of a lead are looked for, first ones first.
PATHS = {
    "business_name": ["business_name", "name", "title", "fullName", "ownerFullName"],
    "instagram_handle": ["instagram_handle", "username", "instagram", "instagramUrl", "instagram_url"],
    "website": ["website", "url", "externalUrl", "external_url", "site"],
    "state": ["state", "region", "administrativeArea", "address.state"],
    "city": ["city", "locality", "address.city"],
    "products_services": ["products_services", "products", "services", "menu", "categories"],
    "email": ["email", "emails.0", "contact_email"],
    "phone": ["phone", "phoneNumber", "phone_number", "telephone"],
    "country": ["country", "countryCode"],
    "postal_code": ["postal_code", "postalCode", "zip"],
    "address": ["address", "formattedAddress", "street"],
    "latitude": ["latitude", "location.lat", "lat"],
    "longitude": ["longitude", "location.lng", "lng"],
    "category": ["category", "categoryName", "businessCategoryName", "business_category"],
    "bio": ["bio", "biography", "description"],
    "website_description": ["website_description", "meta_description"],
    "products_count": ["products_count", "productsCount"],
    "ig_followers": ["ig_followers", "followersCount", "followers", "follower_count"],
    "ig_following": ["ig_following", "followsCount", "following"],
    "ig_posts": ["ig_posts", "postsCount", "posts", "media_count"],
    "ig_is_business": ["ig_is_business", "isBusinessAccount", "is_business_account"],
    "ig_is_private": ["ig_is_private", "private", "is_private"],
    "ig_is_verified": ["ig_is_verified", "verified", "is_verified"],
    "place_id": ["place_id", "placeId", "fid"],
    "source_search_term": ["search_term", "searchString", "query"],
}
#: Where a provider's row differs: fields that it sets from others of its own names.
PROVIDERS = {
    "google_maps": {"business_name": ["title"], "instagram_handle": ["instagram", "instagramUrl"], "website": ["website"], "phone": ["phone"], "category": ["categoryName"], "place_id": ["placeId", "fid"], "products_services": ["categories"]},
    "instagram_search": {"business_name": ["fullName", "username"], "instagram_handle": ["username"]},
}
PROFILES = ["socialProfiles", "socialMedia"]


def _path(dotted: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def _text(row: Column, dotted: str) -> Column:
    """The value at a path as text (lists and objects as JSON); null if it is missing, null or empty."""
    v = F.try_variant_get(row, _path(dotted), "variant")
    return F.nullif(F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v))), F.lit(""))


def pick(row: Column, paths: list[str]) -> Column:
    return F.coalesce(*(_text(row, p) for p in paths))


def _labels(row: Column, paths: list[str]) -> Column:
    """Products as labels: from a list (of texts or of objects with a name), an object's values or a text."""
    label = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.title", "string"), F.try_variant_get(x, "$.label", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    listed = lambda p: F.coalesce(F.try_variant_get(row, _path(p), "array<variant>"), F.map_values(F.try_variant_get(row, _path(p), "map<string,variant>")))
    each = lambda p: F.when(_text(row, p).isNotNull(), F.coalesce(F.transform(listed(p), label), F.split(_text(row, p), r"[,;|\n]")))
    return F.coalesce(S.label_list(F.filter(F.coalesce(*(each(p) for p in paths)), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def _profile(row: Column) -> Column:
    """The first social profile that is an account there, from a list or an object of addresses."""
    lists = [F.coalesce(F.try_variant_get(row, f"$.{p}", "array<string>"), F.map_values(F.try_variant_get(row, f"$.{p}", "map<string,string>"))) for p in PROFILES]
    return F.get(F.filter(F.coalesce(*lists), lambda x: x.rlike(r"(?i)instagram\.com")), F.lit(0))


def provider_leads(rows: DataFrame, provider: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """rows: JSON objects as text. (leads in the canonical shape with source and raw, rows that are no
    JSON object or have neither a name nor a handle, with the reason)."""
    paths = PATHS | {f: [*mine, *(p for p in PATHS[f] if p not in mine)] for f, mine in PROVIDERS.get(provider, {}).items()}
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    v = c("_v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    picked = {f: pick(v, p) for f, p in paths.items() if f != "products_services"}
    if provider == "google_maps":
        picked["instagram_handle"] = F.coalesce(picked["instagram_handle"], _profile(v))
    # The picks are columns of their own: the scalars below name them many times.
    picks = parsed.where(is_object).select("_v", _labels(v, paths["products_services"]).alias("_products"), *(x.alias(f"_{f}") for f, x in picked.items()))
    picks = picks.withColumn("_name", S.clean_name(c("_business_name")))
    first = {f: c(f"_{f}") for f in picked}
    flag = lambda x: F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False)
    number = lambda x: F.when(~F.isnan(x.try_cast("double")), x.try_cast("double"))
    name, products, handle = c("_name"), c("_products"), first["instagram_handle"]
    out = picks.select(
        name.alias("business_name"), S.name_key(name).alias("name_normalized"), S.handle(handle).alias("instagram_handle"), S.url(first["website"]).alias("website"),
        S.domain(first["website"]).alias("website_domain"), S.email(first["email"]).alias("email"), first["phone"].alias("phone"), S.phone(first["phone"]).alias("phone_e164"),
        F.coalesce(first["country"], F.lit("US")).alias("country"), S.state(first["state"]).alias("state"), S.city(first["city"]).alias("city"), first["postal_code"].alias("postal_code"),
        first["address"].alias("address"), number(first["latitude"]).alias("latitude"), number(first["longitude"]).alias("longitude"), first["category"].alias("category"), first["bio"].alias("bio"),
        first["website_description"].alias("website_description"), products.alias("products_services"),
        F.coalesce(F.nullif(F.size(products).cast("long"), F.lit(0)), S.count(first["products_count"]).cast("long")).alias("products_count"),
        *(S.count(first[f]).cast("long").alias(f) for f in ("ig_followers", "ig_following", "ig_posts")), *(flag(first[f]).alias(f) for f in ("ig_is_business", "ig_is_private", "ig_is_verified")),
        first["place_id"].alias("place_id"), F.lit(provider).alias("source"), first["source_search_term"].alias("source_search_term"), F.to_json(v).alias("raw"),
    )
    good = c("business_name").isNotNull() | c("instagram_handle").isNotNull()
    bad = out.where(~good).select("raw", F.lit("neither a name nor a handle").alias("reason"))
    return out.where(good), bad.unionByName(parsed.where(~is_object).select(c(body).alias("raw"), F.lit("not a JSON object").alias("reason")))


def discovered(tables: dict[str, DataFrame], body: str = "body") -> tuple[DataFrame, DataFrame]:
    """The rows of several providers in one table, each with its source; and what can't be used."""
    leads = bad = None
    for provider, rows in tables.items():
        mine, odd = provider_leads(rows, provider, body)
        odd = odd.withColumn("source", F.lit(provider))
        leads = mine if leads is None else leads.unionByName(mine)
        bad = odd if bad is None else bad.unionByName(odd)
    return leads, bad
