"""Lead files and provider rows in; sheets and tables out (IO1-IO9, P1-P4)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.functions import scalars as S

c = F.col

#: Header names (squashed) of each field. Fixed values.
ALIASES = {
    "company_name": ["company", "company name", "business name", "business_name", "name", "organization", "account name"],
    "website": ["website", "url", "site", "company website", "web site", "domain"],
    "phone": ["phone", "phone number", "telephone", "company phone", "contact no"],
    "email": ["email", "e mail", "email address", "work email"],
    "state": ["state", "region", "company state"],
    "city": ["city", "town", "company city"],
    "instagram": ["instagram", "instagram url", "ig", "instagram handle"],
    "industry": ["industry", "category", "niche"],
    "description": ["description", "about", "bio", "company description"],
    "rating": ["rating", "stars"],
    "postal_code": ["zip", "postal code", "zipcode"],
}


def squash(header: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]+", " ", header.lower().replace("_", " "))).strip()


def read_lead_file(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All cells as trimmed strings, with source_file and original_row (the first data row is 2)."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = rows.columns
    rows = rows.select(*(S.blank_to_null(c(f"`{x}`")).alias(x.strip()) for x in cells), F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("_at"))
    # A quoted cell may span lines, so a file is one partition and numbers are cheap.
    order = Window.partitionBy("source_file").orderBy("_at")
    rows = rows.withColumn("original_row", (F.row_number().over(order) + 1).cast("int")).drop("_at")
    return rows.where(F.coalesce(*(c(f"`{x.strip()}`") for x in cells)).isNotNull())


def detect_columns(headers: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """Field -> headers that feed it, in file order; and the headers that feed nothing."""
    by_alias = {squash(a): field for field, names in ALIASES.items() for a in names}
    mapping: dict[str, list[str]] = {}
    rest = []
    for h in headers:
        field = by_alias.get(squash(h))
        if field:
            mapping.setdefault(field, []).append(h)
        elif squash(h) == "title" and "company_name" not in {by_alias.get(squash(x)) for x in headers}:
            mapping.setdefault("company_name", []).append(h)
        elif squash(h) not in ("source file", "original row"):
            rest.append(h)
    return mapping, rest


def map_rows(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(leads, skipped): canonical rows, and rows without a company name."""
    mapping, _ = detect_columns(rows.columns)
    if "company_name" not in mapping:
        raise ValueError(f"no company name column among {rows.columns}")
    first = lambda f: F.coalesce(*(c(f"`{h}`") for h in mapping[f])) if f in mapping else F.lit(None).cast("string")
    cells = [x for x in rows.columns if x not in ("source_file", "original_row")]
    record = F.map_filter(F.create_map(*(y for x in cells for y in (F.lit(x), c(f"`{x}`")))), lambda _, v: v.isNotNull())
    rating = first("rating").try_cast("double")
    out = rows.select(
        S.clean_name(first("company_name")).alias("company_name"),
        S.name_key(first("company_name")).alias("name_normalized"),
        S.url(first("website")).alias("website"),
        S.domain(first("website")).alias("domain"),
        first("phone").alias("phone"),
        S.phone(first("phone")).alias("phone_e164"),
        S.email(first("email")).alias("email"),
        S.state(first("state")).alias("state"),
        S.city(first("city")).alias("city"),
        S.handle(first("instagram")).alias("instagram_handle"),
        first("industry").alias("industry"),
        first("description").alias("company_description"),
        F.when(~F.isnan(rating), rating).alias("rating"),
        F.regexp_replace(first("postal_code"), r"\.0$", "").alias("postal_code"),
        F.lit(source).alias("source"),
        "source_file",
        "original_row",
        record.alias("original_record"),
    )
    has = c("company_name").isNotNull()
    return out.where(has), out.where(~has).select("source_file", "original_row", F.lit("no company name").alias("reason"))


def profile(leads: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for each column how many have it."""
    return leads.agg(F.count("*").alias("n_rows"), *(F.count(x).alias(f"with_{x}") for x in columns))


def inbound_messages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Webhook payloads -> (sender, text, external_message_id, sent_at); echoes and empty ones go."""
    schema = "entry array<struct<messaging: array<struct<sender: struct<id: string>, timestamp: bigint, message: struct<mid: string, text: string, is_echo: boolean>>>>>"
    m = payloads.select(F.explode(F.from_json(body, schema)["entry"]).alias("e")).select(F.explode("e.messaging").alias("m"))
    m = m.select(c("m.sender.id").alias("sender"), c("m.message.text").alias("text"), c("m.message.mid").alias("external_message_id"), F.timestamp_millis("m.timestamp").alias("sent_at"), c("m.message.is_echo").alias("echo"))
    return m.where(~F.coalesce("echo", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "")).drop("echo")


def sheet_cell(x: Column, kind: T.DataType) -> Column:
    """Safe for spreadsheets: lists joined, leading formula signs quoted."""
    text = F.array_join(x, " | ") if isinstance(kind, T.ArrayType) else x.cast("string")
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_sheet(rows: DataFrame, path: str) -> None:
    out = rows.select(*(sheet_cell(c(f.name), f.dataType).alias(f.name) for f in rows.schema))
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n", encoding="UTF-8")


def mirror(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old table with new rows over it; `change` says updated, appended or kept."""
    fields = [x for x in old.columns if x != key]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, c(f"a.{key}") == c(f"b.{key}"), "full_outer")
    change = F.when(c(f"b.{key}").isNull(), "kept").when(c(f"a.{key}").isNull(), "appended").otherwise("updated")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{x}", f"a.{x}").alias(x) for x in fields), change.alias("change"))


def daily_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot rows by null-safe keys: new ones take the place of old ones."""
    a, b = old.alias("a"), new.select(*keys).distinct().alias("b")
    match = [c(f"a.{k}").eqNullSafe(c(f"b.{k}")) for k in keys]
    return a.join(b, match, "left_anti").unionByName(new)
