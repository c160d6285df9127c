"""Identity keys and what follows from sharing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import connected_components
from leadspark.functions import scalars as S

PRIORITY = ["instagram_handle", "website_domain", "place_id", "phone_e164", "email", "name_city"]
c = F.col


def identity_keys(leads: DataFrame, key: str) -> DataFrame:
    """(key, key_type, key_value, priority) of every key a lead carries, strongest first."""
    name_city = F.concat(c("name_normalized"), F.lit("|"), F.lower(F.coalesce("city", F.lit(""))), F.lit("|"), F.upper(F.coalesce("state", F.lit(""))))
    values = {k: c(k).cast("string") for k in PRIORITY if k in leads.columns} | {"name_city": name_city}
    pairs = [
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key_type"), v.alias("key_value"), F.lit(PRIORITY.index(k)).alias("priority"))) for k, v in sorted(values.items(), key=lambda x: PRIORITY.index(x[0]))
    ]
    return leads.select(key, F.explode(F.array_compact(F.array(*pairs))).alias("k")).select(key, "k.*")


def likely_same(a: str, b: str, threshold: float = 0.92) -> Column:
    """struct(same, matched_on, conflict) of two leads given as struct columns."""
    x, y = (lambda f: c(f"{a}.{f}")), (lambda f: c(f"{b}.{f}"))
    both = lambda f: x(f).isNotNull() & y(f).isNotNull()
    verdict = lambda same, on, conflict: F.struct(F.lit(same).alias("same"), F.lit(on).cast("string").alias("matched_on"), F.lit(conflict).cast("string").alias("conflict"))
    out = None
    for k in PRIORITY[:-1]:
        equal = both(k) & (x(k) == y(k))
        out = F.when(equal, verdict(True, k, None)) if out is None else out.when(equal, verdict(True, k, None))
        if k in ("instagram_handle", "website_domain"):
            out = out.when(both(k), verdict(False, None, k))
    near = S.name_similarity(x("name_normalized"), y("name_normalized")) >= threshold
    place = (F.lower(x("city")) == F.lower(y("city"))) & (F.upper(x("state")) == F.upper(y("state")))
    return out.when(near & place, verdict(True, "name_city", None)).otherwise(verdict(False, None, None))


def key_components(rows: DataFrame, key: str, keys: dict[str, str]) -> DataFrame:
    """(node, label): rows that are joined by shared keys; keys: key type -> column. A key of n
    rows gives n - 1 links, to its first row."""
    pairs = F.array_compact(F.array(*(F.when(c(v).isNotNull(), F.struct(F.lit(k).alias("t"), c(v).cast("string").alias("v"))) for k, v in keys.items())))
    flat = rows.select(c(key).alias("node"), F.explode(pairs).alias("k"))
    first = flat.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    links = flat.join(first, "k").select(c("node").alias("a"), c("hub").alias("b")).where("a <> b")
    labels = connected_components(links)
    alone = rows.select(c(key).alias("node")).distinct().join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", c("node").alias("label")))


def shared_domains(rows: DataFrame, key: str, domain: str) -> DataFrame:
    """Domains of more than one row, with the sorted members."""
    return rows.where(c(domain).isNotNull()).groupBy(domain).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("members")).where("n > 1")


def new_leads(found: DataFrame, existing: DataFrame, by: tuple[str, ...] = ("campaign_id", "company_id")) -> DataFrame:
    """One lead for each pair that has none yet."""
    return found.dropDuplicates(list(by)).join(existing.select(*by), list(by), "left_anti")


def new_contacts(found: DataFrame, existing: DataFrame) -> DataFrame:
    """The first contact of each company and mailbox that is not known, by seq."""
    rows = found.withColumn("mail", F.lower("email"))
    order = Window.partitionBy("company_id", "mail").orderBy("seq")
    rows = rows.withColumn("_r", F.row_number().over(order)).where(c("_r") == 1).drop("_r")
    return rows.join(existing.select("company_id", F.lower("email").alias("mail")), ["company_id", "mail"], "left_anti").drop("mail")
