"""Merging rows in their order without groups (D3, D4): a fixpoint of rounds.

The rule is sequential. A row joins the survivor that owns its strongest known key, or else
the first survivor of its city and state with a near name; if there is none it survives.
A survivor fills its gaps from the rows that join it and owns the keys it wins so, unless
they have an owner already. What happens to a row depends on earlier rows alone.

So the assignment of rows to survivors is found as a fixpoint. From an assignment a round
computes when each survivor wins which value (a minimum per field), who owns each key
and since when (a minimum per key), and from these a new assignment for every row, by
equi-joins on keys. A round settles at least the first row that was not yet right, in
practice nearly all, and an assignment that a round leaves as it is, is the sequential
one. All steps are grouped minima and joins on keys: no task holds a component.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.components import settle
from leadspark.functions import scalars as S
from leadspark.operators import identity as ID

c = F.col
COUNTS = ["ig_followers", "ig_following", "ig_posts", "products_count"]
STRONG = ID.PRIORITY[:-1]


def name_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(name_normalized, blocks) of the distinct names: two different names that reach the threshold share a
    block. Half the similarity is the overlap of words, so it is at least 2 * threshold - 1 for
    them; sets of words with such an overlap are equal or share one of their rarest words."""
    if threshold <= 0.5:
        raise ValueError("names are only compared within blocks above a threshold of 0.5")
    least = 2 * threshold - 1
    names = rows.where(c("name_normalized").isNotNull()).select("name_normalized").distinct()
    names = names.withColumn("words", F.array_sort(F.array_distinct(F.split("name_normalized", " "))))
    n = F.size("words")
    short = n < F.lit(least / (1 - least) if least < 1 else math.inf)
    whole = names.where(short).select("name_normalized", F.array(F.array_join("words", " ")).alias("blocks"))
    words = names.where(~short).select("name_normalized", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    ordered = words.join(often, "word").groupBy("name_normalized").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    first = F.size("w") - F.ceil(F.size("w") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    rare = ordered.select("name_normalized", F.transform(F.slice("w", F.lit(1), first), lambda x: F.concat(F.lit("~"), x["word"])).alias("blocks"))
    return whole.unionByName(rare)


def _first(value: Column, known: Column) -> Column:
    return F.min(F.when(known, F.struct(c("seq").alias("t"), value.alias("v"))))


def _survivors(now: DataFrame, fields: list[str]) -> DataFrame:
    """For each survivor s: each field's value and since which row (t) it has it."""
    parts = [_first(c(f), c(f).isNotNull()).alias(f) for f in (*fields, "city", "state")]
    return now.groupBy("s").agg(*parts, _first(F.struct("name_normalized", "blocks"), c("name_normalized").isNotNull()).alias("name"))


def _won(survivors: DataFrame, fields: list[str]) -> DataFrame:
    """(key_type, key_value, t, s): the keys each survivor wins and when. Its name wins a key
    again each time that the city or the state is filled."""
    own = lambda k, v, t: F.struct(F.lit(k).alias("key_type"), v.alias("key_value"), t.alias("t"))
    strong = [F.when(c(f).isNotNull(), own(f, c(f"{f}.v"), c(f"{f}.t"))) for f in fields]
    at_city, at_state = (F.greatest(c("name.t"), F.coalesce(c(f"{k}.t"), c("name.t"))) for k in ("city", "state"))
    named = []
    for t in (c("name.t"), at_city, at_state):
        place = [F.when(c(f"{k}.t") <= t, c(f"{k}.v")).otherwise(F.lit("")) for k in ("city", "state")]
        named.append(F.when(c("name").isNotNull(), own("name_city", F.concat_ws("|", c("name.v.name_normalized"), *place), t)))
    return survivors.select("s", F.explode(F.array_distinct(F.array_compact(F.array(*strong, *named)))).alias("k")).select("s", "k.*")


def assignment(leads: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(seq, s, matched_on) of the rows that could meet another: s is the survivor a row went
    into (itself for survivors), matched_on the kind of key."""
    fields = [f for f in STRONG if f in leads.columns]
    rows = leads.select(
        "seq", *(F.nullif(c(f).cast("string"), F.lit("")).alias(f) for f in fields), F.nullif("name_normalized", F.lit("")).alias("name_normalized"),
        F.nullif(F.lower("city"), F.lit("")).alias("city"), F.nullif(F.upper("state"), F.lit("")).alias("state"),
    )
    rows = settle(rows.join(name_blocks(rows, threshold), "name_normalized", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>"))))
    strong = [F.when(c(f).isNotNull(), F.struct(F.lit(f).alias("key_type"), c(f).alias("key_value"), F.lit(ID.PRIORITY.index(f)).alias("priority"))) for f in fields]
    near = F.transform("blocks", lambda b: F.struct(F.lit("near").alias("key_type"), b.alias("key_value"), F.lit(-1).alias("priority")))
    tokens = rows.select("seq", F.explode(F.concat(F.array_compact(F.array(*strong)), near)).alias("k")).select("seq", "k.*")
    shared = tokens.groupBy("key_type", "key_value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tokens = settle(tokens.join(shared, ["key_type", "key_value"]))
    # A row that shares no key and no block of names with another meets nobody.
    active = settle(rows.join(tokens.select("seq").distinct(), "seq", "left_semi"))
    place = F.concat_ws("|", "name_normalized", F.coalesce("city", F.lit("")), F.coalesce("state", F.lit("")))
    named = active.where(c("name_normalized").isNotNull()).select(F.lit("name_city").alias("key_type"), place.alias("key_value"), "seq", F.lit(ID.PRIORITY.index("name_city")).alias("priority"))
    keys = settle(tokens.where("priority >= 0").unionByName(named))
    now = active.withColumns({"s": c("seq"), "matched_on": F.lit(None).cast("string")})
    while True:
        now = settle(_round(now, keys, fields, threshold))
        if not now.where("moved").limit(1).count():
            return now.select("seq", "s", "matched_on")
        now = now.drop("moved")


def _round(now: DataFrame, keys: DataFrame, fields: list[str], threshold: float) -> DataFrame:
    survivors = settle(_survivors(now, fields))
    owners = _won(survivors, fields).groupBy("key_type", "key_value").agg(F.min(F.struct("t", "s")).alias("o"))
    hits = keys.join(owners, ["key_type", "key_value"]).where(c("o.t") < c("seq")).groupBy("seq").agg(F.min(F.struct("priority", c("o.s").alias("s"), "key_type")).alias("hit"))
    rows = now.join(hits, "seq", "left")
    # Near names: rows without a key, and survivors whose name, city and state are known by then.
    asking = rows.where(c("hit").isNull() & c("city").isNotNull() & c("state").isNotNull())
    asking = asking.select("seq", c("name_normalized").alias("asked"), *(c(f).alias(f"my_{f}") for f in fields[:2]), "city", "state", F.explode("blocks").alias("block"))
    offered = survivors.where(c("name").isNotNull() & c("city").isNotNull() & c("state").isNotNull()).select(
        c("s").alias("near"), c("name.v.name_normalized").alias("offered"), F.greatest("name.t", "city.t", "state.t").alias("since"), *(c(f).alias(f"its_{f}") for f in fields[:2]),
        c("city.v").alias("city"), c("state.v").alias("state"), F.explode("name.v.blocks").alias("block"),
    )
    met = asking.join(offered, ["block", "city", "state"]).where((c("since") < c("seq")) & (S.name_similarity(c("asked"), c("offered")) >= threshold))
    for f in fields[:2]:
        if f in ("instagram_handle", "website_domain"):
            met = met.where(~F.coalesce((c(f"its_{f}.t") < c("seq")) & (c(f"my_{f}") != c(f"its_{f}.v")), F.lit(False)))
    near = met.groupBy("seq").agg(F.min("near").alias("near"))
    kind = F.when(c("hit").isNotNull(), c("hit.key_type")).when(c("near").isNotNull(), F.lit("name_city"))
    new = rows.join(near, "seq", "left").withColumns({"to": F.coalesce("hit.s", "near", "seq"), "kind": kind})
    moved = (c("to") != c("s")) | ~c("kind").eqNullSafe(c("matched_on"))
    new = settle(new.withColumns({"moved": moved, "s": c("to"), "matched_on": c("kind")}).select(*now.columns, "moved"))
    # A step along the new assignment: what pointed at a row that has joined another goes on there.
    onward = new.where("s <> seq").select(c("seq").alias("s"), c("s").alias("beyond"))
    return new.join(onward, "s", "left").withColumn("s", F.coalesce("beyond", "s")).select(*now.columns, "moved")


def _blank(f: T.StructField) -> Column:
    return c(f.name).isNull() | (c(f.name) == "" if isinstance(f.dataType, T.StringType) else F.lit(False))


def filled(members: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """members: rows with s. One row for each s: gaps filled in order of seq, lists joined without
    repeats in any case, counts at their largest, the entries of a map `raw` from its last row."""
    lists = [f for f in fields if isinstance(f.dataType, T.ArrayType)]
    raw = [f for f in fields if isinstance(f.dataType, T.MapType) and f.name == "raw"]
    # A map has no order: where it is not joined, the whole value is found by the row that has it.
    maps = [f for f in fields if isinstance(f.dataType, T.MapType) and f.name != "raw"]
    parts = []
    for f in fields:
        if f.name in COUNTS:
            parts.append(F.max(f.name).alias(f.name))
        elif f in maps:
            parts.append(F.min_by(f.name, F.when(~_blank(f), c("seq"))).alias(f.name))
        elif f not in raw:
            parts.append(_first(c(f.name), ~_blank(f)).alias(f.name))
    out = members.groupBy("s").agg(*parts)
    for f in raw:
        entries = members.select("s", "seq", F.explode(f.name).alias("k", "v")).groupBy("s", "k").agg(F.max_by("v", "seq").alias("v"))
        whole = entries.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(f.name))
        out = out.join(whole, "s", "left")
    for f in lists:
        first = out.select("s", c(f"{f.name}.t").alias("t"))
        items = members.select("s", "seq", F.posexplode(f.name).alias("at", "item")).join(first, "s").where("seq > t")
        once = items.groupBy("s", F.lower(c("item").cast("string")).alias("low")).agg(F.min(F.struct("seq", "at", "item", F.lower(c("item").cast("string")).alias("low"))).alias("i"))
        more = once.groupBy("s").agg(F.array_sort(F.collect_list("i")).alias("more"))
        base = c(f"{f.name}.v")
        known = F.transform(base, lambda x: F.lower(x.cast("string")))
        new = F.transform(F.filter("more", lambda x: ~F.array_contains(known, x["low"])), lambda x: x["item"])
        joined = F.when(c("more").isNull(), base).otherwise(F.concat(base, new))
        out = out.join(more, "s", "left").withColumn(f"list_{f.name}", joined).drop("more", f.name).withColumnRenamed(f"list_{f.name}", f.name)
    flat = {f.name for f in fields} - {f.name for f in lists + raw + maps} - set(COUNTS)
    return out.select("s", *((c(f"{f.name}.v") if f.name in flat else c(f.name)).alias(f.name) for f in fields))


def dedupe_batch(leads: DataFrame, threshold: float = 0.92) -> DataFrame:
    """leads: canonical rows with a unique long `seq` that orders them. The same rows with
    duplicate_of (seq, null for survivors) and matched_on; survivors hold the merged values."""
    into = assignment(leads, threshold)
    taken = into.where("s <> seq")
    rows = leads.join(into, "seq", "left").withColumn("s", F.coalesce("s", "seq"))
    full = taken.select("s").distinct()
    fields = [f for f in leads.schema if f.name != "seq"]
    merged = filled(rows.join(full, "s", "left_semi"), fields)
    if "products_count" in leads.columns:
        listed = F.size("products_services") if "products_services" in leads.columns else F.lit(0)
        count = F.when(listed > 0, listed).otherwise(F.nullif("products_count", F.lit(0)))
        merged = merged.withColumn("products_count", count.cast(leads.schema["products_count"].dataType))
    none = {"duplicate_of": F.lit(None).cast("long"), "matched_on": F.lit(None).cast("string")}
    first = merged.withColumnRenamed("s", "seq").withColumns(none)
    gone = rows.where("s <> seq").withColumn("duplicate_of", c("s"))
    alone = rows.where("s = seq").join(full, "s", "left_anti").drop("matched_on").withColumns(none)
    names = [*leads.columns, "duplicate_of", "matched_on"]
    return first.select(names).unionByName(gone.select(names)).unionByName(alone.select(names))
