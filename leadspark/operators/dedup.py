"""One row for each real business: verdicts on pairs and the merge by verdict (D7, D8), without groups.

The rule is sequential. A row is compared with the places filed so far under its domain, its
name and city, or its phone, and joins the first one that it is a duplicate of; otherwise it
is a new place, filed under its own keys for good. The fuller of the row and what the place
holds by then leads, and the other fills its gaps.

What a place holds seldom changes. A row leads only if it is fuller than all rows before, and
otherwise matters only if it is the first with a value in some column. So the first row of
each fullness and of each column are enough to replay a place: a list bounded by the columns,
however many rows it has.

The assignment of rows to places is a fixpoint, as in ordered_merge: a round replays the places
of an assignment, and from what they held when a row came it assigns every row anew, by an
equi-join on what all duplicates share. A row's fate depends on earlier rows alone, so a
round settles at least the first row that was wrong, and an assignment that stays is
the sequential one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.components import settle
from leadspark.functions import scalars as S
from leadspark.operators.ordered_merge import name_blocks

c = F.col


FULL = ["website", "phone_e164", "email", "address", "city", "state", "rating", "review_count", "instagram", "company_description"]


COMPARED = ["domain", "website", "name_normalized", "city", "state", "phone_e164", "email"]
NAME_THRESHOLD = 0.90


def _empty(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _fullness(fields: list[T.StructField], get) -> Column:
    """How many of the columns in FULL have a value other than nothing and 0."""
    parts = [F.lit(0)]
    for f in fields:
        if f.name in FULL:
            none = _empty(get(f.name), f.dataType)
            if isinstance(f.dataType, T.NumericType):
                none = none | (get(f.name) == 0)
            parts.append(F.when(none, 0).otherwise(1))
    return sum(parts[1:], parts[0])


def _let(value: Column, body) -> Column:
    """body of a value that is named once: an expression that repeats it would grow with every use."""
    return F.transform(F.array(value), body)[0]


def _replayed(rows: DataFrame, fields: list[T.StructField], history: str) -> DataFrame:
    """rows: seq, s, matched_on and the fields. For each place s: `first` (its first row), `now` (what it
    holds at last) and `history`: with "held", what it held from which row on; with "lost", what led it before."""
    names = [f.name for f in fields]
    full = _fullness(fields, c)
    marks = [F.min(F.when(~_empty(c(f.name), f.dataType), c("seq"))) for f in fields]
    marks += [F.min(F.when(full == k, c("seq"))) for k in range(len(FULL) + 1)]
    marked = rows.groupBy("s").agg(F.array_distinct(F.array_compact(F.array(*marks))).alias("t"))
    # By seq, not by s: the rows of a large place stay spread.
    turns = marked.select("s", F.explode("t").alias("seq")).join(rows.drop("s"), "seq")
    by_seq = lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0)
    lists = turns.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("seq", "matched_on", *names)), by_seq).alias("turns"))
    lists = lists.where(c("turns")[0]["seq"] == c("s"))
    now = lambda x: F.struct(x["seq"].alias("seq"), *(x[k].alias(k) for k in names))
    entry = lambda at, on, x: F.struct(at.alias("at"), on.alias("on"), now(x).alias("row"))
    first = c("turns")[0]
    start = F.array(entry(first["seq"], first["matched_on"], first))
    if history == "lost":
        start = F.filter(start, lambda x: F.lit(False))

    def filled(old: Column, x: Column, wins: Column) -> Column:
        pick = []
        for f in fields:
            a, b = old[f.name], x[f.name]
            pick.append(F.when(~_empty(b, f.dataType) & (wins | _empty(a, f.dataType)), b).otherwise(a).alias(f.name))
        return F.struct(F.when(wins, x["seq"]).otherwise(old["seq"]).alias("seq"), *pick)

    def step(acc: Column, x: Column) -> Column:
        old, log = acc["now"], acc["log"]
        wins = _fullness(fields, lambda k: x[k]) > _fullness(fields, lambda k: old[k])
        if history == "held":
            more = lambda new, _: F.concat(log, F.array(entry(x["seq"], x["matched_on"], new)))
        else:
            more = lambda _, w: F.when(w, F.concat(log, F.array(entry(x["seq"], x["matched_on"], old)))).otherwise(log)
        return _let(wins, lambda w: _let(filled(old, x, w), lambda new: F.struct(new.alias("now"), more(new, w).alias("log"))))

    rest = F.slice("turns", F.lit(2), F.size("turns"))
    done = lists.withColumn("acc", F.aggregate(rest, F.struct(now(first).alias("now"), start.alias("log")), step))
    return done.select("s", first.alias("first"), c("acc.now").alias("now"), c("acc.log").alias(history))


def _filed(f) -> Column:
    """The keys that a row is filed under, strongest first; f gives a column of the row by its name."""
    key = lambda rank, value, known: F.when(known, F.struct(F.lit(rank).alias("rank"), value.alias("value")))
    name, city = f("name_normalized"), f("city")
    named = key(1, F.concat_ws("|", name, city), name.isNotNull() & city.isNotNull())
    return F.array_compact(F.array(key(0, f("domain"), f("domain").isNotNull()), named, key(2, f("phone_e164"), f("phone_e164").isNotNull())))


def _shared(row: str) -> Column:
    """What any two duplicates share one of: near names share a block, and besides it a domain, place, phone
    or mailbox; other duplicates share domain and place."""
    f = lambda k: c(f"{row}.{k}")
    place = F.when(f("city").isNotNull(), F.concat_ws("|", f("city"), F.coalesce(f("state"), F.lit(""))))
    more = {"domain": f("domain"), "place": place, "phone": f("phone_e164"), "email": f("email")}
    named = F.transform(F.coalesce(f("blocks"), F.array().cast("array<string>")), lambda b: F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat_ws("|", F.lit(k), b, v)) for k, v in more.items()))))
    site = F.when(f("domain").isNotNull() & place.isNotNull(), F.concat_ws("|", F.lit("site"), f("domain"), place))
    return F.concat(F.flatten(named), F.array_compact(F.array(site)))


def _tokens(rows: DataFrame, filed: str, shared: str) -> DataFrame:
    """rows with a row for each pair of a key of `filed` and one of `shared`, as rank and h."""
    out = rows.withColumn("key", F.explode(_filed(lambda k: c(f"{filed}.{k}")))).withColumn("part", F.explode(_shared(shared)))
    return out.withColumns({"rank": c("key.rank"), "h": F.xxhash64("key.rank", "key.value", "part")}).drop("key", "part")


def places(leads: DataFrame) -> DataFrame:
    """(seq, s, matched_on) of the rows that share a key with another one: s is the first row of a row's place."""
    kinds = {f.name: f.dataType for f in leads.schema}
    text = lambda k: F.nullif(c(k).cast("string"), F.lit(""))
    own = {k: text(k) for k in COMPARED} | {"city": F.lower(text("city")), "state": F.lower(text("state"))}
    extra = [k for k in FULL if k in kinds and k not in COMPARED]
    rows = leads.select("seq", *(v.alias(k) for k, v in own.items()), *extra)
    keys = rows.select("seq", F.explode(_filed(c)).alias("k")).select("seq", "k.*")
    often = keys.groupBy("rank", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(keys.join(often, ["rank", "value"]).select("seq").distinct(), "seq", "left_semi")
    rows = settle(rows)
    rows = settle(rows.join(name_blocks(rows, NAME_THRESHOLD), "name_normalized", "left"))
    fields = [f for f in rows.schema if f.name != "seq"]
    asks = settle(_tokens(rows.select("seq", F.struct(*COMPARED, "blocks").alias("y")), "y", "y").select("seq", "h", "y"))
    # A first guess: the first row with the same key and part.
    guess = asks.join(asks.groupBy("h").agg(F.min("seq").alias("to")), "h").groupBy("seq").agg(F.min("to").alias("s"))
    now = rows.join(guess, "seq", "left").withColumns({"s": F.coalesce("s", "seq"), "matched_on": F.lit(None).cast("string")})
    while True:
        now = _onward(settle(now))
        now = settle(_assigned(now, asks, fields))
        if not now.where("moved").limit(1).count():
            return now.select("seq", "s", "matched_on")
        now = now.drop("moved")


def _onward(now: DataFrame) -> DataFrame:
    """What points at a row that itself lies in another place goes on there."""
    beyond = now.where("s <> seq").select(c("seq").alias("s"), c("s").alias("beyond"))
    return now.join(beyond, "s", "left").withColumn("s", F.coalesce("beyond", "s")).select(*now.columns)


def _assigned(now: DataFrame, asks: DataFrame, fields: list[T.StructField]) -> DataFrame:
    held = _replayed(now, fields, "held")
    until = lambda x, i: F.coalesce(F.try_element_at(c("held"), i + 2)["at"], F.lit(2**63 - 1))
    spans = held.select("s", "first", F.explode(F.transform("held", lambda x, i: F.struct(x["at"].alias("since"), until(x, i).alias("until"), x["row"].alias("x")))).alias("v")).select("s", "first", "v.*")
    offers = _tokens(spans, "first", "x").select("h", "rank", "s", "since", "until", "x")
    met = asks.join(offers, "h").where((c("since") < c("seq")) & (c("seq") <= c("until"))).withColumn("v", compare("x", "y")).where("v.verdict = 'duplicate'")
    hits = met.groupBy("seq").agg(F.min(F.struct("rank", "s", c("v.matched_on").alias("on"))).alias("hit"))
    rows = now.join(hits, "seq", "left").withColumns({"to": F.coalesce("hit.s", "seq"), "on": c("hit.on")})
    moved = (c("to") != c("s")) | ~c("on").eqNullSafe(c("matched_on"))
    return rows.withColumns({"moved": moved, "s": c("to"), "matched_on": c("on")}).select(*now.columns, "moved")


def dedupe_leads(leads: DataFrame) -> DataFrame:
    """Leads with a unique long `seq`, and domain, website, name_normalized, city, state, phone_e164 and
    email. The same rows with duplicate_of (the last survivor of the place, null for survivors) and
    matched_on. A survivor stays filed under the keys of the first row of its place; a row that
    led a place before has the values it had filled by then."""
    names = leads.columns
    fields = [f for f in leads.schema if f.name != "seq"]
    into = settle(places(leads))
    full = into.where("s <> seq").select("s").distinct()
    rows = leads.join(into.join(full, "s", "left_semi"), "seq")
    done = settle(_replayed(rows, fields, "lost"))
    none = {"duplicate_of": F.lit(None).cast("long"), "matched_on": F.lit(None).cast("string")}
    out = [*names, "duplicate_of", "matched_on"]
    first = done.select("now.*").withColumns(none)
    lost = done.select(c("now.seq").alias("duplicate_of"), F.explode("lost").alias("l")).select("l.row.*", "duplicate_of", c("l.on").alias("matched_on"))
    last = done.select("s", c("now.seq").alias("duplicate_of"), F.concat(F.array("now.seq"), F.transform("lost", lambda x: x["row"]["seq"])).alias("led"))
    others = rows.join(last, "s").where(~F.array_contains("led", c("seq")))
    alone = leads.join(rows.select("seq"), "seq", "left_anti").withColumns(none)
    return first.select(out).unionByName(lost.select(out)).unionByName(others.select(out)).unionByName(alone.select(out))


def related_locations(unique: DataFrame) -> DataFrame:
    """Survivors of dedupe_leads that share a domain, or a phone under different domains: each one with
    the first of its group by seq. A group of n gives n - 1 rows, not all pairs."""
    keys = F.array_compact(F.array(*(F.when(c(k).isNotNull(), F.struct(F.lit(n).alias("matched_on"), c(k).alias("value"))) for n, k in (("domain", "domain"), ("phone", "phone_e164")))))
    rows = unique.select("seq", F.explode(keys).alias("k")).select("seq", "k.*")
    hub = rows.groupBy("matched_on", "value").agg(F.min("seq").alias("first"), F.count("*").alias("members")).where("members > 1")
    return rows.join(hub, ["matched_on", "value"]).where("seq <> first").select("seq", "first", "matched_on", "members")


def compare(a: str, b: str) -> Column:
    """struct(verdict, matched_on) of two leads given as struct columns: duplicate,
    related_location or distinct."""
    x, y = (lambda f: c(f"{a}.{f}")), (lambda f: c(f"{b}.{f}"))
    same = lambda f: F.coalesce(x(f) == y(f), F.lit(False))
    name = same("name_normalized") | F.coalesce(S.name_similarity(x("name_normalized"), y("name_normalized")) >= 0.90, F.lit(False))
    city = F.coalesce(F.lower(x("city")) == F.lower(y("city")), F.lit(False)) & F.upper(x("state")).eqNullSafe(F.upper(y("state")))
    site = F.coalesce(F.regexp_replace(F.lower(x("website")), "/+$", "") == F.regexp_replace(F.lower(y("website")), "/+$", ""), F.lit(False))
    out = lambda verdict, on: F.struct(F.lit(verdict).alias("verdict"), F.lit(on).cast("string").alias("matched_on"))
    return (
        F.when(same("domain") & site & (name | city), out("duplicate", "website"))
        .when(same("domain") & name, out("duplicate", "domain+name"))
        .when(same("domain") & city, out("duplicate", "domain+city"))
        .when(same("domain"), out("related_location", "domain"))
        .when(name & city, out("duplicate", "company+city"))
        .when(name & same("phone_e164"), out("duplicate", "company+phone"))
        .when(same("phone_e164"), out("related_location", "phone"))
        .when(name & same("email"), out("duplicate", "company+email"))
        .otherwise(out("distinct", None))
    )
