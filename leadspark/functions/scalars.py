"""Normalisers and small rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide results and are stated as they are.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
NAME_NOISE = [
    "llc", "l l c", "inc", "inc.", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited",
    "plc", "pllc", "pc", "pa", "dds", "md", "dmd", "the", "official", "shop", "store", "usa", "us",
]
RESERVED_HANDLES = ["p", "reel", "reels", "explore", "stories", "accounts", "direct", "tv"]
SHARED_HOSTS = [
    "linktr.ee", "link.tree", "beacons.ai", "bio.link", "linkin.bio", "msha.ke", "taplink.cc", "lnk.bio", "solo.to",
    "campsite.bio", "linkpop.com", "many.link", "instagram.com", "facebook.com", "m.facebook.com",
    "business.facebook.com", "tiktok.com", "youtube.com", "twitter.com", "x.com", "wa.me", "api.whatsapp.com",
    "g.page", "goo.gl", "maps.google.com", "yelp.com", "booksy.com", "vagaro.com", "square.site", "squareup.com",
    "calendly.com", "sites.google.com",
]
ROLE_MAILBOXES = ["noreply", "no-reply", "donotreply", "postmaster", "abuse", "privacy"]
ROLES = [
    ("co_founder", r"\bco[-\s]?founder\b"),
    ("founder", r"\b(founder|co[-\s]?founder|founding partner)\b"),
    ("owner", r"\b(owner|proprietor|principal|practice owner)\b"),
    ("ceo", r"\b(chief executive|ceo|managing director|president)\b"),
    ("head_of_operations", r"\b(head of (operations|ops)|operations (director|manager|lead)|coo|director of operations)\b"),
    ("cx_director", r"\b(customer experience|cx (director|lead|manager)|head of customer)\b"),
    ("support_manager", r"\b(customer (support|service)|support (manager|lead)|service manager|patient coordinator|front office manager)\b"),
    ("marketing_director", r"\b(marketing (director|manager|lead|head)|cmo|growth (lead|manager))\b"),
]
RETRYABLE = ["rate_limit", "timeout", "provider_error", "network", "ai_schema"]


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ")

    return s.map(one)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def fold(c: Column) -> Column:
    """Without combining marks; ASCII values never reach Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _fold(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_name(c: Column) -> Column:
    plain = F.regexp_replace(fold(c), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", " ")
    return F.nullif(squeeze(F.regexp_replace(plain, "[|•·–—]+", " ")), F.lit(""))


def name_key(c: Column) -> Column:
    """Comparison key of a business name."""
    low = F.regexp_replace(F.replace(F.lower(clean_name(c)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(low, r"\s+"), lambda w: (w != "") & ~w.isin(NAME_NOISE))
    key = F.array_join(words, " ")
    for two, one in (("med spa", "medspa"), ("day spa", "dayspa"), ("be commerce", "ecommerce")):
        key = F.regexp_replace(key, rf"\b{two}\b", one)
    return F.nullif(key, F.lit(""))


def handle(c: Column) -> Column:
    trimmed = F.trim(c)
    inside = F.regexp_extract(trimmed, r"(?i)instagram\.com/([^/?#]+)", 1)
    bare = F.when(inside != "", inside).otherwise(trimmed)
    bare = F.regexp_replace(F.regexp_replace(bare, r"^@+", ""), r"/+$", "")
    bare = F.lower(F.trim(F.split_part(bare, F.lit("?"), F.lit(1))))
    return F.when(bare.rlike(r"^[a-z0-9._]{1,30}$") & ~bare.isin(RESERVED_HANDLES), bare)


def profile_url(c: Column) -> Column:
    return F.concat(F.lit("https://www.instagram.com/"), handle(c), F.lit("/"))


_URL = r"^(?i)(https?)://([^/?#:@]+)(?::\d+)?([^?#]*)(?:\?([^#]*))?"


def url(c: Column) -> Column:
    """Absolute, host in lower case, without tracking parameters, port, fragment and last slash."""
    raw = F.trim(c)
    raw = F.when((raw != "") & (raw != "-") & (F.lower(raw) != "n/a"), raw)
    raw = F.when(raw.rlike(r"^(?i)https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda i: F.regexp_extract(raw, _URL, i)
    host = F.lower(part(2))
    query = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(r"^(?i)(utm_|fbclid|gclid|mc_|ref|source)")), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    whole = F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), whole)


def host_of(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^[a-z]+://([^/?#]+)", 1), r"^www\.", "")


def is_shared_host(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(c), r"^www\.", "").isin(SHARED_HOSTS), F.lit(False))


def domain(c: Column) -> Column:
    host = host_of(url(c))
    return F.when(~host.isin(SHARED_HOSTS) & (host != ""), host)


def phone(c: Column, country: str = "1") -> Column:
    international = F.regexp_replace(c, r"[^0-9+]", "")
    digits = F.regexp_replace(c, r"[^0-9]", "")
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    same = national.isin([d * 10 for d in "0123456789"])
    plausible = (F.length(national) == 10) & ~national.rlike("^[01]") & ~same
    return (
        F.when(~c.rlike(r"(?i)ext|x\d{3,}") & F.trim(c).startswith("+") & international.rlike(r"^\+\d{8,15}$"), international)
        .when(plausible, F.concat(F.lit(f"+{country}"), national))
    )


def email(c: Column) -> Column:
    e = F.regexp_replace(F.lower(F.trim(c)), "^mailto:", "")
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$") & ~F.split_part(e, F.lit("@"), F.lit(1)).isin(ROLE_MAILBOXES), e)


def state(c: Column) -> Column:
    """Code, name, or the first name in declared order that a prefix of four letters fits."""
    upper = F.upper(F.trim(c))
    key = F.trim(F.regexp_replace(F.lower(fold(F.trim(c))), r"[^a-z\s]", ""))
    codes = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    first = F.coalesce(*(F.when(F.startswith(F.lit(n), key), F.lit(code)) for n, code in STATES.items()))
    known = F.try_element_at(codes, key)
    return F.when(upper.isin(list(STATES.values())), upper).when(known.isNotNull(), known).when(F.length(key) >= 4, first)


def city(c: Column) -> Column:
    plain = squeeze(F.regexp_replace(fold(c), r"[^\p{L}\s.'-]", " "))
    word = lambda w: F.when((F.length(w) > 2) | w.isin("st", "ft"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))).otherwise(w)
    return F.when(F.length(plain) >= 2, F.array_join(F.transform(F.split(F.lower(plain), " "), word), " "))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", ""), 1, 40)


def count(c: Column) -> Column:
    raw = F.regexp_replace(F.lower(c), r"[,\s]", "")
    number = F.regexp_extract(raw, r"^([0-9.]+)([km])?$", 1).try_cast("double")
    unit = F.regexp_extract(raw, r"^([0-9.]+)([km])?$", 2)
    return F.floor(number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0) + 0.5).cast("long")


def days_since(c: Column, now: str) -> Column:
    return F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c)) / 86400).cast("long")


def label_list(labels: Column) -> Column:
    """Trimmed labels of 2 to 120 characters, the first of each in any case."""
    ok = F.filter(F.transform(labels, squeeze), lambda x: (F.length(x) >= 2) & (F.length(x) <= 120))
    return F.aggregate(
        ok, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    )


def product_list(c: Column) -> Column:
    return F.coalesce(label_list(F.split(c, r"[,;|\n]")), F.array().cast("array<string>"))


def _quoted(term: str) -> str:
    return "".join("\\" + x if x in r".*+?^${}()|[]\/" else x for x in term)


def term_pattern(term: str) -> str:
    return rf"(^|[^a-z0-9]){_quoted(term)}([^a-z0-9]|$)"


def term_hits(haystack: Column, terms: list[str]) -> Column:
    """Which whole terms a lower-case text holds, in the order of the terms."""
    terms = [t.lower().strip() for t in terms if t.strip()]
    if not terms:
        return F.array().cast("array<string>")
    hits = F.array_compact(F.array(*(F.when(haystack.rlike(term_pattern(t)), F.lit(t)) for t in terms)))
    some = haystack.rlike("(^|[^a-z0-9])(" + "|".join(map(_quoted, terms)) + ")([^a-z0-9]|$)")
    return F.when(some, hits).otherwise(F.array().cast("array<string>"))


def name_similarity(a: Column, b: Column) -> Column:
    """Of two name keys: half edit distance, half word overlap."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    overlap = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * edit + 0.5 * overlap)))


def wording_seed(c: Column) -> Column:
    """A stable 32-bit number of an ASCII text: h * 33 + code of each character, from 5381."""
    step = lambda h, x: (h * 33 + F.ascii(x)) % 4294967296
    return F.aggregate(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), F.lit(5381).cast("long"), step)


def pick(variants: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in variants)), (seed % len(variants) + 1).cast("int"))


def role(title: Column) -> Column:
    out = F.when(title.isNull() | (title == ""), "unknown")
    for name, pattern in ROLES:
        out = out.when(title.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")


def error_type(status: Column, message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    has = lambda p: m.rlike(f"(?i){p}")
    return (
        F.when(status == 429, "rate_limit")
        .when((status == 408) | has("timeout|etimedout|esockettimedout|aborted"), "timeout")
        .when(status.isin(401, 403), "auth")
        .when(status.isin(400, 422), "validation")
        .when(status >= 500, "provider_error")
        .when(has("econnreset|enotfound|econnrefused|socket hang up|network"), "network")
        .when(has("schema|json|unexpected token|failed to parse"), "ai_schema")
        .when(has("rate limit|too many requests|quota"), "rate_limit")
        .otherwise("unknown")
    )


def backoff_ms(attempt: Column, base: int = 2000, cap: int = 300000) -> Column:
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))).cast("long")


#: Stage, position and whether it ends the way.
STAGES = [
    ("SCRAPED", 10, False), ("CLEANED", 20, False), ("ENRICHED", 30, False), ("QUALIFIED", 40, False), ("RESEARCHED", 50, False),
    ("MESSAGE_GENERATED", 60, False), ("PENDING_APPROVAL", 70, False), ("READY_FOR_OUTREACH", 80, False), ("DM_SENT", 90, False),
    ("REPLIED", 100, False), ("CONVERSATION", 110, False), ("INTERESTED", 120, False), ("NURTURE", 130, False),
    ("NOT_INTERESTED", 140, True), ("CLOSED", 150, True), ("DISQUALIFIED", 160, True),
]


def stage_position(stage: Column) -> Column:
    known = F.create_map(*(F.lit(x) for s, p, _ in STAGES for x in (s, p)))
    return F.coalesce(F.try_element_at(known, stage), F.lit(-1))


def next_stage(stage: Column) -> Column:
    path = [s for s, p, _ in STAGES if p <= 90]
    known = F.create_map(*(F.lit(x) for a, b in zip(path, path[1:]) for x in (a, b)))
    return F.try_element_at(known, stage)


def is_terminal(stage: Column) -> Column:
    return F.coalesce(stage.isin([s for s, _, end in STAGES if end]), F.lit(False))


def can_advance(a: Column, b: Column) -> Column:
    """Stages never go back."""
    return stage_position(b) >= stage_position(a)


#: The steps of a lead in order, each with the column of its time and the stage that does it.
STEPS = [
    ("Scraped", "discovered_at", None), ("Cleaned", "cleaned_at", "CLEANED"), ("Enriched", "enriched_at", "ENRICHED"), ("Qualified", "qualified_at", "QUALIFIED"),
    ("AI Research", "researched_at", "RESEARCHED"), ("Message Generated", "message_generated_at", "MESSAGE_GENERATED"), ("Approved", "approved_at", "PENDING_APPROVAL"),
    ("Sent", "first_sent_at", "READY_FOR_OUTREACH"), ("Replied", "replied_at", None),
]


def resume_stage() -> Column:
    """The first stage whose work has no time yet; none after the last, or for a lead that failed to qualify."""
    out: Column | None = None
    for _, at, stage in STEPS:
        if stage == "RESEARCHED":
            out = out.when(F.coalesce(~F.col("qualified"), F.lit(False)), F.lit(None).cast("string"))
        if stage:
            out = F.when(F.col(at).isNull(), stage) if out is None else out.when(F.col(at).isNull(), stage)
    return out


def progress() -> Column:
    """array<struct<step, done>> of a lead."""
    return F.array(*(F.struct(F.lit(step).alias("step"), F.col(at).isNotNull().alias("done")) for step, at, _ in STEPS))
