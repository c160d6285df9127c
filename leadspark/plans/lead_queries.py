"""Cleaning, scoring and identity over the derived raw rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import dealt, settle
from leadspark.config import rules as R
from leadspark.functions import scalars as S
from leadspark.operators import cleaning as CL
from leadspark.operators import dedup as DD
from leadspark.operators import identity as ID
from leadspark.operators import niches as N
from leadspark.operators import ordered_merge as OM
from leadspark.operators import relevance as RV
from leadspark.operators import scoring as SC
from leadspark.plans import scalar_queries as SQ
from leadspark.plans.inputs import table, with_sql

c = F.col


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows in the canonical shape."""
    return table(spark, sf_dir, "raw").select(
        "id",
        S.clean_name(c("name")).alias("business_name"),
        S.name_key(c("name")).alias("name_normalized"),
        S.handle(c("handle")).alias("instagram_handle"),
        S.domain(c("website")).alias("website_domain"),
        S.phone(c("phone")).alias("phone_e164"),
        S.email(c("email")).alias("email"),
        S.state(c("state")).alias("state"),
        S.city(c("city")).alias("city"),
        S.count(c("followers")).alias("ig_followers"),
        c("posts").alias("ig_posts"),
        c("following").alias("ig_following"),
        S.product_list(c("products")).alias("products_services"),
        "bio",
        "category",
        F.lit(None).cast("string").alias("website_description"),
        "niche",
        "title",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The derived rows are costly expressions, and cleaning reads its rows more than once.
    return CL.clean_leads(settle(leads(spark, sf_dir)))


#: Words of many niches, glued and bounded in different ways.
_SPOKEN = [
    "Dentist, botox", "med-spa or med spa", "CAT: dog harness!", "women's bags & women's accessories", "smart home robot vacuum", "dash cam.car care", "3D printer gadgets",
    "fashion blogger", "gym franchise", "replica watches", "IT services provider", "dogs and cats", "clothing brand; streetwear", "lash studio (brow bar)", "shop now free shipping",
    "sleep and intimates", "activewear/leggings", "loungewear_pajamas", "",
]
_NICHE_ROWS = {
    "id": "c_custkey",
    "niche": "case c_custkey % 16 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(R.NICHES)) + " end",
    "text": "lower(concat(case c_custkey % 19 " + " ".join("when {} then '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(_SPOKEN)) + " end, ' | ', c_mktsegment, ' ', case c_custkey % 17 "
    + " ".join("when {} then '{}'".format(i, _SPOKEN[i * 7 % 19].replace("'", "''")) for i in range(17)) + " end))",
    "category": "case c_custkey % 5 when 0 then 'Boutiques' when 1 then 'Petrol station' when 2 then 'Online Stores' when 3 then c_mktsegment end",
}


def _niche_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").selectExpr(*(f"{e} as {n}" for n, e in _NICHE_ROWS.items()))


def _niche_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.match_niches(_niche_rows(spark, sf_dir), N.term_table(spark, R.NICHES))
    return out.select("id", F.array_join("niche_hits", "|").alias("hits"), F.array_join("niche_negatives", "|").alias("negatives"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, n = S.count(c("followers")), c("posts")
    return table(spark, sf_dir, "raw").select(
        "id",
        F.round(SC.follower_score(f), 6).alias("followers"),
        F.round(SC.products_score(n), 6).alias("products"),
        F.round(SC.activity_score(n * 4), 6).alias("activity"),
        SC.band(n * 3).alias("band"),
        SC.location_score(S.state(c("state")), S.city(c("city")), R.CAMPAIGN["states"], R.CAMPAIGN["cities"]).alias("location"),
    )


def _icp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir).withColumns(
        {
            "niche_hit": F.size("niche_hits") > 0,
            "products_count": F.size("products_services"),
            "days_since_last_post": c("ig_posts") * 3,
            "contact_name": F.when(c("id") % 3 == 0, c("business_name")),
            "contact_role": F.when(S.role(c("title")) != "unknown", S.role(c("title"))),
            **{f"ai_{k}": (c("id") * m % 101).cast("double") for k, m in (("niche_fit", 7), ("business_quality", 11), ("website_quality", 13), ("cx_need", 17), ("outreach_potential", 19))},
        }
    )
    return SC.score_leads(rows).select("id", "icp_score", "band", "priority", "qualified", F.array_join("failures", "|").alias("failures"))


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ID.shared_domains(table(spark, sf_dir, "companies"), "company_id", "website_domain").select("website_domain", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ID.key_components(table(spark, sf_dir, "companies"), "company_id", {"website_domain": "website_domain", "phone_e164": "phone"})


#: Rows of a sheet: a dozen share sites, names and phones among them.
SHEET = {
    "seq": "c_custkey",
    "name_normalized": "case when c_custkey % 11 <> 0 then concat('glow shop ', cast(floor(c_custkey / 12) as string), case c_custkey % 3 when 0 then ' spa' when 1 then ' dental' else '' end) end",
    "website": "case c_custkey % 4 when 0 then concat('https://shop', cast(floor(c_custkey / 6) as string), '.com/') when 1 then concat('https://shop', cast(floor(c_custkey / 6) as string), '.com') end",
    "domain": "case when c_custkey % 4 <> 3 then concat('shop', cast(floor(c_custkey / 6) as string), '.com') end",
    "phone_e164": "case when c_custkey % 5 <> 0 then concat('+1', cast(floor(c_custkey / 4) as string)) end",
    "email": "case when c_custkey % 3 = 0 then lower(c_name) end",
    "state": "case when c_custkey % 7 <> 0 then 'CA' end",
    "city": "case c_custkey % 5 when 0 then 'Los Angeles' when 1 then 'los angeles' when 2 then 'San Diego' when 3 then 'Fresno' end",
}


def _v1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").selectExpr(*(f"{e} as {n}" for n, e in SHEET.items()))


def _v1_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.dedupe_leads(_v1_rows(spark, sf_dir))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.related_locations(settle(_v1_deduped(spark, sf_dir).where("duplicate_of is null").select("seq", "domain", "phone_e164")))


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).withColumnRenamed("id", "seq").withColumn("products_count", F.size("products_services").cast("long"))
    # The derived rows are costly expressions that the merge reads several times.
    return OM.dedupe_batch(settle(rows)).select("seq", "duplicate_of", "matched_on", "instagram_handle", "website_domain", "phone_e164", "products_count")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with a company name that may name another kind of business."""
    kind = F.expr(_KINDS)
    return table(spark, sf_dir, "raw").select("id", "niche", "bio", F.lit(None).cast("string").alias("industry"), "category", F.concat_ws(" ", "name", kind).alias("company_name"))


_KINDS = "case id % 11 when 0 then 'School of beauty' when 1 then 'Hotel' when 2 then 'cafe' when 3 then 'Dental Smile' when 4 then 'botox' when 5 then 'Dept' else null end"


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    match, kind = RV.relevance(F.when(c("niche") == "medspas", "medspa").otherwise("dental"), c("company_name"), F.coalesce("category", F.lit("")))
    return _typed(spark, sf_dir).select("id", match.alias("niche_match"), kind.alias("detected_type"))


def _exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, words = RV.exclusion("company_name", "category", "bio")
    return _typed(spark, sf_dir).select("id", kind.alias("kind"), words.alias("words"))


QUERIES = {
    "r01_exclusion": _exclusion,
    "r02_file_niche": lambda s, d: RV.file_niches(_typed(s, d), "niche"),
    "r03_relevance": _relevance,
    "d03_dedupe_batch": _deduped,
    "d08_dedupe_leads": _v1_deduped,
    "d08_related_locations": _related,
    "c01_personal": lambda s, d: cleaned(s, d).select("id", "personal_score", F.array_join("personal_signals", "|").alias("signals")),
    "c02_niche_match": _niche_match,
    "c03_location": lambda s, d: cleaned(s, d).select("id", "location_reason"),
    "c04_clean_leads": lambda s, d: cleaned(s, d).select("id", "keep", F.array_join("reasons", "|").alias("reasons"), "suspected_reseller", "follow_ratio_suspicious", "city_outside_list", F.array_join("niche_hits", "|").alias("hits")),
    "c05_drop_reasons": lambda s, d: CL.drop_reasons(cleaned(s, d)),
    "r04_score_parts": _scores,
    "r05_icp_score": _icp,
    "d01_identity_keys": lambda s, d: ID.identity_keys(leads(s, d), "id").select("id", "key_type", "key_value", "priority"),
    "d09_shared_domains": _shared,
    "d03_key_components": _components,
}

_B = "lower(coalesce(bio, ''))"
_E = SQ._EMAIL
_CITYX = f"case when length({SQ._CITY}) >= 2 then {SQ._CITY} end"
_CAMP = R.CAMPAIGN
_LEADS = with_sql("select id from raw").replace(
    " select id from raw",
    f""", {SQ._URLS},
 lead as (select id, niche, bio, category, title, posts, following, {SQ._clean('name')} as business_name, {SQ._key('name')} as name_key, {SQ._handle('handle')} as h, {SQ._DOMAIN} as domain, {SQ._PHONE} as phone_e164,
   {_E} as address, {SQ._STATE} as st, {_CITYX} as town, {SQ._COUNTED} as n,
   coalesce(list_filter(list_transform(regexp_split_to_array(products, '[,;|\\n]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) between 2 and 120), []) as prods0 from v),
 lead2 as (select *, list_filter(prods0, lambda x, i: list_position(list_transform(prods0, lambda y: lower(y)), lower(x)) = i) as prods from lead)""",
)


def _hit(text: str, terms: list[str]) -> str:
    each = ", ".join(f"case when regexp_matches({text}, '{_quote(S.term_pattern(t.lower()))}') then '{_quote(t.lower())}' end" for t in terms)
    return f"list_filter([{each}], lambda x: x is not null)"


def _quote(p: str) -> str:
    return p.replace("'", "''")


_TEXT = "lower(concat_ws(' \n ', coalesce(business_name, ''), coalesce(bio, ''), coalesce(category, ''), ''))"
_NICHE_TEXT = "lower(concat_ws(' \n ', coalesce(business_name, ''), coalesce(bio, ''), coalesce(category, ''), '', coalesce(array_to_string(prods, ' '), '')))"
_PS = " + ".join(
    [f"case when regexp_matches({_B}, '{_quote(p)}') then {w} else 0 end" for _, w, p in R.PERSONAL_BIO] + ["case when domain is null and category is null and len(prods) = 0 then 2 else 0 end"]
)
_PSIG = (
    "list_filter([" + ", ".join([f"case when regexp_matches({_B}, '{_quote(p)}') then '{k}' end" for k, _, p in R.PERSONAL_BIO] + ["case when domain is null and category is null and len(prods) = 0 then 'no_business_markers' end"])
    + "], lambda x: x is not null)"
)
_T = "lower(town)"
_LOC = (
    f"case when {_T} in {SQ._list(_CAMP['exclude_cities'])} then 'city_excluded' when st is null and {_T} in {SQ._list(_CAMP['cities'])} then 'city_match_state_unknown' when st is null then 'location_unknown'"
    f" when st not in {SQ._list(_CAMP['states'])} then 'state_outside_target' when town is not null and {_T} not in {SQ._list(_CAMP['cities'])} then 'state_match_city_outside_list' else 'state_match' end"
)


def _niche(kind: str) -> str:
    return "case niche " + " ".join(f"when '{k}' then {_hit(_NICHE_TEXT, r[kind])}" for k, r in R.NICHES.items()) + " end"


_CATHIT = "case niche " + " ".join(f"when '{k}' then regexp_matches(lower(category), '{_quote('|'.join(r['keywords']))}')" for k, r in R.NICHES.items()) + " end"
_CLEAN = f"""{_LEADS},
 f as (select *, {_PS} as ps, {_PSIG} as psig, {_LOC} as loc, {_niche('keywords')} as pos, {_niche('negative')} as neg, coalesce({_CATHIT}, false) as cathit,
   {_hit(_TEXT, R.BLOCKED_TERMS)} as blocked, regexp_matches({_TEXT}, '{'|'.join(R.RESELLER_PATTERNS)}') as reseller, regexp_matches({_TEXT}, '{'|'.join(R.FAN_PATTERNS)}') as fan from lead2),
 g as (select *, case when len(pos) = 0 and cathit then [lower(category)] else pos end as hits from f),
 cl as (select *, list_filter([case when business_name is null then 'missing_business_name' end, case when length(business_name) > 120 then 'name_too_long' end, case when h is null then 'missing_instagram' end,
   case when n < 300 then 'below_absolute_min_followers' end, case when n > 250000 then 'above_absolute_max_followers' end, case when posts < 6 then 'too_few_posts' end,
   case when len(blocked) > 0 then 'blocked_business_type' end, case when fan then 'fan_or_parody_account' end, case when ps >= 3 then 'personal_account' end,
   case when len(neg) > 0 then 'niche_negative_keyword' end, case when len(hits) = 0 and len(neg) = 0 then 'outside_target_niche' end,
   case when loc not in {SQ._list(CL.LOCATION_OK)} then 'outside_target_location' end], lambda x: x is not null) as reasons from g)"""


def _lerp(v: str, lo: float, hi: float, a: float, b: float) -> str:
    return f"greatest(0.0, least(100.0, {a} + ({v} - {lo})::double / {hi - lo} * {b - a}))"


_FS = f"case when n is null then 40.0 when n between 1000 and 10000 then 100.0 when n < 500 then 0.0 when n < 1000 then {_lerp('n', 500, 1000, 30, 95)} when n > 25000 then 20.0 else {_lerp('n', 10000, 25000, 95, 35)} end"
_ACT = "case when {d} is null then 50.0 when {d} <= 14 then 100.0 when {d} <= 45 then {a} when {d} <= 120 then {b} else 10.0 end"
_LS = f"case when st is null and town is null then 30.0 when st is not null and st not in {SQ._list(_CAMP['states'])} then 0.0 when {_T} in {SQ._list(_CAMP['cities'])} then 100.0 when st in {SQ._list(_CAMP['states'])} then 80.0 else 60.0 end"


def _act(d: str) -> str:
    return _ACT.format(d=d, a=_lerp(d, 14, 45, 100, 70), b=_lerp(d, 45, 120, 70, 20))


def _prod(k: str) -> str:
    return f"case when {k} is null or {k} = 0 then 50.0 when {k} < 2 then 25.0 when {k} >= 6 then 100.0 else {_lerp(k, 2, 6, 70, 100)} end"


_BAND = "case when {s} >= 85 then 'HIGH_PRIORITY' when {s} >= 70 then 'QUALIFIED' when {s} >= 55 then 'REVIEW' else 'NOT_QUALIFIED' end"
_ROLE = "title is not null and title <> ''"
_DM = f"case when id % 3 <> 0 or business_name is null then case when {_ROLE} then 45.0 else 20.0 end when ({_ROLE}) and address is not null then 100.0 when {_ROLE} then 85.0 else 65.0 end"
_WEB = "case when domain is null then 30.0 else least(100.0, 70 + case when len(prods) >= 2 then 15 else 0 end + case when address is not null then 5 else 0 end) end"
_SUM = (
    f"(14 * {_LS} + 15 * (0.4 * case when len(hits) > 0 then 100.0 else 50.0 end + 0.6 * (id * 7 % 101)) + 12 * {_FS} + 10 * {_prod('len(prods)')} + 12 * (id * 11 % 101) + 8 * {_act('(posts * 3)')}"
    f" + 5 * (0.5 * {_WEB} + 0.5 * (id * 13 % 101)) + 8 * {_DM} + 10 * (id * 17 % 101) + 6 * (id * 19 % 101))::double / 100"
)
_FAIL = f"list_filter([case when h is null then 'no_instagram' end, case when st is not null and st not in {SQ._list(_CAMP['states'])} then 'outside_target_state' end, case when n < 300 then 'below_absolute_min_followers' end, case when n > 250000 then 'above_absolute_max_followers' end], lambda x: x is not null)"

def _when(text: str, rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '(?i){p}') then '{n}'" for n, p in rules) + " end"


_TYPED = with_sql("select 1 from raw").replace(" select 1 from raw", f", ty as (select id, niche, bio, category, concat_ws(' ', name, {_KINDS}) as company_name from raw)")
_XT = "concat_ws(' ', company_name, nullif(category, ''), nullif(bio, ''))"
_NT = "concat_ws(' ', coalesce(category, ''), '')"
_RT = "concat_ws(' ', company_name, coalesce(category, ''))"
_EXP = "case niche when 'medspas' then regexp_matches({0}, '(?i){1}') else regexp_matches({0}, '(?i){2}') end".format(_RT, RV.EXPECTED["medspa"], RV.EXPECTED["dental"])
_BEST = "greatest(" + ", ".join(RV.EXPECTED) + ")"

_TERMS = ", ".join("('{}', '{}', {}, '{}')".format(k, kind, i, _quote(t.lower())) for k, r in R.NICHES.items() for kind in ("keywords", "negative") for i, t in enumerate(r[kind]))
_OWN_NICHE = (
    f"with terms(niche, kind, place, term) as (values {_TERMS}), r as (select {', '.join(f'{e} as {n}' for n, e in _NICHE_ROWS.items())} from customer),"
    " m as (select id, category, kind, place, term, regexp_matches(text, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') as held, contains(lower(category), term) as fits from r left join terms using (niche)),"
    " s as (select id, category, coalesce(string_agg(term, '|' order by place) filter (where held and kind = 'keywords'), '') as hits, coalesce(string_agg(term, '|' order by place) filter (where held and kind = 'negative'), '') as negatives,"
    " coalesce(bool_or(fits and kind = 'keywords'), false) as by_category from m group by 1, 2)"
)

ORACLES = {
    "c02_niche_match": f"{_OWN_NICHE} select id, case when hits = '' and by_category then lower(category) else hits end as hits, negatives from s",
    "r01_exclusion": f"{_TYPED} select id, kind, case kind " + " ".join(f"when '{n}' then regexp_extract({_XT}, '(?i){p}')" for n, p in RV.EXCLUSIONS) + f" end as words from (select *, {_when(_XT, RV.EXCLUSIONS)} as kind from ty) t",
    "r02_file_niche": f"{_TYPED}, v as (select niche, count(*) as n_rows, " + ", ".join(f"count(*) filter (where regexp_matches({_NT}, '(?i){p}')) as {n}" for n, p in RV.EXPECTED.items())
    + f" from ty group by 1) select niche, case when {_BEST} = 0 or {_BEST} < 0.3 * n_rows then 'generic' " + " ".join(f"when {n} = {_BEST} then '{n}'" for n in RV.EXPECTED)
    + f" end as niche_key, case when {_BEST} = 0 or {_BEST} < 0.3 * n_rows then 'LOW' when {_BEST} > 0.6 * n_rows then 'HIGH' else 'MEDIUM' end as confidence, {_BEST} as matched from v",
    "r03_relevance": f"{_TYPED}, w as (select *, coalesce({_when('company_name', RV.TYPES)}, {_when('category', RV.TYPES)}) as wrong, {_EXP} as ok from ty)"
    " select id, case when wrong is not null then 'OFF_NICHE' when ok then 'IN_NICHE' else 'UNCERTAIN' end as niche_match, case when wrong is not null then wrong when ok then case niche when 'medspas' then 'medspa' else 'dental' end end as detected_type from w",
    "c01_personal": f"{_CLEAN} select id, ps as personal_score, array_to_string(psig, '|') as signals from cl",
    "c03_location": f"{_CLEAN} select id, loc as location_reason from cl",
    "c04_clean_leads": f"{_CLEAN} select id, len(reasons) = 0 as keep, array_to_string(reasons, '|') as reasons, reseller as suspected_reseller, coalesce(n > 0 and following / nullif(n, 0) > 3, false) as follow_ratio_suspicious, loc = 'state_match_city_outside_list' as city_outside_list, array_to_string(hits, '|') as hits from cl",
    "c05_drop_reasons": f"{_CLEAN} select reason, count(*) as n from (select unnest(reasons) as reason from cl) t group by 1",
    "r04_score_parts": f"{_LEADS} select id, round({_FS}, 6) as followers, round({_prod('posts')}, 6) as products, round({_act('(posts * 4)')}, 6) as activity, {_BAND.format(s='(posts * 3)')} as band, {_LS} as location from lead2",
    "r05_icp_score": f"""{_CLEAN}, sc as (select id, cast(floor(greatest(0, least(100, {_SUM})) + 0.5) as int) as icp_score, {_FAIL} as fail from cl),
 sb as (select *, case when len(fail) > 0 then 'NOT_QUALIFIED' else {_BAND.format(s='icp_score')} end as band from sc)
 select id, icp_score, band, case band when 'HIGH_PRIORITY' then 'high' when 'QUALIFIED' then 'medium' when 'REVIEW' then 'low' else 'none' end as priority,
   len(fail) = 0 and icp_score >= 70 and band in ('HIGH_PRIORITY', 'QUALIFIED') as qualified, array_to_string(fail, '|') as failures from sb""",
    "d01_identity_keys": f"""{_LEADS} select id, k.key_type as key_type, k.key_value as key_value, k.priority as priority from (select id, unnest([
   {{'key_type': 'instagram_handle', 'key_value': h, 'priority': 0}}, {{'key_type': 'website_domain', 'key_value': domain, 'priority': 1}}, {{'key_type': 'phone_e164', 'key_value': phone_e164, 'priority': 3}},
   {{'key_type': 'email', 'key_value': address, 'priority': 4}}, {{'key_type': 'name_city', 'key_value': name_key || '|' || lower(coalesce(town, '')) || '|' || upper(coalesce(st, '')), 'priority': 5}}]) as k from lead2) t where k.key_value is not null""",
    "d09_shared_domains": with_sql("select website_domain, count(*) as n, string_agg(cast(company_id as string), ',' order by company_id) as members from companies where website_domain is not null group by 1 having count(*) > 1"),
}
