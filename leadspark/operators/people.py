"""Contacts: from pages (E1), from provider rows (IO4), one addressee a company (D10), accounts of a business (E5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.config import evidence as EV
from leadspark.functions import scalars as S

c = F.col
# Patterns of mailboxes, phones, people and products in pages.
MAIL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
PHONE = r"\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
_ROLE = r"((?:founder|co-?founder|owner|ceo|president|director|head of [a-z ]+|manager|partner|dr\.?)[a-z ]*)"
_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})"
PEOPLE = [(rf"(?i){_NAME}\s*[,|\-–—]\s*{_ROLE}", 1, 2), (rf"(?i){_ROLE}\s*[:|\-–—]\s*{_NAME}", 2, 1)]
PRODUCTS = [
    r"(?i)<(?:h2|h3|a)[^>]*class=[\"'][^\"']*(?:product|service|treatment|collection)[^\"']*[\"'][^>]*>([^<]{3,80})<",
    r'(?i)"(?:product_?name|title)"\s*:\s*"([^"]{3,80})"',
]
NOT_ACCOUNTS = [
    "p", "reel", "reels", "explore", "stories", "accounts", "direct", "tv", "about", "developer", "legal", "privacy", "terms", "sharer", "share",
    "web", "api", "oauth", "help", "press", "blog", "igtv", "challenge", "emails", "invites",
]


def _plain(html: Column) -> Column:
    for cut in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", "<[^>]+>"):
        html = F.regexp_replace(html, f"(?i){cut}", " ")
    return S.squeeze(F.replace(F.replace(html, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def _placed(rows: DataFrame, values: Column) -> DataFrame:
    return rows.select("lead_id", "page_no", F.posexplode(values).alias("pos", "value"))


def _firsts(rows: DataFrame, by: str) -> DataFrame:
    """Each value of a lead once, with the place where it was first."""
    return rows.where(c(by).isNotNull()).groupBy("lead_id", by).agg(F.min(F.struct("page_no", "pos")).alias("at"))


def page_contacts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E1. pages: lead_id, page_no, html, ok. (people, company facts): people once for each name in
    any case, with the first mailbox of the lead that holds a part of the name; of the lead itself
    the first mailbox, phone and description, and all products."""
    rows = pages.where(F.coalesce(c("ok"), F.lit(False)) & c("html").isNotNull()).withColumn("text", _plain(c("html")))
    mails = _firsts(_placed(rows, F.regexp_extract_all("text", F.lit(MAIL), F.lit(0))).withColumn("email", S.email(c("value"))), "email")
    phones = _firsts(_placed(rows, F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).withColumn("phone", S.phone(c("value"))), "phone")
    goods = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in PRODUCTS))
    goods = _placed(rows, goods).withColumn("label", S.squeeze(c("value"))).where(F.length("label").between(2, 120)).withColumn("low", F.lower("label"))
    goods = goods.groupBy("lead_id", "low").agg(F.min(F.struct("page_no", "pos", "label")).alias("at"))

    found = lambda i, p, name, title: F.transform(
        F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(name)).alias("name"), F.regexp_extract_all("text", F.lit(p), F.lit(title)).alias("title")),
        lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title")),
    )
    both = _placed(rows, F.concat(*(found(i, *p) for i, p in enumerate(PEOPLE))))
    named = both.select("lead_id", "page_no", "pos", S.squeeze(c("value.name")).alias("full_name"), S.squeeze(c("value.title")).alias("title"))
    named = named.where(F.size(F.split("full_name", " ")) <= 3).withColumn("low", F.lower("full_name"))
    people = named.groupBy("lead_id", "low").agg(F.min(F.struct("page_no", "pos", "full_name", "title")).alias("x")).select("lead_id", "low", "x.full_name", "x.title")

    parts = F.filter(F.split("low", " "), lambda w: F.length(w) > 2)
    holds = F.exists(parts, lambda w: F.split_part("email", F.lit("@"), F.lit(1)).contains(w))
    theirs = people.join(mails, "lead_id").where(holds).groupBy("lead_id", "low").agg(F.min_by("email", "at").alias("email"))
    words = F.split("full_name", " ")
    people = people.join(theirs, ["lead_id", "low"], "left").select(
        "lead_id", "full_name", F.element_at(words, 1).alias("first_name"), F.element_at(words, -1).alias("last_name"),
        F.regexp_replace("title", r"^\W+|\W+$", "").alias("title"), S.role(c("title")).alias("role_category"), "email",
        F.lit("website_scrape").alias("source"), F.lit(0.55).alias("source_confidence"),
    )

    told = F.when(c("html").rlike(f"(?i){EV.DESCRIPTION}"), F.substring(S.squeeze(F.regexp_extract("html", f"(?i){EV.DESCRIPTION}", 1)), 1, 400))
    told = F.nullif(told, F.lit(""))
    facts = rows.select("lead_id", "page_no", told.alias("told")).groupBy("lead_id").agg(F.min_by("told", F.when(c("told").isNotNull(), c("page_no"))).alias("website_description"))
    one = lambda df, k: df.groupBy("lead_id").agg(F.min_by(k, "at").alias(k))
    listed = goods.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["label"]).alias("products"))
    facts = facts.join(one(mails, "email"), "lead_id", "left").join(one(phones, "phone").withColumnRenamed("phone", "phone_e164"), "lead_id", "left")
    return people, facts.join(listed, "lead_id", "left").withColumn("products", F.coalesce("products", F.array().cast("array<string>")))


def provider_contacts(payloads: DataFrame) -> DataFrame:
    """IO4. payloads: company_id and people, an array of structs (name, first_name, last_name, title,
    seniority, email, phone_numbers, linkedin_url). Locked mailboxes are no mailboxes, but still
    count for confidence."""
    p = payloads.select("company_id", F.posexplode("people").alias("seq", "p")).select("company_id", "seq", "p.*")
    joined = F.nullif(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))), F.lit(""))
    return p.select(
        "company_id", "seq", F.coalesce("name", joined).alias("full_name"), "first_name", "last_name", "title", S.role(c("title")).alias("role_category"), "seniority",
        F.when((c("email") != "") & ~c("email").rlike("(?i)email_not_unlocked"), c("email")).alias("email"),
        F.get("phone_numbers", F.lit(0)).alias("phone"), "linkedin_url", F.lit("apollo").alias("source"),
        F.when(F.coalesce("email", F.lit("")) != "", 0.9).otherwise(0.7).alias("source_confidence"),
    )


def upsert_contacts(known: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Known and found contacts (company_id, seq (unique there), full_name, email, title) as one table: one row
    for each company and mailbox in any case (the newest values stand), rows without a mailbox once
    for each name; `primary` marks one row of the person chosen (company_id, full_name) by company,
    the first by seq."""
    both = known.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    key = F.coalesce(F.concat(F.lit("@"), F.lower("email")), F.concat(F.lit("#"), F.lower("full_name")), F.concat(F.lit("?"), c("seq").cast("string")))
    names = [n for n in known.columns if n != "company_id"]
    newest = F.max_by(F.struct(*names), F.struct("_new", -c("seq"))).alias("x")
    rows = both.groupBy("company_id", key.alias("_key")).agg(newest).select("company_id", "x.*")
    pick = chosen.select("company_id", c("full_name").alias("_chosen"))
    rows = rows.join(pick, "company_id", "left").withColumn("_is", F.coalesce(c("full_name") == c("_chosen"), F.lit(False)))
    first = F.min(F.when(c("_is"), c("seq"))).over(Window.partitionBy("company_id"))
    return rows.withColumn("primary", c("_is") & (c("seq") == first)).drop("_is", "_chosen")


def _accounts(values: Column) -> Column:
    handles = F.transform(values, lambda v: S.handle(v))
    return F.array_distinct(F.filter(handles, lambda h: h.isNotNull() & ~h.isin(NOT_ACCOUNTS) & (F.length(h) >= 3)))


def accounts(leads: DataFrame) -> DataFrame:
    """E5. leads: lead_id, company_name, domain, instagram, contact_name, website_reachable, first_url,
    and `instagrams`, the few accounts linked from the website, in page order. Adds the account of the
    business with confidence and reason, alternates in rank order, a guess by the domain (never taken
    as the account), and the account of the contact."""
    none = F.array().cast("array<string>")
    rows = leads.withColumns({"site": F.coalesce(_accounts(c("instagrams")), none), "given": F.coalesce(_accounts(F.array("instagram")), none)})
    rows = rows.withColumns({"_key": S.name_key(c("company_name")), "_guess": S.slug(F.split_part(F.coalesce("domain", F.lit("")), F.lit("."), F.lit(1)))})
    rows = rows.withColumns({"_name": S.slug(c("_key")), "_who": S.name_key(c("contact_name"))})
    each = rows.select("lead_id", "_key", "_guess", "_name", "_who", F.posexplode("site").alias("pos", "h"))
    each = each.withColumns({"_h": F.regexp_replace("h", "[._]", ""), "_hk": S.name_key(F.regexp_replace("h", "[._]", " "))})
    meets = lambda x: (F.coalesce(c(x), F.lit("")) != "") & (c("_h").contains(c(x)) | c(x).contains(c("_h")))
    score = F.when(meets("_guess"), 3).otherwise(0) + F.when(meets("_name"), 2).otherwise(0) + S.name_similarity(c("_hk"), c("_key"))
    each = each.withColumns({"score": score, "person": S.name_similarity(c("_hk"), c("_who")) >= 0.6})
    ranked = each.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct((-c("score")).alias("less"), "pos", "h", "person"))).alias("ranked"))
    rows = rows.drop("_key", "_name", "_who").join(ranked, "lead_id", "left")
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    n = F.coalesce(F.size("ranked"), F.lit(0))
    rows = rows.withColumn("_n", F.when(n > 0, n).otherwise(0)).withColumn("_clear", F.coalesce(second["less"] - top["less"] >= 1.5, F.lit(True)))
    guess = c("domain").isNotNull() & (F.length("_guess") >= 3)
    text = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    url = F.coalesce("first_url", text("https://", c("domain")), F.lit("null"))
    linked = text("Linked from the company's own website (", url, ")")
    names = F.array_join(F.transform("ranked", lambda x: x["h"]), ", ")
    why = (
        F.when(c("_n") == 1, text(linked, "."))
        .when((c("_n") > 1) & c("_clear"), text(linked, "; chosen over ", (c("_n") - 1).cast("string"), " other linked account(s) because it matches the company name and domain."))
        .when(c("_n") > 1, text("The website links ", c("_n").cast("string"), " Instagram accounts (", names, ") and none clearly belongs to the business over the others. Needs a human to pick."))
        .when(F.size("given") > 0, text("Supplied in the source file ", c("source_file"), " row ", c("original_row").cast("string"), "; not confirmed against the company's website."))
        .when(guess, text("No Instagram link found on ", c("domain"), ' and none in the source file. "@', c("_guess"), '" is a guess from the domain name and has NOT been verified - check it before using it.'))
        .when(c("domain").isNotNull(), text("No Instagram link found on the pages read from ", c("domain"), F.when(c("website_reachable"), "").otherwise(" (the site could not be read)"), ", and none supplied in the source file."))
        .otherwise("No website in the source file and no Instagram supplied, so there was nothing to search.")
    )
    out = rows.withColumns(
        {
            "business_instagram": F.coalesce(top["h"], F.get("given", F.lit(0))),
            "instagram_confidence": F.when((c("_n") > 0) & c("_clear"), "HIGH").when((c("_n") > 1) | (F.size("given") > 0), "MEDIUM").when(guess, "LOW").otherwise("NOT_FOUND"),
            "instagram_evidence": why,
            "instagram_alternates": F.coalesce(F.transform(F.slice("ranked", F.lit(2), F.greatest(F.size("ranked"), F.lit(0))), lambda x: x["h"]), none),
            "instagram_candidate": F.when((c("_n") == 0) & (F.size("given") == 0) & guess, c("_guess")),
        }
    )
    own = F.array_sort(F.transform(F.filter("ranked", lambda x: x["person"] & (x["h"] != c("business_instagram"))), lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"))))
    out = out.withColumn("owner_instagram", F.when(c("contact_name").isNotNull(), F.get(own, F.lit(0))["h"]))
    sure = F.when(c("owner_instagram").isNotNull(), "MEDIUM").otherwise("NOT_FOUND")
    return out.withColumn("owner_instagram_confidence", sure).drop("site", "given", "ranked", "_n", "_clear", "_guess")
