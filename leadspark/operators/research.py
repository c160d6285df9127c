"""What the pages of a lead's website show, and the signals read from it.

Pages have lead_id, page_no, url, label, html, ok, status and error. Facts of a page are one
projection; only they are shuffled, never the page. A lead's pages are counted by sums, and its
lists keep the first few distinct values in page order by a group limit, so a lead of very many
pages needs no more memory than one of few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.config import evidence as EV
from leadspark.functions import texts as X
from leadspark.operators.v1 import _number as number

c = F.col
KINDS = {k: [name for name, kind, _ in EV.TECHNOLOGIES if kind == k] for k in ("ecommerce", "support", "booking")}


def _has(text: str, pattern: str) -> Column:
    return F.coalesce(c(text).rlike(f"(?i){pattern}"), F.lit(False))


def _all(pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all("html", F.lit(f"(?i){pattern}"), F.lit(1)), F.array().cast("array<string>"))


def _captured(pattern: str, most: int) -> Column:
    found = F.regexp_replace(F.regexp_extract("html", f"(?i){pattern}", 1), r"^\s+|\s+$", "")
    return F.when((c("label") == "homepage") & _has("html", pattern), F.substring(found, 1, most))


def _present(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of each page; null or empty pages, and those not ok, count as failed."""
    readable = F.coalesce(c("ok"), F.lit(False)) & (F.coalesce(c("html"), F.lit("")) != "")
    rows = pages.withColumn("readable", readable).withColumn("html", F.when(c("readable"), c("html")))
    rows = rows.withColumn("text", X.page_text(c("html")))
    found = {"call": EV.CALL, "book": EV.BOOKING, "hires": EV.HIRING, "role": EV.SUPPORT_ROLES, "hours": EV.AFTER_HOURS}
    rows = rows.withColumns({k: X.place(c("text"), p) for k, p in found.items()})
    rows = rows.withColumns({k: X.snippet(c("text"), c(k)) for k in found})
    rows = rows.withColumn("technologies", _present(*(F.when(_has("html", p), name) for name, _, p in EV.TECHNOLOGIES)))
    return rows.select(
        "lead_id", "page_no", "url", "label", "readable", "status", "error", "technologies", "call", "book", "hires", "role",
        F.when(~_has("hours", EV.NOT_AFTER_HOURS), c("hours")).alias("hours"),
        _captured(EV.TITLE, 200).alias("title"),
        _captured(EV.DESCRIPTION, 400).alias("description"),
        F.coalesce(F.regexp_count(F.lower("html"), F.lit(EV.PRODUCT_LINK)), F.lit(0)).alias("product_links"),
        _has("html", EV.CART).alias("cart"),
        (_has("text", EV.RETURNS) & _has("html", EV.RETURNS_LINK)).alias("returns"),
        F.transform(_all(EV.MAILTO), F.lower).alias("mailtos"),
        _has("html", EV.FORM).alias("form"),
        _has("text", EV.HELP).alias("help"),
        _all(EV.TEL).alias("tels"),
        (c("readable") & ((F.coalesce(c("label"), F.lit("")) == "careers") | _has("html", EV.CAREERS_LINK))).alias("careers"),
        *(F.filter(_all(p), lambda v: v != "").alias(k) for k, p in EV.SOCIALS.items()),
    )


def _entries() -> Column:
    """All listed values of a page as array<struct<kind, pos, value>>."""
    tech = lambda kind: F.filter("technologies", lambda t: t.isin(*KINDS[kind]))
    lists = {
        "technology": c("technologies"),
        "channel": _present(
            F.when(F.size(tech("support")) > 0, "live chat"),
            F.when(c("returns"), "returns/refunds policy"),
            F.when(F.size("mailtos") > 0, "email"),
            F.when(c("form"), "contact form"),
            F.when(c("help"), "help centre or customer service page"),
            F.when(F.size("tels") > 0, "phone"),
        ),
        "shop": F.concat(
            F.transform(tech("ecommerce"), lambda t: F.concat(t, F.lit(" detected on "), c("url"))),
            _present(F.when(c("cart"), F.concat(F.lit("cart or checkout markup present on "), c("url")))),
        ),
        "email": c("mailtos"),
        "number": F.transform("tels", lambda t: F.regexp_replace(t, r"[^\d+]", "")),
        "call": _present(c("call")),
        "book": _present(c("book")),
        "hiring": _present(c("hires"), F.when(c("has_role"), c("role"))),
        "hours": _present(c("hours")),
        "chat": tech("support"),
        "booking": tech("booking"),
        **{k: c(k) for k in EV.SOCIALS},
    }
    tagged = lambda k: lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), x.alias("value"))
    return F.flatten(F.array(*(F.transform(v, tagged(k)) for k, v in lists.items())))


def lead_evidence(facts: DataFrame) -> DataFrame:
    """One row for each lead with pages. A role counts as hiring once a careers page or words
    about hiring were seen, on this page or before. The facts are stored: sums and lists both read
    them, and a page is parsed once."""
    before = Window.partitionBy("lead_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stored(facts).withColumn("seen", F.max("careers").over(before))
    rows = rows.withColumn("has_role", c("role").isNotNull() & (c("seen") | c("hires").isNotNull()))
    ok = c("readable")
    first = lambda v, when: F.min_by(v, F.when(when, c("page_no")))
    sums = rows.groupBy("lead_id").agg(
        F.max("readable").alias("website_reachable"),
        F.count(F.when(ok, 1)).alias("pages_read"),
        F.count(F.when(~ok, 1)).alias("pages_failed"),
        first("url", ok).alias("first_url"),
        first(F.coalesce(c("status").cast("string"), c("error")), ~ok).alias("first_failure"),
        F.max_by("title", F.when(c("title").isNotNull(), c("page_no"))).alias("title"),
        F.max_by("description", F.when(c("description").isNotNull(), c("page_no"))).alias("description"),
        F.sum("product_links").alias("product_links"),
        F.max("cart").alias("has_cart"),
        F.max("returns").alias("has_returns_page"),
        F.sum(F.size("mailtos")).alias("mailto_count"),
        F.max("form").alias("contact_form"),
        F.max("help").alias("help_center"),
        F.sum(F.size("tels")).alias("tel_links"),
        F.max("careers").alias("careers_page"),
        F.max("has_role").alias("support_roles"),
    )
    long = rows.select("lead_id", "page_no", F.explode(_entries()).alias("e")).select("lead_id", "page_no", "e.*")
    at = F.struct("page_no", "pos")
    once = long.groupBy("lead_id", "kind", "value", F.when(c("kind") == "shop", at).alias("_copy")).agg(F.min(at).alias("at"))
    rank = F.row_number().over(Window.partitionBy("lead_id", "kind").orderBy("at"))
    most = F.create_map(*(F.lit(x) for pair in EV.KEPT.items() for x in pair))
    few = once.withColumn("_r", rank).where(c("_r") <= max(EV.KEPT.values())).where(c("_r") <= most[c("kind")])
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(c("kind") == k, F.struct("_r", "value")))), lambda s: s["value"])
    lists = few.groupBy("lead_id").agg(*(listed(k).alias(k) for k in EV.KEPT))
    none = F.array().cast("array<string>")
    out = sums.join(lists, "lead_id", "left").withColumns({k: F.coalesce(c(k), none) for k in EV.KEPT})
    note = F.concat(
        F.lit("Website did not return a readable page ("), F.coalesce("first_failure", F.lit("null")),
        F.lit("). Many small-business sites block automated requests; this is not evidence about the business itself."),
    )
    return out.withColumns(
        {
            "ecommerce": F.exists("technology", lambda t: t.isin(*KINDS["ecommerce"])),
            "chat_widget": F.get("chat", F.lit(0)),
            "booking_platform": F.get("booking", F.lit(0)),
            "notes": F.when(~c("website_reachable") & (c("pages_failed") > 0), note),
        }
    ).drop("chat", "booking")


def with_evidence(leads: DataFrame, evidence: DataFrame) -> DataFrame:
    """Leads with the columns of their evidence; without pages all counts are 0 and lists empty."""
    rows = leads.join(evidence, "lead_id", "left")
    zero = {"long": F.lit(0).cast("long"), "boolean": F.lit(False), "array": F.array().cast("array<string>")}
    kinds = {f.name: f.dataType.typeName() for f in evidence.schema if f.name != "lead_id"}
    return rows.withColumns({n: F.coalesce(c(n), zero[k]) for n, k in kinds.items() if k in zero})


def summary() -> Column:
    """A factual paragraph of a lead with evidence."""
    some = lambda k: F.size(k) > 0
    joined = lambda head, k: F.when(some(k), F.concat(F.lit(head), F.array_join(k, ", "), F.lit(".")))
    socials = _present(*(F.when(some(k), k) for k in EV.SOCIALS))
    links = F.when(c("product_links") > 0, F.concat(F.lit(" with "), c("product_links").cast("string"), F.lit(" product link(s)"))).otherwise("")
    named = F.when(F.coalesce(c("title"), F.lit("")) != "", F.concat(F.lit('"'), "title", F.lit('"'))).otherwise(c("domain"))
    read = F.concat_ws(
        " ",
        F.concat(named, F.lit(" - read "), c("pages_read").cast("string"), F.lit(" page(s).")),
        joined("Technologies detected: ", "technology"),
        joined("Contact channels present: ", "channel"),
        F.when(c("tel_links") > 0, F.concat(c("tel_links").cast("string"), F.lit(" click-to-call link(s) on the pages read."))),
        F.when(c("booking_platform").isNotNull(), F.concat(F.lit("Online booking via "), "booking_platform", F.lit(".")))
        .when(some("book"), "Booking language present but no booking platform identified."),
        F.when(c("ecommerce"), F.concat(F.lit("E-commerce platform present"), links, F.lit("."))),
        F.when(c("careers_page"), F.concat(F.lit("Careers or jobs page found"), F.when(c("support_roles"), ", mentioning customer-facing roles").otherwise(""), F.lit("."))),
        F.when(some("hours"), "After-hours or 24/7 availability mentioned."),
        F.when(F.size(socials) > 0, F.concat(F.lit("Social links: "), F.array_join(socials, ", "), F.lit("."))),
    )
    return (
        F.when(c("domain").isNull(), F.concat(F.lit("No website listed in "), "source_file", F.lit(", so only the spreadsheet's own fields were available.")))
        .when(~c("website_reachable"), F.coalesce("notes", F.concat("domain", F.lit(" could not be read."))))
        .otherwise(read)
    )


def signals() -> Column:
    """array<struct<signal, evidence, interpretation, confidence, source>> of a lead with evidence, in order."""
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    quoted = lambda head, k: text(head, F.coalesce(F.get(k, F.lit(0)), F.lit("")), '"')
    many = lambda n: c(n).cast("string")
    site = F.coalesce("first_url", F.concat(F.lit("https://"), "domain"))
    file = text(c("source_file"), " row ", many("original_row"))
    category = F.concat_ws(" ", "category", "industry")
    heavy, led = category.rlike(f"(?i){EV.PHONE_HEAVY}"), category.rlike(f"(?i){EV.APPOINTMENT_LED}")
    shown = F.coalesce("category", F.lit("null"))
    phones, site_read = c("tel_links") > 0, c("website_reachable")
    books, platform = F.size("book") > 0, c("booking_platform").isNotNull()
    rated = F.when(F.coalesce(c("rating"), F.lit(0)) != 0, text(" at ", number(c("rating")), " stars")).otherwise("")

    def one(when: Column, name: str, evidence: Column | str, reading: str, confidence: Column | str, source: Column) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        fields = {"signal": lit(name), "evidence": lit(evidence), "interpretation": lit(reading), "confidence": lit(confidence), "source": source}
        return F.when(when, F.struct(*(v.alias(k) for k, v in fields.items())))

    # Names and wording of the signals.
    return _present(
        one(phones, "Phone is a prominent contact channel",
            text(many("tel_links"), " click-to-call link", F.when(c("tel_links") == 1, "").otherwise("s"), " across the ", many("pages_read"), " page(s) read."),
            "Phone appears to be an important way customers reach this business.", F.when(c("tel_links") >= 3, "HIGH").otherwise("MEDIUM"), site),
        one(~phones & c("phone_e164").isNotNull() & ~site_read, "Phone number published",
            text("A phone number is listed in the source data (", c("phone"), "), and the website could not be read to say more."),
            "Phone may be a customer contact channel; this has not been confirmed on the website.", "LOW", file),
        one(F.size("call") > 0, "Call-to-action asks customers to phone", quoted('Website text includes: "', "call"),
            "The business directs customers to the phone as a primary next step.", "HIGH", site),
        one(platform, "Appointment booking in use", text("Booking platform detected: ", c("booking_platform"), "."),
            "The business runs on scheduled appointments, so booking and rescheduling enquiries are part of its normal workload.", "HIGH", site),
        one(~platform & books, "Appointment-led customer journey", quoted('Website text includes: "', "book"),
            "Appointments appear central to how customers transact, though no booking platform was identified.", "MEDIUM", site),
        one(~platform & ~books & led, "Appointment-based business category", text('The source file lists the category as "', shown, '".'),
            "Businesses of this type are usually appointment-led, which normally implies inbound booking enquiries.", "LOW", file),
        one(F.size("hours") > 0, "After-hours availability advertised", quoted('Website text includes: "', "hours"),
            "The business advertises availability outside standard hours, so coverage outside office hours is part of its offer.", "HIGH", site),
        one(heavy & ~phones, "Phone-heavy business category", text('Category "', shown, '" in ', file, "."),
            "This category typically handles a meaningful share of enquiries by phone.", "LOW", file),
        one(c("ecommerce"), "Sells online", F.array_join("shop", "; "), "Online selling normally brings order, delivery and returns enquiries.", "HIGH", site),
        one(c("product_links") >= 10, "Sizeable product catalogue", text(many("product_links"), " product or collection links found on the pages read."),
            "A broader catalogue tends to generate more pre-purchase and post-purchase questions.", "MEDIUM", site),
        one(c("has_returns_page"), "Published returns or refunds policy", "A returns, refunds or exchanges page is linked from the site.",
            "Returns handling is an established part of this business's customer operations.", "MEDIUM", site),
        one(F.size("channel") >= 3, "Multiple customer contact channels", text("Channels present on the website: ", F.array_join("channel", ", "), "."),
            "Enquiries arrive through several channels at once, which is harder to cover consistently than a single inbox.", "MEDIUM", site),
        one(c("chat_widget").isNotNull(), "Live chat already in place", text(c("chat_widget"), " chat widget detected."),
            "The business already staffs a real-time channel, so it has an existing response-time commitment.", "HIGH", site),
        one(c("help_center"), "Help centre or customer service page", "The site publishes a help centre, knowledge base or customer service page.",
            "The business has enough recurring customer questions to justify documenting them.", "MEDIUM", site),
        one(c("support_roles"), "Customer-facing hiring", quoted('Careers content mentions customer-facing roles: "', "hiring"),
            "The business may be increasing its customer-facing capacity.", "HIGH", site),
        one(~c("support_roles") & c("careers_page"), "Actively hiring", "A careers or jobs page is published on the site.",
            "The business appears to be growing its team; whether that includes support roles is not established.", "LOW", site),
        one(c("review_count") >= 100, "High public review volume", text(many("review_count"), " reviews", rated, " in ", file, "."),
            "A large review count indicates substantial customer throughput; it is a proxy for interaction volume, not a measure of it.",
            F.when(c("review_count") >= 400, "MEDIUM").otherwise("LOW"), file),
        one(c("domain").isNotNull() & ~site_read, "Website could not be read",
            text(many("pages_failed"), " request(s) to ", c("domain"), " failed (", F.coalesce("first_failure", F.lit("no response")), ")."),
            "No website evidence is available for this lead. Scores below rest on the spreadsheet fields alone and should be treated as provisional.", "HIGH", c("domain")),
        one(c("domain").isNull(), "No website on file", text("No website value in ", file, "."),
            "Without a website there is little public evidence to work from, and no reliable way to confirm an Instagram account.", "HIGH", file),
    )
