"""Evidence, summaries and signals over leads derived from `pages`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import dealt
from leadspark.config import evidence as EV
from leadspark.operators import research as E

c = F.col
_K = "cast(floor(page_id / 5) as bigint)"
#: Five pages a lead, with pieces of real sites added, by expressions that both engines read.
PAGES = {
    "lead_id": _K,
    "page_no": "page_id % 5",
    "url": "url",
    "label": "case page_id % 5 when 0 then 'homepage' when 1 then 'contact' when 2 then 'about' when 3 then 'careers' else 'faq' end",
    "html": "case when page_id % 29 <> 7 then concat(html, case page_id % 13"
    """ when 0 then '<script src="https://cdn.shopify.com/s/files/x.js">var a = "call us now";</script><a href="/products/one">1</a><a href="/SHOP/two">2</a> Add to cart'"""
    """ when 1 then '<p>Please give us a call &mdash; book now &amp; save, we&rsquo;re happy</p><a href="tel:+1 (312) 555-0199">x</a><a href="tel:312.555.0100">y</a>'"""
    """ when 2 then '<p>Our team answers 24/7, all year</p><a href="mailto:Info@Shop.co?subject=x">m</a><form action="/x"><input name="email"></form>'"""
    """ when 3 then '<p>Avoid the sauna for at least 24 hours; staff available around the clock</p><script src="//assets.calendly.com/w.js"></script>'"""
    """ when 4 then '<a href="/careers">Careers</a><p>We&apos;re hiring a receptionist and a customer support agent</p>'"""
    """ when 5 then '<a href="https://www.instagram.com/glow.shop">i</a> https://x.com/glow <a href="https://facebook.com/glow/">f</a> instagram.com/second_one'"""
    """ when 6 then '<a href="/returns">Returns and refunds</a> <p>help centre</p><script src="https://widget.intercom.io/w"></script> zdassets.com'"""
    """ when 7 then '<meta name="description" content="The best shop">squarespace.com <p>request an appointment today</p><a href="/jobs">Jobs</a>'"""
    """ when 8 then concat('wp-content/plugins/woocommerce ', repeat('<a href="/store/item/">s</a>', cast(page_id % 17 as int))) else '' end) end""",
    "ok": "page_id % 7 <> 3 and page_id % 35 < 30",
    "status": "case when page_id % 7 = 3 then 403 end",
    "error": "case when page_id % 35 >= 30 then 'timeout' end",
}
LEADS = {
    "lead_id": _K,
    "domain": f"case when {_K} % 6 <> 5 then concat('shop', cast({_K} as string), '.com') end",
    "phone": f"case when {_K} % 3 <> 0 then concat('312-', cast(1000000 + {_K} as string)) end",
    "phone_e164": f"case when {_K} % 3 <> 0 then concat('+1312', cast(1000000 + {_K} as string)) end",
    "category": f"case {_K} % 5 when 0 then 'Medical Spa' when 1 then 'Law firm' when 2 then 'Yoga studio' when 3 then 'Bookshop' end",
    "industry": f"case {_K} % 4 when 0 then 'dental' when 1 then 'retail' end",
    "source_file": "'leads.csv'",
    "original_row": f"{_K} + 2",
    "review_count": f"case when {_K} % 7 <> 0 then cast({_K} * 97 % 600 as int) end",
    "rating": f"case when {_K} % 4 <> 0 then cast({_K} % 10 as double) / 2 end",
}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").selectExpr(*(f"{e} as {n}" for n, e in PAGES.items()))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 5 = 0")
    return first.selectExpr(*(f"{e} as {n}" for n, e in LEADS.items()))


def _evidence(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    return E.lead_evidence(E.page_facts(pages(spark, sf_dir).where(which)))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some leads have no pages at all.
    return E.with_evidence(leads(spark, sf_dir), _evidence(spark, sf_dir, "lead_id % 10 <> 9"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.page_facts(pages(spark, sf_dir))
    flat = ["lead_id", "page_no", "readable", "title", "description", "call", "book", "hires", "role", "hours", "cart", "returns", "form", "help", "careers"]
    lists = ["technologies", "mailtos", "tels", *EV.SOCIALS]
    return rows.select(*flat, c("product_links").cast("long").alias("product_links"), *(F.array_join(k, "; ").alias(k) for k in lists))


SUMS = "website_reachable pages_read pages_failed first_url first_failure title description product_links has_cart has_returns_page mailto_count contact_form help_center tel_links careers_page support_roles".split()
LISTS = [k for k in EV.KEPT if k not in ("chat", "booking")]


def _lead_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("lead_id", *SUMS, "ecommerce", "chat_widget", "booking_platform", *(F.array_join(k, "; ").alias(k) for k in LISTS))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("lead_id", E.summary().alias("summary"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("lead_id", F.explode(E.signals()).alias("s")).select("lead_id", "s.signal", "s.evidence", "s.confidence", "s.source")


QUERIES = {"e03_page_facts": _facts, "e04_lead_evidence": _lead_evidence, "e06_summary": _summary, "e07_signals": _signals}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_text() -> str:
    out = "html"
    for cut in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", "<[^>]+>"):
        out = f"regexp_replace({out}, {_q(cut)}, ' ', 'gi')"
    for name, plain in EV.ENTITIES.items():
        out = f"regexp_replace({out}, '&{name};', {_q(plain)}, 'gi')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_AHEAD = r"^([\s\S]*?)(?:"
_QUOTED = {"call": EV.CALL, "book": EV.BOOKING, "hires": EV.HIRING, "role": EV.SUPPORT_ROLES, "hours_any": EV.AFTER_HOURS}


def _sql_quotes() -> str:
    """Tables that find, step by step, the quote around each leftmost match."""
    at = lambda k, p: f"case when regexp_matches(body, {_q(p)}, 'i') then greatest(0, length(regexp_extract(body, {_q(_AHEAD + p + ')')}, 1, 'i')) - 25) end as {k}_low"
    start = "case when {k}_low > 0 and contains(body[1:{k}_low + 1], ' ') then {k}_low + 2 - position(' ' in reverse(body[1:{k}_low + 1])) else {k}_low end as {k}_start"
    end = "least(length(body), {k}_start + 130) as {k}_stop, position(' ' in body[{k}_stop + 1:{k}_stop + 16]) as {k}_gap, case when {k}_stop < length(body) and {k}_gap > 0 then {k}_stop + {k}_gap - 1 else {k}_stop end as {k}_end"
    quote = "case when {k}_low is not null then (case when {k}_start > 0 then '...' else '' end) || trim(body[{k}_start + 1:{k}_end]) || (case when {k}_end < length(body) then '...' else '' end) end as {k}"
    each = lambda t: ", ".join(t.format(k=k) for k in _QUOTED)
    return f"""placed as (select *, {", ".join(at(k, p) for k, p in _QUOTED.items())} from shown),
    started as (select *, {each(start)} from placed), ended as (select *, {each(end)} from started), quoted as (select *, {each(quote)} from ended)"""


def _sql_facts() -> str:
    has = lambda text, p: f"coalesce(regexp_matches({text}, {_q(p)}, 'i'), false)"
    every = lambda p: f"coalesce(regexp_extract_all(html, {_q(p)}, 1, 'i'), [])"
    captured = lambda p, n: f"case when label = 'homepage' and {has('html', p)} then left(trim(regexp_extract(html, {_q(p)}, 1, 'i')), {n}) end"
    tech = lambda kinds: "[x for x in [" + ", ".join(f"case when {has('html', p)} then {_q(n)} end" for n, k, p in EV.TECHNOLOGIES if k in kinds) + "] if x is not null]"
    socials = ", ".join(f"[x for x in {every(p)} if x <> ''] as {k}" for k, p in EV.SOCIALS.items())
    return f"""
    raw as (select {", ".join(f"{e} as {n}" for n, e in PAGES.items())} from pages),
    fetched as (select * replace (case when coalesce(ok, false) and coalesce(html, '') <> '' then html end as html),
      coalesce(ok, false) and coalesce(html, '') <> '' as readable from raw),
    shown as (select *, {_sql_text()} as body from fetched),
    {_sql_quotes()},
    facts as (select lead_id, page_no, url, label, readable, status, error,
      {tech(("ecommerce", "cms", "support", "booking"))} as technologies, {tech(("ecommerce",))} as shops, {tech(("support",))} as chats, {tech(("booking",))} as books,
      call, book, hires, role, case when not regexp_matches(hours_any, {_q(EV.NOT_AFTER_HOURS)}, 'i') then hours_any end as hours,
      {captured(EV.TITLE, 200)} as title, {captured(EV.DESCRIPTION, 400)} as description,
      coalesce(len(regexp_extract_all(lower(html), {_q(EV.PRODUCT_LINK)})), 0) as product_links,
      {has("html", EV.CART)} as cart, {has("body", EV.RETURNS)} and {has("html", EV.RETURNS_LINK)} as returns,
      [lower(x) for x in {every(EV.MAILTO)}] as mailtos, {has("html", EV.FORM)} as form, {has("body", EV.HELP)} as help, {every(EV.TEL)} as tels,
      readable and (label = 'careers' or {has("html", EV.CAREERS_LINK)}) as careers, {socials} from quoted)"""



def _sql_evidence() -> str:
    """Tables up to `evidence`, one row for each lead."""
    lists = {
        "technology": "technologies", "email": "mailtos", "number": "[regexp_replace(x, '[^\\d+]', '', 'g') for x in tels]", "call": "[call]", "book": "[book]",
        "hiring": "[hires, case when has_role then role end]", "hours": "[hours]", "chat": "chats", "booking": "books",
        "channel": "[case when len(chats) > 0 then 'live chat' end, case when returns then 'returns/refunds policy' end, case when len(mailtos) > 0 then 'email' end,"
        " case when form then 'contact form' end, case when help then 'help centre or customer service page' end, case when len(tels) > 0 then 'phone' end]",
        "shop": "list_concat([x || ' detected on ' || url for x in shops], [case when cart then 'cart or checkout markup present on ' || url end])",
        **{k: k for k in EV.SOCIALS},
    }
    long = " union all ".join(f"select lead_id, page_no, '{k}' as kind, unnest({v}) as value, unnest(range(len({v}))) as pos from seen" for k, v in lists.items())
    most = " ".join(f"when '{k}' then {n}" for k, n in EV.KEPT.items())
    listed = ", ".join(f"coalesce(list(value order by spot) filter (where kind = '{k}'), []) as {k}s" for k in EV.KEPT)
    shops = ", ".join(_q(n) for n in E.KINDS["ecommerce"])
    note = "Website did not return a readable page ("
    return f"""{_sql_facts()},
    seen as (select *, role is not null and (hires is not null or bool_or(careers) over (partition by lead_id order by page_no)) as has_role from facts),
    entries as (select * from ({long}) where value is not null),
    firsts as (select lead_id, kind, value, min(page_no * 1000000 + pos) as spot from entries group by lead_id, kind, value, case when kind = 'shop' then page_no * 1000000 + pos end),
    few as (select * from firsts qualify row_number() over (partition by lead_id, kind order by spot) <= case kind {most} end),
    lists as (select lead_id, {listed} from few group by lead_id),
    sums as (select lead_id, bool_or(readable) as website_reachable, count(*) filter (where readable) as pages_read, count(*) filter (where not readable) as pages_failed,
      arg_min(url, page_no) filter (where readable) as first_url, arg_min(coalesce(cast(status as varchar), error, ''), page_no) filter (where not readable) as failure,
      nullif(failure, '') as first_failure, max(title) as title, max(description) as description, cast(sum(product_links) as bigint) as product_links, bool_or(cart) as has_cart,
      bool_or(returns) as has_returns_page, cast(sum(len(mailtos)) as bigint) as mailto_count, bool_or(form) as contact_form, bool_or(help) as help_center,
      cast(sum(len(tels)) as bigint) as tel_links, bool_or(careers) as careers_page, bool_or(has_role) as support_roles from seen group by lead_id),
    evidence as (select s.* exclude (failure), l.* exclude (lead_id), coalesce(len([x for x in technologys if x in ({shops})]) > 0, false) as ecommerce, chats[1] as chat_widget,
      bookings[1] as booking_platform, case when not website_reachable and pages_failed > 0 then {_q(note)} || coalesce(first_failure, 'null')
      || '). Many small-business sites block automated requests; this is not evidence about the business itself.' end as notes from sums s left join lists l using (lead_id))"""


def _sql_known() -> str:
    counts = ", ".join(f"coalesce({k}, 0) as {k}" for k in ("pages_read", "pages_failed", "product_links", "mailto_count", "tel_links"))
    flags = ", ".join(f"coalesce({k}, false) as {k}" for k in ("website_reachable", "has_cart", "has_returns_page", "contact_form", "help_center", "careers_page", "support_roles", "ecommerce"))
    lists = ", ".join(f"coalesce({k}s, []) as {k}s" for k in EV.KEPT)
    return f"""{_sql_evidence()},
    leads as (select {", ".join(f"{e} as {n}" for n, e in LEADS.items())} from pages where page_id % 5 = 0),
    known as (select leads.*, {counts}, {flags}, {lists}, first_url, first_failure, title, chat_widget, booking_platform, notes,
      coalesce(first_url, 'https://' || domain) as site, source_file || ' row ' || original_row as file, concat_ws(' ', category, industry) as cat
      from leads left join (select * from evidence where lead_id % 10 <> 9) using (lead_id))"""


def _sql_signals() -> str:
    text = "'Website text includes: \"' || {k}s[1] || '\"'"
    heavy, led = (f"regexp_matches(cat, {_q(p)}, 'i')" for p in (EV.PHONE_HEAVY, EV.APPOINTMENT_LED))
    stars = "case when coalesce(rating, 0) <> 0 then ' at ' || regexp_replace(cast(rating as varchar), '\\.0$', '') || ' stars' else '' end"
    rows = [
        ("tel_links > 0", "Phone is a prominent contact channel", "tel_links || ' click-to-call link' || case when tel_links = 1 then '' else 's' end || ' across the ' || pages_read || ' page(s) read.'", "case when tel_links >= 3 then 'HIGH' else 'MEDIUM' end", "site"),
        ("tel_links = 0 and phone_e164 is not null and not website_reachable", "Phone number published", "'A phone number is listed in the source data (' || phone || '), and the website could not be read to say more.'", "'LOW'", "file"),
        ("len(calls) > 0", "Call-to-action asks customers to phone", text.format(k="call"), "'HIGH'", "site"),
        ("booking_platform is not null", "Appointment booking in use", "'Booking platform detected: ' || booking_platform || '.'", "'HIGH'", "site"),
        ("booking_platform is null and len(books) > 0", "Appointment-led customer journey", text.format(k="book"), "'MEDIUM'", "site"),
        (f"booking_platform is null and len(books) = 0 and {led}", "Appointment-based business category", "'The source file lists the category as \"' || coalesce(category, 'null') || '\".'", "'LOW'", "file"),
        ("len(hourss) > 0", "After-hours availability advertised", text.format(k="hours"), "'HIGH'", "site"),
        (f"{heavy} and tel_links = 0", "Phone-heavy business category", "'Category \"' || coalesce(category, 'null') || '\" in ' || file || '.'", "'LOW'", "file"),
        ("ecommerce", "Sells online", "array_to_string(shops, '; ')", "'HIGH'", "site"),
        ("product_links >= 10", "Sizeable product catalogue", "product_links || ' product or collection links found on the pages read.'", "'MEDIUM'", "site"),
        ("has_returns_page", "Published returns or refunds policy", "'A returns, refunds or exchanges page is linked from the site.'", "'MEDIUM'", "site"),
        ("len(channels) >= 3", "Multiple customer contact channels", "'Channels present on the website: ' || array_to_string(channels, ', ') || '.'", "'MEDIUM'", "site"),
        ("chat_widget is not null", "Live chat already in place", "chat_widget || ' chat widget detected.'", "'HIGH'", "site"),
        ("help_center", "Help centre or customer service page", "'The site publishes a help centre, knowledge base or customer service page.'", "'MEDIUM'", "site"),
        ("support_roles", "Customer-facing hiring", "'Careers content mentions customer-facing roles: \"' || coalesce(hirings[1], '') || '\"'", "'HIGH'", "site"),
        ("not support_roles and careers_page", "Actively hiring", "'A careers or jobs page is published on the site.'", "'LOW'", "site"),
        ("review_count >= 100", "High public review volume", f"review_count || ' reviews' || {stars} || ' in ' || file || '.'", "case when review_count >= 400 then 'MEDIUM' else 'LOW' end", "file"),
        ("domain is not null and not website_reachable", "Website could not be read", "pages_failed || ' request(s) to ' || domain || ' failed (' || coalesce(first_failure, 'no response') || ').'", "'HIGH'", "domain"),
        ("domain is null", "No website on file", "'No website value in ' || file || '.'", "'HIGH'", "file"),
    ]
    return " union all ".join(f"select lead_id, '{name}' as signal, {evidence} as evidence, {confidence} as confidence, {source} as source from known where {when}" for when, name, evidence, confidence, source in rows)


def _sql_summary() -> str:
    socials = ", ".join(f"case when len({k}s) > 0 then '{k}' end" for k in EV.SOCIALS)
    return f"""select lead_id, case when domain is null then 'No website listed in ' || source_file || ', so only the spreadsheet''s own fields were available.'
      when not website_reachable then coalesce(notes, domain || ' could not be read.')
      else concat_ws(' ', case when coalesce(title, '') <> '' then '"' || title || '"' else domain end || ' - read ' || pages_read || ' page(s).',
      case when len(technologys) > 0 then 'Technologies detected: ' || array_to_string(technologys, ', ') || '.' end,
      case when len(channels) > 0 then 'Contact channels present: ' || array_to_string(channels, ', ') || '.' end,
      case when tel_links > 0 then tel_links || ' click-to-call link(s) on the pages read.' end,
      case when booking_platform is not null then 'Online booking via ' || booking_platform || '.' when len(books) > 0 then 'Booking language present but no booking platform identified.' end,
      case when ecommerce then 'E-commerce platform present' || case when product_links > 0 then ' with ' || product_links || ' product link(s)' else '' end || '.' end,
      case when careers_page then 'Careers or jobs page found' || case when support_roles then ', mentioning customer-facing roles' else '' end || '.' end,
      case when len(hourss) > 0 then 'After-hours or 24/7 availability mentioned.' end,
      case when len([x for x in [{socials}] if x is not null]) > 0 then 'Social links: ' || array_to_string([x for x in [{socials}] if x is not null], ', ') || '.' end) end as summary from known"""


_SEP = "'; '"
_joined = lambda names: ", ".join(f"array_to_string({n}, '; ') as {a}" for n, a in names)
ORACLES = {
    "e03_page_facts": f"with {_sql_facts()} select lead_id, page_no, readable, title, description, call, book, hires, role, hours, cart, returns, form, help, careers, cast(product_links as bigint) as product_links, "
    f"{_joined([(k, k) for k in ('technologies', 'mailtos', 'tels', *EV.SOCIALS)])} from facts",
    "e04_lead_evidence": f"with {_sql_evidence()} select lead_id, {', '.join(SUMS)}, ecommerce, chat_widget, booking_platform, {', '.join(f'array_to_string(coalesce({k}s, []), {_SEP}) as {k}' for k in LISTS)} from evidence",
    "e06_summary": f"with {_sql_known()} {_sql_summary()}",
    "e07_signals": f"with {_sql_known()} {_sql_signals()}",
}
