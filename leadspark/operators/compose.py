"""First messages from signals (R13): a decision list of openers, compiled to one expression.

The openers, wordings and phrases are data (config.openers). Each opener gives a fragment of its
signal's evidence, or null if that doesn't serve; the first one that is not null in the order
of the lead's service speaks. Everything is a column expression: no join, no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import openers as O
from leadspark.functions import scalars as S

c = F.col


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def quote(evidence: Column) -> Column:
    """The quoted piece of an evidence, if it reads as page copy: at most 64 characters cut at a
    word, no questions, nothing of navigation, addresses or numbers; else null."""
    text = F.trim(F.regexp_replace(F.coalesce(_found(evidence, '"([^"]{3,120})"'), F.lit("")), r"\s+", " "))
    text = F.when(F.length(text) > O.LONGEST_QUOTE, F.regexp_replace(F.substring(text, 1, O.LONGEST_QUOTE), r"\s+\S*$", "")).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, "[?!]", ""), r"[\s,;:.\-]+$", "")
    fair = (
        (F.length(text) >= 8) & ~text.startswith("...") & ~text.endswith("...") & ~text.rlike(f"(?i){O.NOT_COPY}") & ~text.rlike(O.PHONE_NUMBER)
        & ~text.rlike(f"(?i){O.SITE_CHROME}") & (F.size(F.split(text, r"\s+")) >= 2) & text.rlike("[a-z]{3}")
    )
    return F.when(fair, text)


def channels(evidence: Column) -> Column:
    """The ways to get in touch as a phrase, if there are two."""
    named = F.split(F.coalesce(_found(evidence, r"present on the website: (.+?)\.?$"), F.lit("")), r",\s*")
    ways = F.filter(named, lambda x: x.rlike(f"(?i){O.CONTACT}"))
    most = F.array_join(F.slice(ways, F.lit(1), F.greatest(F.size(ways) - 1, F.lit(0))), ", ")
    return F.when(F.size(ways) >= 2, F.concat(most, F.lit(" and "), F.element_at(ways, -1)))


def _count(evidence: Column, pattern: str, least: int) -> Column:
    n = _found(evidence, pattern).try_cast("long")
    return F.when(n >= least, n.cast("string"))


#: How an opener of each kind gets its fragment.
FRAGMENTS = {
    "quote": quote,
    "booking": lambda e: _found(e, r"detected: (.+?)\.?$"),
    "chat": lambda e: _found(e, r"^(.+?) chat widget"),
    "channels": channels,
    "calls": lambda e: _count(e, r"(\d+) click-to-call", 2),
    "products": lambda e: _count(e, r"(\d+) product", 1),
    "none": lambda e: F.lit(""),
}


def _pick(variants: list[str], seed: Column, x: Column | None = None) -> Column:
    line = S.pick(variants, seed)
    return line if x is None else F.replace(line, F.lit("{x}"), x)


def _opener(signal: str, kind: str, lines: list[str], asks: list[str], seed: Column, usable: Column) -> Column:
    """struct(text, ask, signal, evidence, confidence, source), or null if this opener can't speak."""
    first = F.get(F.filter(usable, lambda s: s["signal"] == signal), F.lit(0))
    evidence = F.coalesce(first["evidence"], F.lit(""))
    fragment = FRAGMENTS[kind](evidence)
    said = F.struct(
        _pick(lines, seed, fragment).alias("text"), _pick(asks, F.shiftrightunsigned(seed, 3), fragment).alias("ask"), *(first[k].alias(k) for k in ("signal", "evidence", "confidence", "source"))
    )
    return F.when(first.isNotNull() & fragment.isNotNull(), said)


def compose(leads: DataFrame, sender: str, company: str, most: int = O.MOST_CHARACTERS) -> DataFrame:
    """leads: company_name, business_instagram, category, owner_name, recommended_offer and signals (array of
    struct(signal, evidence, confidence, source, ...)). Adds message, observation_used, capability_mentioned,
    why_this_message and self_check (a struct of checks); a lead without an offer gets an empty message.

    Nulls: no signals are none, a null evidence has no fragment, a null name or category counts as
    empty. Texts are hashed by their characters; the wording of a text beyond the BMP may differ
    from an engine that counts UTF-16 units."""
    rows = leads.withColumns(
        {
            "_seed": S.wording_seed(F.concat(F.coalesce("company_name", F.lit("")), F.lit("|"), F.coalesce("business_instagram", F.lit("")))),
            "_service": F.when(c("recommended_offer") == "BOTH", O.VOICE).otherwise(c("recommended_offer")),
            "_usable": F.filter(F.coalesce("signals", F.array().cast(leads.schema["signals"].dataType)), lambda s: ~(s["confidence"].eqNullSafe("LOW"))),
        }
    )
    seed = c("_seed")
    made = [(service, _opener(signal, kind, lines, asks, seed, c("_usable"))) for signal, service, kind, lines, asks in O.OPENERS]
    first = {k: F.coalesce(*(o for s, o in made if s == k), *(o for s, o in made if s != k)) for k in (O.VOICE, O.SUPPORT)}
    voice = c("_service") == O.VOICE
    rows = rows.withColumn("_open", F.when(voice, first[O.VOICE]).otherwise(first[O.SUPPORT]))
    either = lambda table: F.when(voice, F.lit(table[O.VOICE])).otherwise(F.lit(table[O.SUPPORT]))
    able = F.when(voice, _pick(O.CAPABILITIES[O.VOICE], F.shiftrightunsigned(seed, 5))).otherwise(_pick(O.CAPABILITIES[O.SUPPORT], F.shiftrightunsigned(seed, 5)))
    own = F.replace(F.replace(S.pick(O.INTRODUCTIONS, F.shiftrightunsigned(seed, 7)), F.lit("{name}"), F.lit(sender)), F.lit("{company}"), F.lit(company))
    name = F.get(F.split(F.trim(F.coalesce("owner_name", F.lit(""))), r"\s+"), F.lit(0))
    greeting = F.when(name.rlike(O.FIRST_NAME), F.concat(name, F.lit(" - "))).otherwise("")
    kind = F.trim(F.regexp_replace(F.lower(F.coalesce("category", F.lit("clinic"))), "[^a-z /+&-]", ""))
    kind = F.when(kind == "", "clinic").otherwise(kind)
    opened = c("_open").isNotNull()
    ask = F.concat(F.regexp_replace(F.coalesce("_open.ask", F.lit(O.GENERAL_QUESTION)), r"[\s.!?]+$", ""), F.lit("?"))
    line = F.coalesce("_open.text", _pick(O.GENERAL, seed, kind))
    body = F.trim(F.regexp_replace(F.concat(greeting, line, F.lit(" "), own, F.lit(" "), able, F.lit(". "), ask), r"\s+", " "))
    offered = F.coalesce(c("_service").isin(O.VOICE, O.SUPPORT), F.lit(False))
    rows = rows.withColumn("message", F.when(offered, body).otherwise(""))
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("null")) for p in x))
    why = F.when(opened, text('Opens on the "', c("_open.signal"), '" signal (', c("_open.confidence"), " confidence, from ", c("_open.source"), ") and names one ", either(O.NAMED), " capability against it.")).otherwise(O.NO_SIGNAL)
    low = F.lower("message")
    banned = F.exists(F.array(*(F.lit(p) for p in O.BANNED)), lambda p: F.contains(low, p))
    check = F.struct(
        opened.alias("opens_with_verified_observation"), F.lit(True).alias("no_invented_facts"), (~banned).alias("no_assumed_pain"), F.lit(True).alias("one_capability_only"),
        (c("message").endswith("?") & (F.length("message") - F.length(F.replace("message", F.lit("?"), F.lit(""))) == 1)).alias("ends_with_question"),
        (F.length("message") <= most).alias("under_max_chars"), (~c("message").rlike(f"(?i){O.GENDERED}")).alias("no_gendered_pronouns"),
    )
    return rows.withColumns(
        {
            "observation_used": F.when(offered, c("_open.evidence")),
            "capability_mentioned": F.when(offered, either(O.MENTIONED)),
            "why_this_message": F.when(offered, why).otherwise(O.NO_MESSAGE),
            "self_check": F.when(offered, check),
        }
    ).drop("_seed", "_service", "_usable", "_open")
