"""Exclusion, the niche of a file, and whether a row belongs to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# The patterns decide results and are stated as they are; the first that fits wins.
EXCLUSIONS = [
    ("competitor", r"\b(bpo|business process outsourc\w*|call cent(er|re)|contact cent(er|re)|answering service|outsourc\w*|offshor\w*|virtual assistant|customer experience (platform|software|solutions|ai)|cx ?(ai|platform|software|solutions)|helpdesk software|help desk software|live chat (software|platform)|conversational ai|ai receptionist|ai (phone|calling|voice) agent)\b|voice ?ai\b"),
    ("reseller", r"\b(marketing agency|digital agency|advertising agency|ad agency|creative agency|branding agency|seo agency|growth agency|smma|marketing (and|&) advertising|web (design|development|dev)? ?(agency|lab|studio|works)|software (agency|house|development company)|it (services|consulting|consultancy)|information technology (and|&) services|management consult\w*|staffing|recruit\w*( (agency|firm))?|lead generation agency|design studio)\b"),
    ("not_a_business", r"\b(business coach|sales coach|online course|masterclass|bootcamp|affiliate marketing|mlm|network marketing|crypto|forex|nft|trading signals)\b"),
]
TYPES = [
    ("education", r"\b(college|institute|academy|school|universit|training cent(er|re)|cosmetolog)"),
    ("hospitality", r"\b(hotel|resort|inn|lodge|motel|suites|bed and breakfast|b&b|casino|campground|rv park)\b"),
    ("restaurant", r"\b(restaurant|pizza|sushi|cafe|coffee|bakery|bar and grill|taqueria|diner|brewery|takeaway)\b"),
    ("retail_chain", r"\b(walmart|target|costco|cvs|walgreens|kroger|amazon|fedex|ups store|dollar general)\b"),
    ("government", r"\b(city of|county of|state government|department of|municipal|dmv|post office)\b"),
    ("association", r"\b(association|federation|society|council|chamber of commerce|board of|directors association)\b"),
    ("healthcare_other", r"\b(hospital|emergency room|urgent care|pharmacy|laborator|imaging cent(er|re)|nursing home)\b"),
    ("religious", r"\b(church|chapel|temple|mosque|synagogue|parish|ministry)\b"),
    ("real_estate", r"\b(apartments?|condos?|realty|property management|storage unit)"),
]
EXPECTED = {
    "medspa": r"\b(med ?spa|medical spa|aesthet|skin|laser|derma|injectab|botox|filler|wellness|rejuven|beaut(y|ies) (bar|lounge|clinic)|body contour)",
    "funeral": r"\b(funeral|cremat|mortuar|memorial (chapel|park)|burial|cemeter)",
    "logistics": r"\b(logistic|freight|truck|courier|transport|delivery|dispatch|cargo|warehous|distribution|shipping|3pl|moving|haul)",
    "dental": r"\b(dental|dentist|orthodont|endodont|periodont|oral surgery|smile)",
}


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, r: out.when(text.rlike(f"(?i){r[1]}"), r[0]), rules[1:], F.when(text.rlike(f"(?i){rules[0][1]}"), rules[0][0]))


def exclusion(*parts: str) -> tuple[Column, Column]:
    """Kind of the first exclusion rule that fits the joined columns, and the words that did."""
    text = F.concat_ws(" ", *(F.nullif(c(p), F.lit("")) for p in parts))
    kind = _first(text, EXCLUSIONS)
    words = reduce(lambda out, r: out.when(kind == r[0], F.regexp_extract(text, f"(?i){r[1]}", 0)), EXCLUSIONS[1:], F.when(kind == EXCLUSIONS[0][0], F.regexp_extract(text, f"(?i){EXCLUSIONS[0][1]}", 0)))
    return kind, words


def file_niches(leads: DataFrame, by: str) -> DataFrame:
    """The niche of each file by a vote of its rows: generic below 30 percent, sure above 60."""
    text = F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("industry", F.lit("")))
    votes = leads.groupBy(by).agg(F.count("*").alias("n_rows"), *(F.count(F.when(text.rlike(f"(?i){p}"), 1)).alias(n) for n, p in EXPECTED.items()))
    names = list(EXPECTED)
    best = F.greatest(*(c(n) for n in names))
    winner = reduce(lambda out, n: out.when(c(n) == best, n), names[1:], F.when(c(names[0]) == best, names[0]))
    few = (best == 0) | (best < 0.3 * c("n_rows"))
    return votes.select(by, F.when(few, "generic").otherwise(winner).alias("niche_key"), F.when(few, "LOW").when(best > 0.6 * c("n_rows"), "HIGH").otherwise("MEDIUM").alias("confidence"), best.alias("matched"))


def relevance(niche: Column, name: Column, category: Column) -> tuple[Column, Column]:
    """(match, type): the name decides first, then the category, then the expected words."""
    by_name, by_category = _first(name, TYPES), _first(category, TYPES)
    text = F.concat_ws(" ", name, category)
    expected = reduce(lambda out, kv: out.when(niche == kv[0], text.rlike(f"(?i){kv[1]}")), list(EXPECTED.items())[1:], F.when(niche == "medspa", text.rlike(f"(?i){EXPECTED['medspa']}"))).otherwise(text != "")
    strict = niche != "generic"
    wrong = F.when(strict, F.coalesce(by_name, by_category))
    match = F.when(wrong.isNotNull(), "OFF_NICHE").when(expected, "IN_NICHE").otherwise("UNCERTAIN")
    return match, F.when(wrong.isNotNull(), wrong).when(expected, niche)
