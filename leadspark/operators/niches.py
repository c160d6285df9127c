"""Which terms of its niche a row holds (C2), by a join on word sequences.

A term holds where it stands between characters that are no letters or digits. So, if it
begins and ends with a letter or digit, it is exactly a stretch of the text from the start of a
word to the end of a word. Each row gives its distinct stretches of as many words as terms have,
and they meet the terms by equality: no expression for each term, and terms of any number.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

_WORD = "[a-z0-9]+"
_EDGES = "^[^a-z0-9]+|[^a-z0-9]+$"


def term_table(spark: SparkSession, niches: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(niche, kind, at, term) of niches that the code states."""
    rows = [{"niche": name, "kind": kind, "at": at, "term": term} for name, rule in niches.items() for kind in ("keywords", "negative") for at, term in enumerate(rule[kind])]
    # One literal: a thousand would take longer to plan than the join.
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<niche: string, kind: string, at: int, term: string>>")))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(niche, kind, at, term) of a JSON file with a list `niches` of id, keywords and negative_keywords."""
    listed = "array<struct<id: string, keywords: array<string>, negative_keywords: array<string>>>"
    one = spark.read.schema(f"niches {listed}").json(path, multiLine=True).select(F.explode("niches").alias("x")).select("x.*")
    kinds = [one.select(c("id").alias("niche"), F.lit(kind).alias("kind"), F.posexplode(field).alias("at", "term")) for kind, field in (("keywords", "keywords"), ("negative", "negative_keywords"))]
    return kinds[0].unionByName(kinds[1])


def _stretches(words: int) -> Column:
    """All stretches of so many words, with what stands between them."""
    if not words:
        return F.array(F.lit(""))
    at = lambda i: F.concat(*(x for k in range(words) for x in ([F.element_at("gaps", i + k)] if k else []) + [F.element_at("words", i + k)]))
    return F.when(F.size("words") >= words, F.transform(F.sequence(F.lit(1), F.size("words") - (words - 1)), at)).otherwise(F.array().cast("array<string>"))


def match_terms(rows: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, at, term) of each term of a row's niche that its text holds.

    rows: key, niche, text (in lower case); terms: niche, kind, at, term. Terms are trimmed and compared in
    lower case; empty ones, nulls and rows without a niche or text match nothing. The collected row
    holds the numbers of words of the terms only.
    """
    index = terms.select("niche", "kind", "at", F.lower(F.trim("term")).alias("term")).where("term <> ''")
    index = index.withColumn("stretch", F.regexp_replace("term", _EDGES, "")).withColumn("n", F.regexp_count("stretch", F.lit(_WORD)))
    shape = index.agg(F.array_sort(F.collect_set("n")).alias("n"), F.coalesce(F.bool_or(c("stretch") != c("term")), F.lit(False)).alias("edged")).first()
    # A gap before the first word is the first of `gaps`, so gap i stands before word i.
    cut = rows.select(key, "niche", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"), F.split("text", _WORD, -1).alias("gaps"))
    lists = [_stretches(n) for n in shape["n"]]
    held = cut.select(key, "niche", F.explode(F.array_distinct(F.concat(*lists)) if lists else F.array().cast("array<string>")).alias("stretch"))
    met = held.join(index.drop("n"), ["niche", "stretch"])
    out = met.where(c("stretch") == c("term"))
    if shape["edged"]:
        # Terms with other characters at their edges: the words must match first, then the whole term.
        # In lower case a term can't end the quotation.
        quoted = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), "term", F.lit(r"\E([^a-z0-9]|$)"))
        more = met.where(c("stretch") != c("term")).join(rows.select(key, "text"), key).where(F.regexp_like("text", quoted))
        out = out.unionByName(more.select(out.columns))
    return out.select(key, "kind", "at", "term")


def match_niches(rows: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """(key, niche_hits, niche_negatives) of every row, in the order of the terms. Without a keyword in the text,
    a category that holds one anywhere is the hit. rows: key (unique), niche, text, category."""
    found = match_terms(rows, terms, key)
    of = lambda kind: F.array_sort(F.collect_list(F.when(c("kind") == kind, F.struct("at", "term"))))
    lists = found.groupBy(key).agg(of("keywords").alias("hits"), of("negative").alias("negatives"))
    low = F.lower("category")
    words = terms.where((c("kind") == "keywords") & (F.trim("term") != "")).select("niche", F.lower("term").alias("term"))
    # Categories repeat: each is compared once in its niche.
    kinds = rows.where(c("category").isNotNull()).select("niche", low.alias("low")).distinct()
    kinds = kinds.join(words, "niche").where(F.contains("low", "term")).select("niche", "low").distinct().withColumn("fits", F.lit(True))
    out = rows.select(key, "niche", low.alias("low")).join(lists, key, "left").join(kinds, ["niche", "low"], "left")
    none = F.array().cast("array<string>")
    texts = lambda x: F.coalesce(F.transform(x, lambda y: y["term"]), none)
    hits = texts("hits")
    hits = F.when((F.size(hits) == 0) & c("fits"), F.array("low")).otherwise(hits)
    return out.select(key, hits.alias("niche_hits"), texts("negatives").alias("niche_negatives"))
