"""Texts of pages and models: visible text, quotes, signal lists, JSON in a reply."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.config import evidence as EV
from leadspark.functions.scalars import squeeze


@F.pandas_udf(T.StringType())
def _entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def visible_text(page: Column) -> Column:
    """Without scripts, styles and tags; entities decoded; one space between words."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    some = bare.rlike("&[#a-zA-Z]")
    return squeeze(F.when(some, _entities(F.when(some, bare))).otherwise(bare))


@F.pandas_udf(T.StringType())
def _numbered(s: pd.Series) -> pd.Series:
    def decoded(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else " "

    return s.map(lambda x: None if x is None else re.sub(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));", decoded, x))


def page_text(page: Column) -> Column:
    """As visible_text, in the plain spelling of quotes: known entities as ASCII, others left
    as written. Only pages with numbered entities reach Python."""
    bare = page
    for cut in (r"<script[\s\S]*?</script>", r"<style[\s\S]*?</style>", "<[^>]+>"):
        bare = F.regexp_replace(bare, f"(?i){cut}", " ")
    some = bare.rlike("&#")
    bare = F.when(some, _numbered(F.when(some, bare))).otherwise(bare)
    for name, plain in EV.ENTITIES.items():
        bare = F.regexp_replace(bare, f"(?i)&{name};", plain)
    return squeeze(bare)


def place(text: Column, pattern: str) -> Column:
    """Place (from 1) of the leftmost match in any case, null if there is none."""
    return F.when(text.rlike(f"(?i){pattern}"), F.length(F.regexp_extract(text, rf"(?i)^([\s\S]*?)(?:{pattern})", 1)) + 1)


def snippet(text: Column, at: Column, width: int = 130) -> Column:
    """A quote of about `width` characters from 25 before place `at` (from 1): begins and ends
    at a word, with dots where cut."""
    low = F.greatest(F.lit(0), at - 26)
    head = F.substring(text, F.lit(1), low + 1)
    start = F.when((low > 0) & head.contains(" "), F.length(head) - F.instr(F.reverse(head), " ") + 1).otherwise(low)
    size = F.length(text)
    stop = F.least(size, start + width)
    gap = F.locate(" ", F.substring(text, stop + 1, F.lit(16)))
    end = F.when((stop < size) & (gap > 0), stop + gap - 1).otherwise(stop)
    piece = F.trim(F.substring(text, start + 1, end - start))
    return F.when(at.isNotNull(), F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(end < size, "...").otherwise("")))


def numbered_signals(signals: Column) -> Column:
    """One numbered line for each of array<struct<signal, evidence, confidence>>."""
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["signal"], F.lit(" ["), s["confidence"], F.lit("]: "), s["evidence"])
    return F.array_join(F.transform(signals, line), "\n")
