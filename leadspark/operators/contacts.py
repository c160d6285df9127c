"""Choosing the person to address (E2) and message checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import scalars as S

c = F.col

#: Strongest role first, for small and for large companies. Fixed values.
SMALL = ["founder", "owner", "co_founder", "ceo", "head_of_operations", "support_manager", "cx_director", "marketing_director"]
LARGE = ["head_of_operations", "cx_director", "support_manager", "marketing_director", "ceo", "founder", "owner", "co_founder"]


def is_small(employees: Column, followers: Column, model: Column) -> Column:
    return F.when(employees.isNotNull(), employees <= 25).when(followers <= 25000, True).otherwise(F.coalesce(model == "local_service", F.lit(False)))


def role_rank(role: Column, order: list[str]) -> Column:
    at = F.array_position(F.array(*(F.lit(r) for r in order)), role).cast("int")
    return F.when(at > 0, at - 1).when(role == "other", len(order) + 1).otherwise(len(order))


def ranked_contacts(contacts: DataFrame) -> DataFrame:
    """contacts: (company_id, seq, full_name, title, email, phone, source_confidence, small).
    Adds role, rank, place (1 is the one to address) and confidence."""
    rows = contacts.where(c("full_name").isNotNull() | c("title").isNotNull()).withColumn("role", S.role(c("title")))
    rows = rows.withColumn("rank", F.when(c("small"), role_rank(c("role"), SMALL)).otherwise(role_rank(c("role"), LARGE)))
    full = F.when(c("email").isNotNull(), 3).otherwise(0) + F.when(c("phone").isNotNull(), 1).otherwise(0) + F.when(c("full_name").isNotNull(), 2).otherwise(0)
    sure = F.coalesce("source_confidence", F.lit(0.5))
    order = Window.partitionBy("company_id").orderBy("rank", sure.desc(), full.desc(), "seq")
    listed = F.when(c("rank") < len(SMALL), 1.0).otherwise(0.6)
    return rows.withColumns({"place": F.row_number().over(order), "confidence": F.round(sure * listed, 2)})


def decision_makers(contacts: DataFrame) -> DataFrame:
    return ranked_contacts(contacts).where(c("place") == 1).drop("place")


def draft_issues(text: Column, banned: list[str], most_chars: int, most_questions: int = 1) -> Column:
    """Names of the rules that a draft breaks."""
    hits = [F.when(F.lower(text).contains(b), F.lit(f"banned:{b}")) for b in banned]
    checks = [
        F.when(F.length(text) > most_chars, "too_long"),
        F.when(F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))) > most_questions, "too_many_questions"),
        F.when(F.regexp_count(text, F.lit(r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]")) > 1, "too_many_emoji"),
    ]
    return F.array_compact(F.array(*hits, *checks))


def recommended(variations: Column, default: str) -> Column:
    """Of array<struct<name, text, issues>>: the default if clean, else the first clean, else the first."""
    clean = F.filter(variations, lambda v: F.size(v["issues"]) == 0)
    mine = F.filter(clean, lambda v: v["name"] == default)
    return F.coalesce(F.get(mine, F.lit(0)), F.get(clean, F.lit(0)), F.get(variations, F.lit(0)))
