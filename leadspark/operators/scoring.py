"""ICP score parts, weighting, gates and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import rules as R


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def between(v: Column, low: float, high: float, a: float, b: float) -> Column:
    return clamp(a + (v - low) / (high - low) * (b - a))


def location_score(state: Column, city: Column, states: list[str], cities: list[str]) -> Column:
    out = F.when(state.isNull() & city.isNull(), 30.0)
    if states:
        out = out.when(state.isNotNull() & ~state.isin(states), 0.0)
    if cities:
        out = out.when(F.lower(city).isin(cities), 100.0)
    if states:
        out = out.when(state.isin(states), 80.0 if cities else 100.0)
    return out.otherwise(60.0)


def follower_score(f: Column, low: int = 1000, high: int = 10000, floor: int = 500, top: int = 25000) -> Column:
    return (
        F.when(f.isNull(), 40.0)
        .when(f.between(low, high), 100.0)
        .when(f < floor, 0.0)
        .when(f < low, between(f, floor, low, 30, 95))
        .when(f > top, 20.0)
        .otherwise(between(f, high, top, 95, 35))
    )


def products_score(n: Column, least: int = 2, full: int = 6) -> Column:
    return F.when(n.isNull() | (n == 0), 50.0).when(n < least, 25.0).when(n >= full, 100.0).otherwise(between(n, least, full, 70, 100))


def activity_score(days: Column, fresh: int = 14, fair: int = 45, stale: int = 120) -> Column:
    return (
        F.when(days.isNull(), 50.0).when(days <= fresh, 100.0).when(days <= fair, between(days, fresh, fair, 100, 70)).when(days <= stale, between(days, fair, stale, 70, 20)).otherwise(10.0)
    )


def contact_score(name: Column, has_role: Column, reachable: Column) -> Column:
    return F.when(name.isNull() & has_role, 45.0).when(name.isNull(), 20.0).when(has_role & reachable, 100.0).when(has_role, 85.0).otherwise(65.0)


def website_score(domain: Column, products: Column, described: Column, email: Column) -> Column:
    extra = F.when(products >= 2, 15).otherwise(0) + F.when(described, 10).otherwise(0) + F.when(email.isNotNull(), 5).otherwise(0)
    return F.when(domain.isNull(), 30.0).otherwise(clamp((70 + extra).cast("double")))


def blend(fixed: Column, model: Column, share: float) -> Column:
    """share of the fixed part; what is missing is taken from the other side."""
    m = clamp(model)
    return F.when(m.isNull(), F.coalesce(fixed, F.lit(50.0))).otherwise(share * F.coalesce(fixed, m) + (1 - share) * m)


def weighted(parts: dict[str, Column], weights: dict[str, float] | None = None, penalty: Column | None = None) -> Column:
    w = {k: v for k, v in (weights or R.WEIGHTS).items() if v}
    total = reduce(lambda a, b: a + b, (clamp(parts[k]) * v for k, v in w.items())) / sum(w.values())
    return half_up(clamp(total - (F.lit(0) if penalty is None else penalty)))


def band(score: Column, bands: list[tuple[str, int]] | None = None) -> Column:
    bands = sorted(bands or R.BANDS, key=lambda b: -b[1])
    return reduce(lambda out, b: out.when(score >= b[1], b[0]), bands[1:], F.when(score >= bands[0][1], bands[0][0])).otherwise("NOT_QUALIFIED")


def gate_failures(gates: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, n) for c, n in gates)))


def score_leads(leads: DataFrame, min_score: int = 70, queue: tuple[str, ...] = ("HIGH_PRIORITY", "QUALIFIED")) -> DataFrame:
    """leads with the columns of the parts below; adds icp_score, band, priority, qualified, failures."""
    c = F.col
    parts = {
        "location_fit": location_score(c("state"), c("city"), R.CAMPAIGN["states"], R.CAMPAIGN["cities"]),
        "niche_fit": blend(F.when(c("niche_hit"), 100.0).otherwise(50.0), c("ai_niche_fit"), 0.4),
        "follower_fit": follower_score(c("ig_followers")),
        "products_fit": products_score(c("products_count")),
        "business_quality": F.coalesce(clamp(c("ai_business_quality")), F.lit(50.0)),
        "instagram_activity": activity_score(c("days_since_last_post")),
        "website_quality": blend(website_score(c("website_domain"), c("products_count"), F.lit(False), c("email")), c("ai_website_quality"), 0.5),
        "decision_maker": contact_score(c("contact_name"), c("contact_role").isNotNull(), c("email").isNotNull()),
        "cx_need": F.coalesce(clamp(c("ai_cx_need")), F.lit(50.0)),
        "outreach_potential": F.coalesce(clamp(c("ai_outreach_potential")), F.lit(50.0)),
    }
    failures = gate_failures(
        [
            (c("instagram_handle").isNull(), "no_instagram"),
            (c("state").isNotNull() & ~c("state").isin(R.CAMPAIGN["states"]), "outside_target_state"),
            (c("ig_followers") < R.BOUNDS["min_followers"], "below_absolute_min_followers"),
            (c("ig_followers") > R.BOUNDS["max_followers"], "above_absolute_max_followers"),
        ]
    )
    out = leads.withColumns({"icp_score": weighted(parts), "failures": failures})
    out = out.withColumn("band", F.when(F.size("failures") > 0, "NOT_QUALIFIED").otherwise(band(c("icp_score"))))
    priority = F.create_map(*(F.lit(x) for kv in R.PRIORITY.items() for x in kv))
    return out.withColumns({"priority": F.try_element_at(priority, c("band")), "qualified": (F.size("failures") == 0) & (c("icp_score") >= min_score) & c("band").isin(list(queue))})
