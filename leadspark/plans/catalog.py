"""All queries of the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.plans import company_queries, compose_queries, contract_queries, event_queries, lead_queries, people_queries, provider_queries, report_queries, research_queries, scalar_queries, sink_queries, v1_queries

MODULES = [scalar_queries, report_queries, lead_queries, v1_queries, research_queries, people_queries, event_queries, compose_queries, contract_queries, provider_queries, company_queries, sink_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q04_campaign_funnel"](spark, sf_dir)
