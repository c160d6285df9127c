"""Tables written twice and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import shared_folder
from leadspark.plans.inputs import table, with_sql
from leadspark.sources import sinks as K

c = F.col


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of leads by campaign; later the months of closed leads come again with other figures, twice."""
    leads = table(spark, sf_dir, "leads").withColumn("campaign_id", F.when(c("campaign_id") != "1-URGENT", c("campaign_id")))
    months = lambda rows, add: rows.groupBy(F.trunc("discovered_at", "month").alias("day"), "campaign_id").agg((F.count("*") + add).alias("n"))
    path = _folder(spark, "daily")
    K.write_daily(months(leads.where("stage <> 'NURTURE'"), 0), path, ["campaign_id"])
    for _ in range(2):
        K.write_daily(months(leads.where("stage in ('NURTURE', 'INTERESTED')"), 1000), path, ["campaign_id"])
    return spark.read.parquet(path).select("day", "campaign_id", "n")


def _mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the companies; then half of all with other names and partly without a niche, twice."""
    rows = table(spark, sf_dir, "companies").select("company_id", "name", "niche")
    path = _folder(spark, "mirror")
    K.write_mirror(rows.where("company_id % 3 <> 0"), path, "company_id", 8)
    for _ in range(2):
        K.write_mirror(rows.where("company_id % 2 = 0").select("company_id", F.concat("name", F.lit(" II")).alias("name"), F.when(c("company_id") % 5 == 0, "new").alias("niche")), path, "company_id", 8)
    return spark.read.parquet(path).select("company_id", "name", "niche")


QUERIES = {"io09_daily": _daily, "io08_mirror": _mirror}

_MONTHS = "(select cast(date_trunc('month', discovered_at) as date) as day, nullif(campaign_id, '1-URGENT') as campaign_id, count(*) as n from leads where {} group by all)"
_FIRST, _AGAIN = "stage <> 'NURTURE'", "stage in ('NURTURE', 'INTERESTED')"
ORACLES = {
    "io09_daily": with_sql(
        f"select coalesce(a.day, b.day) as day, coalesce(a.campaign_id, b.campaign_id) as campaign_id, coalesce(b.n + 1000, a.n) as n from {_MONTHS.format(_FIRST)} a"
        f" full join {_MONTHS.format(_AGAIN)} b on a.day = b.day and coalesce(a.campaign_id, '') = coalesce(b.campaign_id, '')"
    ),
    "io08_mirror": with_sql(
        "select company_id, case when company_id % 2 = 0 then name || ' II' else name end as name, case when company_id % 2 = 0 and company_id % 5 = 0 then 'new' when company_id % 3 <> 0 then niche end as niche"
        " from companies where company_id % 3 <> 0 or company_id % 2 = 0"
    ),
}
