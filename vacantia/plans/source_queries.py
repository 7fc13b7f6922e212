"""Sources and sinks over the archive's rows: what is written as an answer or a sheet must read back the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.plans.archive import SQL, ads
from vacantia.plans.company_queries import _DAY
from vacantia.runtime import table
from vacantia.sources.boards import board_rows, watch_list
from vacantia.sources.files import flat_text
from vacantia.streaming.deliveries import windowed_counts


def board_payload(spark: SparkSession, folder: str) -> DataFrame:
    """(source_url, title, posted_at, locations): ads put into a board's answer and read from it."""
    a = ads(spark, folder, "title", "source_url", "posted_at", "locations")
    place = F.struct(F.array_join(T.clean_list("locations"), " + ").alias("name"))
    body = F.to_json(F.struct(F.array(F.struct("title", F.col("source_url").alias("absolute_url"), F.col("posted_at").alias("first_published"), place.alias("location"))).alias("jobs")))
    rows = board_rows(a.select("id", F.col("id").alias("slug"), F.lit("").alias("base"), body.alias("body")), "greenhouse")
    return rows.select(F.col("slug").alias("id"), "source_url", "title", "posted_at", F.array_join("locations", " + ").alias("locations"))


def export_companies(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, website, sectors, opportunity_count): the sheet of companies, safe to open in a spreadsheet."""
    n = ads(spark, folder).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("opportunity_count"))
    c = table(spark, folder, "companies").select("id", "name", "website", F.split("sectors", ", ").alias("sectors"))
    return flat_text(c.join(n, "id", "left").withColumn("opportunity_count", F.coalesce("opportunity_count", F.lit(0))), ", ")


def watched_boards(spark: SparkSession, folder: str) -> DataFrame:
    """(board, slug, company): each board and host of the ads' own pages once."""
    a = ads(spark, folder, "source_url", "source")
    return watch_list(a.select(F.col("source").alias("board"), T.host("source_url").alias("slug"), F.col("company_id").alias("company")))


def sight_windows(spark: SparkSession, folder: str) -> DataFrame:
    """(start, source, sights): observations by day of event time."""
    return windowed_counts(table(spark, folder, "observations"))


QUERIES = {f.__name__: f for f in (board_payload, export_companies, watched_boards, sight_windows)}
ORACLES = {
    "export_companies": f"""{SQL} select c.id, case when regexp_matches(name, '^[=+\\-@]') then '''' || name else name end as name, case when regexp_matches(website, '^[=+\\-@]') then '''' || website else website end as website, sectors,
      cast(count(a.id) as varchar) as opportunity_count from companies c left join ads a on a.company_id = c.id group by 1, 2, 3, 4""",
    "watched_boards": f"{SQL} select source as board, regexp_replace(lower(regexp_extract(source_url, '^(?i:https?)://([^/?#:@\\s]+)', 1)), '^www\\.', '') as slug, min(company_id) as company from ads where source is not null group by 1, 2",
    "sight_windows": "select date_trunc('day', observed_at) as start, lower(trim(source)) as source, count(*) as sights from observations group by 1, 2",
    "board_payload": f"""{SQL}, p as (select id, source_url, title, {_DAY} as posted_at, trim(regexp_replace(array_to_string(list_filter(list_transform(locations, lambda x: trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '' and lower(x) not in ('n/a', 'none', 'null', 'nan')), ' + '), '\\s+', ' ', 'g')) as locations from ads)
      select id, source_url, title, posted_at, locations from p""",
}
