"""Problem 5 in the archive's terms: `observations` arrives as full deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.snapshots import snapshot_changes
from vacantia.runtime import table


def observation_states(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with their canonical columns: folded source, address without query, fragment and trailing slash."""
    rows = table(spark, folder, "observations")
    bare = F.regexp_replace(F.regexp_replace("source_url", r"[?#].*$", ""), r"/+$", "")
    return rows.select(
        "snapshot_no", "opportunity_id",
        F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("source"),
        "observed_at", bare.alias("address"), F.lower("content_hash").alias("content"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_no, opportunity_id, source, change): records added, removed and changed."""
    return snapshot_changes(
        observation_states(spark, folder), ["opportunity_id", "source"], "snapshot_no", "observed_at", ["address"], ["content"])


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_no, change, records): how many records of each kind a delivery brought."""
    return p5_found(spark, folder).groupBy("snapshot_no", "change").agg(F.count("*").alias("records"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_STATES = r"""
with canon as (
  select snapshot_no, opportunity_id, lower(trim(source, E' \t\r\n ')) as source, observed_at,
         regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', '') as address, lower(content_hash) as content
  from observations where snapshot_no is not null and opportunity_id is not null and source is not null),
held as (
  select * from (select *, row_number() over (partition by snapshot_no, opportunity_id, source
    order by observed_at desc nulls last, address desc, content desc) as n from canon) where n = 1),
numbers as (select snapshot_no as now_no, lag(snapshot_no) over (order by snapshot_no) as then_no
  from (select distinct snapshot_no from canon)),
found as (
  select n.now_no as snapshot_no, l.opportunity_id, l.source,
    case when e.opportunity_id is null then 'added'
         when e.address is distinct from l.address or (e.content <> l.content) then 'changed' end as change
  from numbers n join held l on l.snapshot_no = n.now_no
  left join held e on e.snapshot_no = n.then_no and e.opportunity_id = l.opportunity_id and e.source = l.source
  where n.then_no is not null
  union all
  select n.now_no, e.opportunity_id, e.source, 'removed'
  from numbers n join held e on e.snapshot_no = n.then_no
  left join held l on l.snapshot_no = n.now_no and e.opportunity_id = l.opportunity_id and e.source = l.source
  where l.opportunity_id is null)
"""
ORACLES = {
    "p5_found": _STATES + "select snapshot_no, opportunity_id, source, change from found where change is not null",
    "p5_counts": _STATES + "select snapshot_no, change, count(*) as records from found where change is not null group by 1, 2",
}
