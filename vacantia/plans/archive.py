"""The archive's tables as the other plans read them: one row per id, payloads typed, only the columns asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.runtime import table

#: Payload fields by name; lists and structs keep their shape.
FIELDS = {
    "title": "string", "source_url": "string", "application_url": "string", "company_profile_url": "string", "locations": "array<string>", "remote_policy": "string",
    "employment_type": "string", "description": "string", "posted_at": "string", "source": "string", "language": "string",
    "salary": "struct<min:double,max:double,currency:string,period:string,raw_text:string>",
}


def ads(spark: SparkSession, folder: str, *fields: str, keep: tuple[str, ...] = ("company_id",), derived: dict[str, Column] | None = None) -> DataFrame:
    """Ads by id with the given payload fields; repeated rows count once. Only what is asked for is read and shuffled.

    With `derived` columns, made of the fields and of all columns of the table, only `keep` and these are shuffled.
    """
    kind = ", ".join(f"`{f}` {FIELDS[f]}" for f in fields)
    rows = table(spark, folder, "opportunities")
    if fields:
        rows = rows.withColumn("_p", F.from_json("data", kind))
    typed = {f: F.col(f"_p.{f}") for f in fields}
    if derived:
        shown = rows.withColumns(typed).select("id", *keep, *[c.alias(name) for name, c in derived.items()])
    else:
        shown = rows.select("id", *keep, *[c.alias(f) for f, c in typed.items()])
    return shown.dropDuplicates(["id"])


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """The event log of decisions; a repeated event counts once."""
    return table(spark, folder, "feedback").dropDuplicates(["id"])


#: The same views for the SQL checks.
SQL = """
with ads as (
  select distinct id, company_id, first_seen, last_seen, content_hash, data,
    json_extract_string(data, '$.title') as title, json_extract_string(data, '$.source_url') as source_url,
    cast(json_extract(data, '$.locations') as varchar[]) as locations, json_extract_string(data, '$.remote_policy') as remote_policy,
    json_extract_string(data, '$.employment_type') as employment_type, json_extract_string(data, '$.description') as description,
    json_extract_string(data, '$.posted_at') as posted_at, json_extract_string(data, '$.source') as source,
    json_extract_string(data, '$.language') as language from opportunities),
events_log as (select distinct * from feedback)
"""
#: A text on one line, sentinels as empty, for the SQL checks.
FLAT = r"case when {0} is null or lower(trim(regexp_replace({0}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))) in ('n/a', 'none', 'null', 'nan') then '' else trim(regexp_replace({0}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g')) end"
