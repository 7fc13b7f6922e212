"""Keeping derived tables current: fingerprints, closures, folds of repeated deliveries, company identity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.functions.fold import name_key


def stale(inputs: DataFrame, cache: DataFrame, key: str, marks: Sequence[str]) -> DataFrame:
    """The inputs that the cache doesn't hold with the same fingerprints (nulls are equal)."""
    same = inputs[key] == cache[key]
    for m in marks:
        same = same & inputs[m].eqNullSafe(cache[m])
    return inputs.join(cache.select(key, *marks), same, "left_anti")


def refresh(inputs: DataFrame, cache: DataFrame, key: str, marks: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache brought up to date: current rows are kept, stale and new ones computed, those without an input dropped."""
    held = cache.alias("c").join(inputs.select(key, *marks).alias("i"), (F.col(f"c.{key}") == F.col(f"i.{key}")) & _equal(marks), "left_semi")
    return held.unionByName(compute(stale(inputs, cache, key, marks)))


def _equal(marks: Sequence[str]) -> Column:
    condition = F.lit(True)
    for m in marks:
        condition = condition & F.col(f"c.{m}").eqNullSafe(F.col(f"i.{m}"))
    return condition


def closures(seen: DataFrame, ads: DataFrame, closed: DataFrame, sources: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """((source, id) of ads taken for closed, (source, population, gone, skipped)).

    `seen` has (id, source, at), `ads` (id, company_id, day), `closed` (id), `sources` (source, started, hours) for the
    sources that were swept completely; hours is how far back a source lists, null for all. An ad is gone if no source
    has seen it since the sweep began and, where a source looks back only so far, it was posted inside that window less a
    day. A source that would close more than a share `most` of its open ads is skipped.
    """
    open_ads = ads.join(closed, "id", "left_anti")
    last = seen.groupBy("id").agg(F.max("at").alias("last"))
    per = seen.select("id", "source").distinct().join(sources, "source").join(open_ads, "id").join(last, "id")
    edge = F.date_format(F.expr("started - make_interval(0, 0, 0, 0, hours, 0, 0) + interval 1 day"), "yyyy-MM-dd")
    gone = (F.col("last") < F.col("started")) & (F.col("hours").isNull() | F.coalesce(F.col("day") >= edge, F.lit(False)))
    marked = per.withColumn("gone", gone)
    total = marked.groupBy("source").agg(F.count("*").alias("population"), F.count_if("gone").alias("gone"))
    total = total.withColumn("skipped", F.col("gone") > most * F.col("population"))
    kept = total.where("not skipped").select("source")
    return marked.where("gone").join(kept, "source", "left_semi").select("source", "id"), total


def fold_observations(rows: DataFrame) -> DataFrame:
    """(id, source, url, at): the last time each ad was seen at each address."""
    return rows.groupBy("id", "source", "url").agg(F.max("at").alias("at"))


def fold_payloads(rows: DataFrame) -> DataFrame:
    """One payload for each ad from deliveries (id, source, at, text, ...): the latest, with the text that tells more.

    An older delivery never replaces a newer one. The latest text holds unless it is empty or a longer one came from
    another source.
    """
    rest = [c for c in rows.columns if c not in ("id", "at")]
    latest = F.max(F.struct("at", *rest))
    size = F.coalesce(F.length("text"), F.lit(0))
    longest = F.max(F.struct(size.alias("n"), "at", "source", "text"))
    both = rows.groupBy("id").agg(latest.alias("l"), longest.alias("t"), F.min("at").alias("first_seen"))
    own = F.coalesce(F.length("l.text"), F.lit(0))
    richer = (own == 0) | ((F.col("t.n") > own) & (F.col("t.source") != F.col("l.source")))
    text = F.when(richer, F.col("t.text")).otherwise(F.col("l.text"))
    return both.select("id", "first_seen", F.col("l.at").alias("last_seen"), *[text.alias("text") if c == "text" else F.col(f"l.{c}").alias(c) for c in rest])


def company_identity(rows: DataFrame, name: str, website: str) -> DataFrame:
    """`rows` with `company`, the id of the company a name and a website mean.

    Names are equal by compatibility form and case. Rows of one name are one company unless they have different hosts;
    then each host is one, and rows without a host are another. Rows without a name get a null id.
    """
    keyed = rows.withColumn("_k", F.nullif(name_key(T.clean(name)), F.lit(""))).withColumn("_h", F.coalesce(T.host(website), F.lit("")))
    hosts = keyed.where("_k is not null and _h <> ''").groupBy("_k").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    joined = keyed.join(hosts, "_k", "left")
    host = F.when(F.col("_a").isNull() | (F.col("_a") == F.col("_b")), F.coalesce("_a", F.lit(""))).otherwise(F.col("_h"))
    return joined.withColumn("company", T.identity(F.concat_ws("|", "_k", host))).withColumn("company", F.when(F.col("_k").isNotNull(), F.col("company"))).drop("_k", "_h", "_a", "_b")


def normalized(raw: DataFrame, source: str) -> DataFrame:
    """Rows of a delivery as ads, with `reason` where one is refused.

    `raw` has map<string,string> `row`; every field is the first filled one of its aliases. A name, a title and one
    http(s) address are required.
    """
    pick = lambda *names: T.first_filled(*[F.col("row")[n] for n in names])
    link = T.canonical_url(pick("source_url", "original_url", "job_url", "url", "Apply to Job", "Job Posting URL"))
    apply = T.canonical_url(pick("application_url", "job_url_direct"))
    remote = F.when(F.lower(F.col("row")["is_remote"]) == "true", "remote")
    rows = raw.select(
        "*", pick("company_name", "company", "Company").alias("company_name"), pick("title", "Position Title", "Job Title").alias("title"), link.alias("source_url"),
        F.when(apply == "", link).otherwise(apply).alias("application_url"), T.canonical_url(pick("website_url", "company_url_direct")).alias("website_url"),
        pick("sectors", "Company Vertical", "company_industry").alias("sectors"), pick("company_description").alias("company_description"),
        F.array_distinct(F.filter(F.array(pick("location", "Location", "Job Location"), pick("Country")), lambda x: x != "")).alias("locations"),
        F.coalesce(F.nullif(pick("remote_policy", "work_model", "Remote"), F.lit("")), remote).alias("remote_policy"),
        F.nullif(pick("employment_type", "job_type", "Commitment (Beta)"), F.lit("")).alias("employment_type"),
        F.struct(
            T.number(F.col("row")["min_amount"]).alias("min"), T.number(F.col("row")["max_amount"]).alias("max"), F.nullif(pick("currency"), F.lit("")).alias("currency"),
            F.nullif(pick("interval"), F.lit("")).alias("period"), F.nullif(pick("salary"), F.lit("")).alias("raw_text")).alias("salary"),
        F.trim(F.coalesce(F.col("row")["description"], F.lit(""))).alias("description"),
        F.nullif(pick("posted_at", "date_posted", "date_first_listed", "Date first listed"), F.lit("")).alias("posted_at"), F.lit(source).alias("source"))
    missing = (F.col("company_name") == "") | (F.col("title") == "") | (F.col("source_url") == "")
    return rows.withColumn("reason", F.when(missing, "company_name, title and one http(s) address are required"))
