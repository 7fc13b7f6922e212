"""Queries about companies: search, decisions over time, tiers, documents, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators import decisions as D
from vacantia.operators.ranks import examples, latest
from vacantia.operators.search import Filters, matches, matching_ads, search
from vacantia.plans.archive import SQL, ads, feedback
from vacantia.runtime import table

KEEP, DROP, UNKNOWN = "keep", "drop", "unknown"


def company_status(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, status): the last decision on each company as a whole that wasn't undone."""
    events = feedback(spark, folder).where("opportunity_id is null and undone_at is null").select("company_id", "id", "status")
    return latest(events, ["company_id"], ["id"]).select("company_id", "status")


def searched(spark: SparkSession, folder: str, f: Filters) -> DataFrame:
    """(id, company_id, day, hit, near) of each ad: what a search needs to know of it."""
    return ads(spark, folder, "locations", "posted_at", derived={"day": T.day("posted_at"), **f.marks()})


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observations").select("opportunity_id", F.lower(F.trim("source")).alias("source"))


def _search(spark: SparkSession, folder: str, f: Filters) -> DataFrame:
    return search(table(spark, folder, "companies"), searched(spark, folder, f), company_status(spark, folder), f, sources=_sources(spark, folder))


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """Companies that mention a tool, or whose ads do."""
    return _search(spark, folder, Filters(text="postgresql", sort="roles", limit=500))


def search_same_row(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with an ad in a place, posted lately or undated, seen on a board: all on one ad."""
    return _search(spark, folder, Filters(location="italia", posted_since="2026-03-01", source="boardnova", sort="posted", limit=500))


def search_status(spark: SparkSession, folder: str) -> DataFrame:
    """Companies whose last decision is `saved`, by name."""
    return _search(spark, folder, Filters(status="saved", sort="name", limit=500))


def search_text_ads(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, id): the ads that answer `search_text`, of all companies that do."""
    f = Filters(text="postgresql")
    rows = searched(spark, folder, f)
    return matching_ads(matches(table(spark, folder, "companies"), rows, company_status(spark, folder), f), rows, f)


def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of all companies by last sight."""
    return _search(spark, folder, Filters(sort="recent", limit=20, offset=20))


def tier_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(company, tier): both axes composed when read, over customers as companies and orders as their ads."""
    o = table(spark, folder, "orders")
    rule = D.judgement(F.when(F.col("o_orderpriority") == "5-LOW", DROP).otherwise(UNKNOWN), "rules")
    model = D.judgement(F.when(F.col("o_totalprice") >= 300_000, KEEP).when(F.col("o_totalprice") <= 80_000, DROP).otherwise(UNKNOWN), "model")
    verdict = D.first_decided([rule, model], [KEEP, DROP], UNKNOWN)["verdict"]
    roles = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or(verdict == KEEP).alias("keeps"), F.bool_or((verdict == KEEP) & (F.col("o_orderpriority") == "1-URGENT")).alias("primary"))
    c = table(spark, folder, "customer")
    labels = F.when(F.col("c_acctbal") >= 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    axis = D.axis(labels, ["BUILDING", "MACHINERY"], "missing", "yes", "no")
    joined = c.select("c_custkey", axis.alias("axis")).join(roles, "c_custkey", "left")
    keeps, primary = F.coalesce("keeps", F.lit(False)), F.coalesce("primary", F.lit(False))
    tier = D.decision_table([
        ((F.col("axis") == "yes") & keeps, "A"), (F.col("axis") == "yes", "B-attesa"), (primary, "B-esperienza"), (F.col("axis") == "missing", "evidenza-mancante")], "scarto")
    return joined.select("c_custkey", tier.alias("tier"))


def tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(tier, companies): the flagship."""
    return tier_verdicts(spark, folder).groupBy("tier").agg(F.count("*").alias("companies"))


def latest_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """The last decision that stands on each company and ad."""
    events = feedback(spark, folder).where("undone_at is null")
    return latest(events, ["company_id", "opportunity_id"], ["id"]).select("company_id", "opportunity_id", "id", "status", "reason")


def saved_list(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, whole, ads): companies that are saved, or that have saved ads, and how many."""
    last = latest_feedback(spark, folder).where("status = 'saved'")
    return last.groupBy("company_id").agg(F.bool_or(F.col("opportunity_id").isNull()).alias("whole"), F.countDistinct("opportunity_id").alias("ads"))


def decision_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(kept, discarded, share): companies by their last decision, and the share kept of those decided."""
    c = company_status(spark, folder).agg(F.count_if(F.col("status") == "saved").alias("kept"), F.count_if(F.col("status") == "discarded").alias("discarded"))
    return c.withColumn("share", F.round(F.try_divide("kept", F.col("kept") + F.col("discarded")), 6))


def discard_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """(reason, companies): distinct companies behind each reason of standing discards."""
    return latest_feedback(spark, folder).where("status = 'discarded'").groupBy("reason").agg(F.countDistinct("company_id").alias("companies"))


def proposals_having(spark: SparkSession, folder: str) -> DataFrame:
    """(sector, companies): sectors of which at least three companies were discarded."""
    discarded = latest_feedback(spark, folder).where("status = 'discarded'").select("company_id").distinct()
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), F.lower(T.clean("sectors")).alias("sector")).where("sector <> ''")
    return c.join(discarded, "company_id", "left_semi").groupBy("sector").agg(F.count("*").alias("companies")).where("companies >= 3")


def feedback_append(spark: SparkSession, folder: str) -> DataFrame:
    """(id): events that changed something: others repeat the standing decision on their company and ad word for word."""
    events = feedback(spark, folder).where("undone_at is null")
    from pyspark.sql import Window

    w = Window.partitionBy("company_id", "opportunity_id").orderBy("id")
    said = F.struct("status", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("until_date", F.lit("")).alias("until_date"))
    return events.withColumn("_s", said).withColumn("_p", F.lag("_s").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("_s"))).select("id")


#: Ads in one part of a company's document, about.
DOCUMENT_ADS = 500


def company_document(spark: SparkSession, folder: str) -> DataFrame:
    """Nested documents of each company: its columns, its ads with the boards that show them, its standing decisions.

    A company's document comes in parts of about DOCUMENT_ADS ads, so an agency with a third of all ads is many rows
    of bounded size; decisions stand beside the ad they are on, those on the company in part 0.
    """
    jobs = ads(spark, folder, "title", "source_url", "locations")
    said = latest_feedback(spark, folder).select("company_id", F.col("opportunity_id").alias("id"), F.col("status").alias("decision"))
    parts = jobs.groupBy("company_id").agg(F.ceil(F.count("*") / DOCUMENT_ADS).alias("parts"))
    boards = _sources(spark, folder).groupBy(F.col("opportunity_id").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    dealt = jobs.join(parts, "company_id").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(said.where("id is not null"), ["company_id", "id"], "left").join(boards, "id", "left")
    nested = dealt.groupBy("company_id", "part").agg(F.array_sort(F.collect_list(F.struct("id", "title", "source_url", "locations", "decision", "sources"))).alias("ads"))
    whole = said.where("id is null").select("company_id", "decision")
    c = table(spark, folder, "companies").withColumnRenamed("id", "company_id")
    return c.join(nested, "company_id", "left").withColumn("part", F.coalesce("part", F.lit(0))).join(whole, "company_id", "left").withColumnRenamed("company_id", "id")


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, decision, ad, title, ad_decision, sources): the documents of `company_document` taken apart again; ad is null where a company has none."""
    d = company_document(spark, folder).select("id", "name", "decision", F.explode_outer("ads").alias("a"))
    return d.select("id", "name", "decision", F.col("a.id").alias("ad"), F.col("a.title").alias("title"), F.col("a.decision").alias("ad_decision"), F.array_join("a.sources", ",").alias("sources"))


def role_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(id, fingerprint): what a decision on an ad was based on."""
    a = ads(spark, folder, "title", "remote_policy", "employment_type")
    return a.select("id", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("title", "remote_policy", "employment_type")]), 256).alias("fingerprint"))


def basis_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, basis): digest over the content of all ads of a company; changes when any of them does.

    The digests of the ads are put together by exclusive or, in four numbers of 60 bits, with map-side parts: nothing is
    gathered, however many ads a company has. Ids are unique, so no ad cancels another.
    """
    a = ads(spark, folder, keep=("company_id", "content_hash")).withColumn("d", F.sha2(F.concat_ws(":", "id", F.lower("content_hash")), 256))
    parts = [F.lpad(F.lower(F.hex(F.bit_xor(F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("long")))), 16, "0") for i in range(4)]
    return a.groupBy("company_id").agg(F.concat(*parts).alias("basis"))


def longest_description(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, id, characters): the ad with the longest description of each company, ties by id."""
    a = ads(spark, folder, "description").select("company_id", "id", F.length("description").cast("long").alias("characters")).where("characters > 0")
    return a.groupBy("company_id").agg(F.min(F.struct((-F.col("characters")).alias("o"), "id")).alias("b")).select("company_id", "b.id", (-F.col("b.o")).alias("characters"))


def best_company_text(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, doc_id, doc_type): the text to describe a company by: kinds in order of trust, then the longest."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("company_page", "card_summary", "evidence", "ad_text")]), F.col("doc_type"))
    d = table(spark, folder, "documents").where("company_id is not null and n_chars >= 80").withColumn("o", order).where("o > 0")
    best = d.groupBy("company_id").agg(F.min(F.struct("o", (-F.col("n_chars")).alias("n"), "doc_id", "doc_type")).alias("b"))
    return best.select("company_id", "b.doc_id", "b.doc_type")


def first_titles(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, titles): the first five different titles of each company."""
    e = examples(ads(spark, folder, "title").where("title is not null").select("company_id", "title", "id"), ["company_id"], ["title"], ["id"], 5)
    return e.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda x: x["title"]), " / ").alias("titles"))


QUERIES = {f.__name__: f for f in (
    company_status, search_text, search_same_row, search_status, search_text_ads, search_page, tier_verdicts, tier_counts, latest_feedback, saved_list, decision_metrics, discard_reasons, proposals_having,
    feedback_append, company_document, document_rows, role_snapshot, basis_fingerprint, longest_description, best_company_text, first_titles)}

_STATUS = "statuses as (select company_id, status from (select *, row_number() over (partition by company_id order by id desc) as k from events_log where opportunity_id is null and undone_at is null) where k = 1)"
_DAY = r"case when regexp_matches(posted_at, '^\d{4}-\d{2}-\d{2}') then posted_at[1:10] when regexp_matches(posted_at, '^\d{2}/\d{2}/\d{4}') then posted_at[7:10] || '-' || posted_at[4:5] || '-' || posted_at[1:2] end"
_LATEST = "last as (select * from (select *, row_number() over (partition by company_id, opportunity_id order by id desc) as k from events_log where undone_at is null) where k = 1)"
_CLEAN = r"case when lower(trim(sectors)) in ('n/a', 'none', 'null', 'nan') then '' else lower(trim(sectors)) end"


def _search_sql(text: str, role: str, company: str, order: str, page: str, roles_needed: bool) -> str:
    hit = f"lower(data) like '%{text}%'" if text else "false"
    own = f"lower(c.name || ' ' || coalesce(c.description, '') || ' ' || coalesce(c.sectors, '')) like '%{text}%'" if text else "true"
    return f"""{SQL}, {_STATUS}, a as (select *, {_DAY} as day, {hit} as hit from ads), f as (select * from a where {role}),
      n as (select company_id, count(*) as roles, count(*) filter (hit) as text_roles, max(day) as latest_posted from f group by 1), e as (select company_id, count(*) as opportunity_count from a group by 1),
      r as (select c.id, c.name, c.last_seen, coalesce(s.status, 'new') as status, coalesce(e.opportunity_count, 0) as opportunity_count, coalesce(nullif(n.text_roles, 0), n.roles, 0) as matching_roles,
        n.latest_posted, coalesce(n.text_roles, 0) as text_roles from companies c left join n on n.company_id = c.id left join e on e.company_id = c.id left join statuses s on s.company_id = c.id
        where ({own} or coalesce(n.text_roles, 0) > 0) and {company} {'and coalesce(n.roles, 0) > 0' if roles_needed else ''}),
      p as (select * from r order by {order}, lower(name) nulls first, id {page})
      select p.id, p.name, p.status, p.opportunity_count, p.matching_roles, p.latest_posted from p"""


_TIERS = """select c_custkey, case when axis = 'yes' and coalesce(keeps, false) then 'A' when axis = 'yes' then 'B-attesa' when coalesce(prim, false) then 'B-esperienza' when axis = 'missing' then 'evidenza-mancante' else 'scarto' end as tier
  from (select c_custkey, case when c_acctbal < 0 then 'missing' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'yes' else 'no' end as axis from customer) c
  left join (select o_custkey, bool_or(v) as keeps, bool_or(v and o_orderpriority = '1-URGENT') as prim from (select *, o_orderpriority <> '5-LOW' and o_totalprice >= 300000 as v from orders where o_orderstatus <> 'F') group by 1) o on o_custkey = c_custkey"""
ORACLES = {
    "document_rows": f"""{SQL}, {_LATEST}, b as (select opportunity_id, string_agg(source, ',' order by source) as sources from (select distinct opportunity_id, lower(trim(source)) as source from observations) group by 1)
      select c.id, c.name, w.status as decision, a.id as ad, a.title, s.status as ad_decision, b.sources from companies c left join ads a on a.company_id = c.id left join b on b.opportunity_id = a.id
      left join last w on w.company_id = c.id and w.opportunity_id is null left join last s on s.company_id = c.id and s.opportunity_id = a.id""",
    "company_status": f"{SQL}, {_STATUS} select * from statuses",
    "search_text": _search_sql("postgresql", "true", "true", "matching_roles desc", "limit 500", False),
    "search_text_ads": _search_sql("postgresql", "true", "true", "matching_roles desc", "", False).replace(
        "select p.id, p.name, p.status, p.opportunity_count, p.matching_roles, p.latest_posted from p", "select f.company_id, f.id from p join f on f.company_id = p.id where p.text_roles = 0 or f.hit"),
    "search_same_row": _search_sql("", "lower(cast(to_json(locations) as varchar)) like '%italia%' and (day is null or day >= '2026-03-01') and id in (select opportunity_id from observations where lower(trim(source)) = 'boardnova')", "true", "latest_posted desc nulls last", "limit 500", True),
    "search_status": _search_sql("", "true", "coalesce(s.status, 'new') = 'saved'", "lower(name) nulls first", "limit 500", False),
    "search_page": _search_sql("", "true", "true", "last_seen desc nulls last", "limit 20 offset 20", False),
    "tier_verdicts": _TIERS,
    "tier_counts": f"select tier, count(*) as companies from ({_TIERS}) group by 1",
    "latest_feedback": f"{SQL}, {_LATEST} select company_id, opportunity_id, id, status, reason from last",
    "saved_list": f"{SQL}, {_LATEST} select company_id, bool_or(opportunity_id is null) as whole, count(distinct opportunity_id) as ads from last where status = 'saved' group by 1",
    "decision_metrics": f"{SQL}, {_STATUS} select count(*) filter (status = 'saved') as kept, count(*) filter (status = 'discarded') as discarded, round(count(*) filter (status = 'saved') / nullif(count(*) filter (status in ('saved', 'discarded')), 0), 6) as share from statuses",
    "discard_reasons": f"{SQL}, {_LATEST} select reason, count(distinct company_id) as companies from last where status = 'discarded' group by 1",
    "proposals_having": f"{SQL}, {_LATEST} select sector, count(*) as companies from (select id, {_CLEAN} as sector from companies) where coalesce(sector, '') <> '' and id in (select company_id from last where status = 'discarded') group by 1 having count(*) >= 3",
    "feedback_append": f"""{SQL}, s as (select id, (status, coalesce(note, ''), coalesce(reason, ''), coalesce(until_date, '')) as said, company_id, opportunity_id from events_log where undone_at is null)
      select id from (select id, said, lag(said) over (partition by company_id, opportunity_id order by id) as before from s) where before is null or before <> said""",
    "role_snapshot": f"{SQL} select id, sha256(coalesce(title, '') || '|' || coalesce(remote_policy, '') || '|' || coalesce(employment_type, '')) as fingerprint from ads",
    "basis_fingerprint": f"{SQL}, d as (select company_id, sha256(case when content_hash is null then id else id || ':' || lower(content_hash) end) as d from ads) select company_id, " + " || ".join(
        f"lpad(lower(to_hex(bit_xor(cast('0x' || d[{15 * i + 1}:{15 * i + 15}] as bigint)))), 16, '0')" for i in range(4)) + " as basis from d group by 1",
    "longest_description": f"{SQL} select company_id, id, characters from (select company_id, id, length(description) as characters, row_number() over (partition by company_id order by length(description) desc, id) as k from ads where length(description) > 0) where k = 1",
    "best_company_text": """select company_id, doc_id, doc_type from (select *, row_number() over (partition by company_id order by list_position(['company_page', 'card_summary', 'evidence', 'ad_text'], doc_type), n_chars desc, doc_id) as k
      from documents where company_id is not null and n_chars >= 80 and doc_type in ('company_page', 'card_summary', 'evidence', 'ad_text')) where k = 1""",
    "first_titles": f"""{SQL}, t as (select company_id, title, min(id) as id from ads where title is not null group by 1, 2), r as (select *, row_number() over (partition by company_id order by id, title) as k from t)
      select company_id, string_agg(title, ' / ' order by k) as titles from r where k <= 5 group by 1""",
}
