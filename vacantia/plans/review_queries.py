"""Queues, populations, plans and versions of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators import review as W
from vacantia.plans.archive import FLAT, SQL, ads, feedback
from vacantia.plans.verdict_queries import TIERS_SQL, roles, tiers
from vacantia.runtime import table


def answer_errors(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, error): events read as typed answers, those that can't be used."""
    e = table(spark, folder, "events")
    error = W.answer_error(F.col("value") / 100, F.col("event_type"), ("view", "click", "purchase", "signup"), F.get_json_object("props", "$.k").try_cast("double") / 90)
    return e.select("event_id", error.alias("error")).where("error is not null")


def evidence_added(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id): evidence that isn't held yet for its company in the same words."""
    d = table(spark, folder, "documents").where("company_id is not null").select("doc_id", "doc_type", "company_id", T.clean("text").alias("text"))
    pick = lambda kind: d.where(F.col("doc_type") == kind).select("doc_id", "company_id", "text")
    return W.added(pick("company_page"), pick("evidence"), ["company_id", "text"], "doc_id").select("doc_id")


def request_queue(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, id, outcome, ticket): ads to be judged and companies to be labelled, in one queue."""
    text = ads(spark, folder, "description", keep=(), derived={"size": F.length(T.clean("description"))})
    undecided = roles(spark, folder).where("eligibility = 'review' and not closed").select("id")
    missing = tiers(spark, folder).where("axis = 'evidenza_mancante'").select("id")
    c = table(spark, folder, "companies").select("id", F.length(T.clean("description")).alias("size"))
    return W.work_queue([("role", text.join(undecided, "id", "left_semi")), ("category", c.join(missing, "id", "left_semi"))], 1500).select("kind", "id", "outcome", "ticket")


def card_plan(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, id, kind): the cards to be written."""
    readable = ads(spark, folder, "description", keep=(), derived={"has": T.clean("description") != ""}).where("has")
    facts = table(spark, folder, "companies").where(T.clean("description") != "").select(F.col("id").alias("company_id"))
    return W.card_plan(tiers(spark, folder), roles(spark, folder), readable, facts)


def company_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, digest, doc_type, doc_id, copies): the different texts about each company with where they come from."""
    return W.provenance(table(spark, folder, "documents"), "company_id", "text", "doc_type", "doc_id")


def _populations(spark: SparkSession, folder: str) -> DataFrame:
    decided = feedback(spark, folder).where("undone_at is null and opportunity_id is not null").select(F.col("opportunity_id").alias("id"))
    return W.populations(roles(spark, folder), tiers(spark, folder), decided)


def session_populations(spark: SparkSession, folder: str) -> DataFrame:
    """(population, id): the ads a session may be about."""
    return _populations(spark, folder)


def session_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, members, first, last): the selection, frozen in batches of fifty."""
    f = W.frozen(_populations(spark, folder).where("population = 'selection'"), "id", 50)
    return f.groupBy("batch").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.max("id").alias("last"))


def sources_due(spark: SparkSession, folder: str) -> DataFrame:
    """(source, last, due): which boards are to be read again, a delivery being a run and a snapshot's parity its settings."""
    runs = table(spark, folder, "observations").select(F.lower(F.trim("source")).alias("source"), (F.col("snapshot_no") % 2).alias("fingerprint"), F.col("delivered_at").alias("at"), F.lit(True).alias("ok"))
    sources = runs.select("source", F.lit(0).alias("fingerprint")).distinct()
    return W.due(runs, sources, runs.agg(F.max("at")).scalar(), 24 * 10)


def reparse_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(outcome, n): texts of ads kept as documents against the descriptions as delivered."""
    d = table(spark, folder, "documents").where("doc_type = 'ad_text' and opportunity_id is not null").select(F.col("opportunity_id").alias("id"), "text")
    return d.join(ads(spark, folder, "description"), "id").groupBy(W.reread(F.col("text"), F.col("description")).alias("outcome")).agg(F.count("*").alias("n"))


def shortlist_page(spark: SparkSession, folder: str) -> DataFrame:
    """(id, tier, keeps): the first hundred companies to look at."""
    return W.shortlist(tiers(spark, folder), ("A", "B-esperienza", "B-attesa"), 500)


def archive_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, version): keys for what is computed from the companies, the ads and the decisions."""
    c = W.version(table(spark, folder, "companies"), "companies", "id", "name", "sectors")
    a = W.version(ads(spark, folder, keep=("company_id", "content_hash")), "ads", "id", "company_id", "content_hash")
    return c.union(a).union(W.version(feedback(spark, folder), "decisions", "id", "status", "reason"))


QUERIES = {f.__name__: f for f in (
    answer_errors, evidence_added, request_queue, card_plan, company_inputs, session_populations, session_batches, sources_due, reparse_outcomes, shortlist_page, archive_versions)}

_POPULATIONS = f"""{SQL}, {TIERS_SQL}, dec as (select distinct opportunity_id as id from events_log where undone_at is null and opportunity_id is not null),
  pop as (select 'undecided' as population, id from roles where not closed and verdict = 'non_so' and id not in (select id from dec) union all select 'selection', id from roles where not closed and verdict = 'tieni'
    union all select 'to_apply', id from roles where not closed and verdict = 'tieni' and id not in (select id from dec) and company_id in (select id from tiers where tier = 'A'))"""
_VERSION = "select '{0}' as name, count(*) as rows, lpad(lower(to_hex(cast(sum(cast('0x' || d[1:8] as bigint)) as bigint))), 16, '0') || lpad(lower(to_hex(cast(sum(cast('0x' || d[9:16] as bigint)) as bigint))), 16, '0') as version from (select sha256(concat_ws('|', {1})) as d from {2})"
_KEY = lambda *columns: ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in columns)
ORACLES = {
    "answer_errors": """select * from (select event_id, case when value is null or not value / 100 between 0 and 1 then 'probability' when event_type is null or event_type not in ('view', 'click', 'purchase', 'signup') then 'option'
      when coalesce(not try_cast(json_extract_string(props, '$.k') as double) / 90 between 0 and 1, true) then 'confidence' end as error from events) where error is not null""",
    "evidence_added": f"""with d as (select doc_id, doc_type, company_id, {FLAT.format('text')} as t from documents where company_id is not null)
      select min(doc_id) as doc_id from d where doc_type = 'evidence' and not exists (select 1 from d h where h.doc_type = 'company_page' and h.company_id = d.company_id and h.t = d.t) group by company_id, t""",
    "request_queue": f"""{SQL}, {TIERS_SQL}, q as (select 'role' as kind, id, length({FLAT.format('description')}) as size from ads where id in (select id from roles where eligibility = 'review' and not closed)
      union all select 'category', id, length({FLAT.format('description')}) from companies where id in (select id from tiers where axis = 'evidenza_mancante'))
      select kind, id, case when size = 0 then 'empty' when size > 1500 then 'oversized' else 'planned' end as outcome, sha256(kind || ':' || id) as ticket from q""",
    "card_plan": f"""{SQL}, {TIERS_SQL} select r.company_id, r.id, 'role' as kind from roles r join tiers t on t.id = r.company_id join ads a on a.id = r.id where verdict = 'tieni' and not closed and tier in ('A', 'B-esperienza') and {FLAT.format('a.description')} <> ''
      union all select t.id, null, 'company' from tiers t join companies c on c.id = t.id where (tier = 'A' or tier like 'B-%') and {FLAT.format('c.description')} <> ''""",
    "company_inputs": r"""with d as (select company_id, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) as t, doc_type, doc_id from documents where company_id is not null and text is not null)
      select company_id, md5(t) as digest, min(struct_pack(a := doc_type, b := doc_id)).a as doc_type, min(struct_pack(a := doc_type, b := doc_id)).b as doc_id, count(*) as copies from d where t <> '' group by 1, 2""",
    "session_populations": f"{_POPULATIONS} select * from pop",
    "session_batches": f"{_POPULATIONS} select batch, count(*) as members, min(id) as first, max(id) as last from (select id, (row_number() over (order by id) - 1) // 50 as batch from pop where population = 'selection') group by 1",
    "sources_due": """with r as (select lower(trim(source)) as source, snapshot_no % 2 as f, delivered_at as at_ from observations), s as (select distinct source from r), l as (select source, max(at_) as last from r where f = 0 group by 1)
      select source, last, last is null or last < (select max(at_) from r) - interval 240 hour as due from s left join l using (source)""",
    "reparse_outcomes": r"""{0}, p as (select text as b, description as a, regexp_replace(coalesce(text, ''), '[\s\x0b]+', '', 'g') as x, regexp_replace(coalesce(description, ''), '[\s\x0b]+', '', 'g') as y from documents d join ads on ads.id = d.opportunity_id where doc_type = 'ad_text')
      select case when x = '' and y = '' then 'none' when x = '' then 'found' when y = '' then 'lost' when a = b then 'same' when x = y then 'respaced' else 'differs' end as outcome, count(*) as n from p group by 1""".replace("{0}", SQL),
    "shortlist_page": f"{SQL}, {TIERS_SQL} select id, tier, keeps from tiers where tier in ('A', 'B-esperienza', 'B-attesa') order by list_position(['A', 'B-esperienza', 'B-attesa'], tier), keeps desc, id limit 100",
    "archive_versions": f"{SQL} " + " union all ".join((_VERSION.format("companies", _KEY("id", "name", "sectors"), "companies"), _VERSION.format("ads", _KEY("id", "company_id", "content_hash"), "ads"), _VERSION.format("decisions", _KEY("id", "status", "reason"), "events_log"))),
}
