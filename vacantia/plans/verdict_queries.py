"""Verdicts and tiers on the archive, and searches by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators import verdicts as V
from vacantia.operators.search import Filters, matches, search
from vacantia.plans.archive import SQL, ads, feedback
from vacantia.plans.company_queries import _DAY, _STATUS, company_status, latest_feedback, searched
from vacantia.plans.metric_queries import ORACLES as METRICS
from vacantia.plans.metric_queries import keyword_sectors
from vacantia.plans.upkeep_queries import PLACES_SQL as _PLACES
from vacantia.plans.upkeep_queries import resolved_places
from vacantia.runtime import table

#: The rules of these queries: titles that the first judge refuses, titles that count as primary, and sectors that are wanted.
REFUSED, PRIMARY, PHD = "support|assistenza|soporte|conseiller|betreuer", "analyst|analista|modell|model", "ph\\.?d|dottorato|doctorat|promotion"
#: An entry of `city_reference`.
CITY = 101
PREFERRED = ("Energy", "Water", "Mobility")


def roles(spark: SparkSession, folder: str) -> DataFrame:
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    policy = F.lower(T.clean("remote_policy"))
    rows = ads(spark, folder, "title", "remote_policy", keep=("company_id", "last_seen"))
    rules = F.when(title.rlike(REFUSED), V.DROP).otherwise(V.UNKNOWN)
    model = F.when(policy.isin("remote", "hybrid"), V.KEEP).when(policy == "on-site", V.DROP).otherwise(V.UNKNOWN)
    said = latest_feedback(spark, folder).where("opportunity_id is not null")
    users = said.groupBy(F.col("opportunity_id").alias("id")).agg(F.max(F.struct("id", "status"))["status"].alias("s")).select("id", F.when(F.col("s") == "saved", V.KEEP).when(F.col("s") == "discarded", V.DROP).alias("verdict"))
    newest = rows.agg(F.max("last_seen")).scalar()
    closed = rows.where(F.coalesce(F.datediff(newest, "last_seen") >= 14, F.lit(True))).select("id")
    return V.role_verdicts(rows, [("rules", rules), ("model", model)], title.rlike(PRIMARY), [("user", users)], closed, title.rlike(PHD))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    found = keyword_sectors(spark, folder).where("labels <> ''").select(F.col("id").alias("company_id"), F.posexplode(F.split("labels", r"\+")))
    return found.select("company_id", F.col("col").alias("category"), F.col("pos").alias("rank"), F.lit("rules").alias("method"))


def tiers(spark: SparkSession, folder: str) -> DataFrame:
    return V.company_tiers(V.label_summary(table(spark, folder, "companies"), _labels(spark, folder)), roles(spark, folder), PREFERRED)


def role_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, company_id, verdict, judge, primary, closed, eligibility, phd) of each ad of the archive."""
    return roles(spark, folder)


def archive_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, category, axis, tier, keeps) of each company, from its sectors, its ads and the decisions on them."""
    return tiers(spark, folder)


def archive_tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(tier, axis, companies, with_keeps): companies by tier."""
    return tiers(spark, folder).groupBy("tier", "axis").agg(F.count("*").alias("companies"), F.count_if(F.col("keeps") > 0).alias("with_keeps"))


def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(id, category, method, labels): the first label of each company, and all of them in order."""
    return V.label_summary(table(spark, folder, "companies"), _labels(spark, folder)).withColumn("labels", F.array_join("labels", "+"))


def labels_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, category, rank, method): first labels, given by hand for saved companies, after new rules have labelled all."""
    saved = company_status(spark, folder).where("status = 'saved'").select("company_id", F.lit(True).alias("s"))
    held = table(spark, folder, "companies").select(F.col("id").alias("company_id"), F.lower(T.clean("sectors")).alias("category"), F.lit(0).alias("rank")).where("category <> ''")
    held = held.join(saved, "company_id", "left").select("company_id", "category", "rank", F.when(F.col("s"), "hand").otherwise("import").alias("method"))
    return V.replaced_labels(held, _labels(spark, folder), "hand")


def _context(spark: SparkSession, folder: str, f: Filters) -> dict[str, DataFrame]:
    """The tables a filter needs, no others."""
    found: dict[str, DataFrame] = {}
    if f.country or f.city:
        found["places"] = resolved_places(spark, folder)
    if f.eligibility or f.phd or f.tier:
        found["roles"] = roles(spark, folder)
    if f.tier:
        found["tiers"] = tiers(spark, folder)
    if f.category:
        found["labels"] = _labels(spark, folder)
    return found


def _search(spark: SparkSession, folder: str, f: Filters) -> DataFrame:
    return search(table(spark, folder, "companies"), searched(spark, folder, f), company_status(spark, folder), f, **_context(spark, folder, f))


def search_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with an ad to be reviewed that was posted lately or is undated."""
    return _search(spark, folder, Filters(eligibility="review", posted_since="2026-06-01", sort="posted", limit=500))


def search_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of tier A with one of the ads it rests on in a place whose text holds `de`."""
    return _search(spark, folder, Filters(tier="A", location="de", sort="roles", limit=500))


def search_category(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of a sector that mention a tool, or whose ads do."""
    return _search(spark, folder, Filters(category="Energy", text="python", sort="name", limit=500))


def search_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Companies without a label."""
    return _search(spark, folder, Filters(category=V.UNLABELLED, sort="name", limit=500))


def search_phd(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with ads whose titles speak of modelling in place of a doctorate, which no title of the archive has."""
    f = Filters(phd=True, sort="roles", limit=500)
    found = roles(spark, folder).withColumn("phd", F.col("primary") & (F.col("eligibility") != "excluded"))
    return search(table(spark, folder, "companies"), searched(spark, folder, f), company_status(spark, folder), f, roles=found)


def search_city(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ads): companies with an ad in one city of the list, and how many; exact aliases decide what is in it."""
    return _search(spark, folder, Filters(city=CITY, sort="name", limit=500)).select("id", F.col("matching_roles").alias("ads"))


def search_total(spark: SparkSession, folder: str) -> DataFrame:
    """(total): how many companies answer `search_tier`, beyond any page."""
    f = Filters(tier="A", location="de")
    return matches(table(spark, folder, "companies"), searched(spark, folder, f), company_status(spark, folder), f, **_context(spark, folder, f)).agg(F.count("*").alias("total"))


QUERIES = {f.__name__: f for f in (
    role_verdicts, archive_tiers, archive_tier_counts, category_summary, labels_replaced, search_eligibility, search_tier, search_category, search_unlabelled, search_phd, search_city, search_total)}

_TIDY = lambda c: f"case when {c} is null or lower(trim({c})) in ('n/a', 'none', 'null', 'nan') then '' else lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) end"
ROLES_SQL = f"""last as (select * from (select *, row_number() over (partition by opportunity_id order by id desc) as k from events_log where undone_at is null and opportunity_id is not null) where k = 1),
  ju as (select a.id, a.company_id, lower(coalesce(title, '')) as t, {_TIDY('remote_policy')} as policy, case l.status when 'saved' then 'tieni' when 'discarded' then 'scarta' end as u,
    last_seen is null or date_diff('day', cast(last_seen as date), cast((select max(last_seen) from ads) as date)) >= 14 as closed from ads a left join last l on l.opportunity_id = a.id),
  jv as (select *, case when regexp_matches(t, '{REFUSED}') then 'scarta' end as r, case when policy in ('remote', 'hybrid') then 'tieni' when policy = 'on-site' then 'scarta' end as m from ju),
  roles as (select id, company_id, coalesce(u, r, m, 'non_so') as verdict, case when u is not null then 'user' when r is not null then 'rules' when m is not null then 'model' end as judge,
    regexp_matches(t, '{PRIMARY}') or coalesce(u = 'tieni', false) as "primary", closed, case coalesce(u, r, m, 'non_so') when 'tieni' then 'potential' when 'scarta' then 'excluded' else 'review' end as eligibility, regexp_matches(t, '{PHD}') as phd from jv)"""
LABELS_SQL = f"""sec as ({METRICS['keyword_sectors']}), labels as (select id as company_id, unnest(string_split(labels, '+')) as category, unnest(range(len(string_split(labels, '+')))) as rank, 'rules' as method from sec where labels <> ''),
  summary as (select id, case when labels = '' then 'Da classificare' else string_split(labels, '+')[1] end as category, case when labels = '' then 'unknown' else 'rules' end as method, labels from sec)"""
TIERS_SQL = f"""{ROLES_SQL}, {LABELS_SQL}, counts as (select company_id, count(*) filter (verdict = 'tieni' and not closed) as keeps, count(*) filter (verdict = 'tieni' and not closed and "primary") as primaries from roles group by 1),
  ax as (select s.id, category, case when labels = '' then 'evidenza_mancante' when len(list_intersect(string_split(labels, '+'), {list(PREFERRED)})) > 0 then 'interessante' else 'non_interessante' end as axis, coalesce(keeps, 0) as keeps, coalesce(primaries, 0) as primaries
    from summary s left join counts c on c.company_id = s.id),
  tiers as (select id, category, axis, case when axis = 'interessante' and keeps > 0 then 'A' when axis = 'interessante' then 'B-attesa' when primaries > 0 then 'B-esperienza' when axis = 'evidenza_mancante' then 'evidenza-mancante' else 'scarto' end as tier, keeps from ax)"""


def _found(text: str, role: str, company: str, order: str, needed: bool) -> str:
    """The companies that answer a search, as a select over the views above."""
    hit = f"lower(a.data) like '%{text}%'" if text else "false"
    own = f"lower(c.name || ' ' || coalesce(c.description, '') || ' ' || coalesce(c.sectors, '')) like '%{text}%'" if text else "true"
    return f"""{SQL}, {_STATUS}, {TIERS_SQL}, a as (select *, {_DAY} as day from ads), n as (select company_id, count(*) as opportunity_count, count(*) filter ({role}) as roles, count(*) filter (({role}) and {hit}) as text_roles, max(day) filter ({role}) as latest_posted from a group by 1)
      select c.id, c.name, coalesce(s.status, 'new') as status, coalesce(n.opportunity_count, 0) as opportunity_count, coalesce(nullif(n.text_roles, 0), n.roles, 0) as matching_roles, n.latest_posted
      from companies c left join n on n.company_id = c.id left join statuses s on s.company_id = c.id where ({own} or coalesce(n.text_roles, 0) > 0) and {company} {'and coalesce(n.roles, 0) > 0' if needed else ''} {order}"""


_BY_NAME = "order by lower(c.name) nulls first, c.id limit 500"
_A = ("id in (select id from roles where verdict = 'tieni' and not closed) and lower(cast(to_json(locations) as varchar)) like '%de%'", "c.id in (select id from tiers where tier = 'A')")
ORACLES = {
    "role_verdicts": f"{SQL}, {ROLES_SQL} select * from roles",
    "archive_tiers": f"{SQL}, {TIERS_SQL} select * from tiers",
    "archive_tier_counts": f"{SQL}, {TIERS_SQL} select tier, axis, count(*) as companies, count(*) filter (keeps > 0) as with_keeps from tiers group by 1, 2",
    "category_summary": f"{SQL}, {LABELS_SQL} select * from summary",
    "labels_replaced": f"""{SQL}, {_STATUS}, {LABELS_SQL}, held as (select id as company_id, {_TIDY('sectors')} as category, 0 as rank, case when s.status = 'saved' then 'hand' else 'import' end as method from companies c left join statuses s on s.company_id = c.id where {_TIDY('sectors')} <> ''),
      taken as (select * from labels where company_id not in (select company_id from held where method = 'hand')) select * from held where company_id not in (select company_id from taken) union all select * from taken""",
    "search_eligibility": _found("", "id in (select id from roles where eligibility = 'review') and (day is null or day >= '2026-06-01')", "true", "order by latest_posted desc nulls last, lower(c.name) nulls first, c.id limit 500", True),
    "search_tier": _found("", *_A, "order by matching_roles desc, lower(c.name) nulls first, c.id limit 500", True),
    "search_category": _found("python", "true", "c.id in (select company_id from labels where category = 'Energy')", _BY_NAME, False),
    "search_unlabelled": _found("", "true", "c.id not in (select company_id from labels)", _BY_NAME, False),
    "search_phd": _found("", "id in (select id from roles where \"primary\" and eligibility <> 'excluded')", "true", "order by matching_roles desc, lower(c.name) nulls first, c.id limit 500", True),
    "search_city": f"""{_PLACES}, o as (select distinct id, company_id from opportunities) select c.id, count(*) as ads from companies c join o on o.company_id = c.id
      where o.id in (select opportunity_id from rp where city = {CITY}) group by c.id, c.name order by lower(c.name) nulls first, c.id limit 500""",
    "search_total": f"select count(*) as total from ({_found('', *_A, '', True)})",
}
