"""Companies found by filters on themselves and on their ads, where all ad filters hold on the same ad."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import ascii_lower, like
from vacantia.operators.verdicts import ELIGIBILITY, TIERS, UNLABELLED, qualifying


@dataclass(frozen=True)
class Filters:
    """What to search for; empty values don't filter."""

    text: str = ""
    location: str = ""
    source: str = ""
    status: str = ""
    country: int = 0
    city: int = 0
    posted_since: str = ""
    eligibility: str = ""
    phd: bool = False
    category: str = ""
    tier: str = ""
    sort: str = "recent"
    limit: int = 30
    offset: int = 0

    def __post_init__(self) -> None:
        for name, value, known in (("sort", self.sort, tuple(SORTS)), ("status", self.status, STATUSES), ("tier", self.tier, TIERS), ("eligibility", self.eligibility, tuple(ELIGIBILITY.values()))):
            if (value or name == "sort") and value not in known:
                raise ValueError(f"unknown {name} {value!r}; one of {', '.join(known)}")

    @property
    def on_ads(self) -> bool:
        """Whether a company needs an ad that passes."""
        return bool(self.location or self.posted_since or self.source or self.country or self.city or self.eligibility or self.phd or self.tier in ("A", "B-esperienza"))

    def marks(self) -> dict[str, Column]:
        """What a search wants to know of each ad, from its payload `data` and its `locations`; taken before ads are shuffled, it spares the payload."""
        return {"hit": like("data", self.text) if self.text else F.lit(False), "near": like(F.to_json("locations"), self.location, literal=True) if self.location else F.lit(True)}


#: Orders of the list of companies, and states of a company.
SORTS = {
    "posted": ("latest_posted", True), "recent": ("last_seen", True), "name": ("name_order", False), "roles": ("matching_roles", True),
}
STATUSES = ("new", "review", "saved", "discarded", "contacted")


@dataclass(frozen=True)
class Tables:
    """What filters look things up in; only the tables that a filter needs have to be given.

    sources (opportunity_id, source), places (opportunity_id, country, city), roles as of `role_verdicts`, tiers (id,
    tier), labels (company_id, category).
    """

    sources: DataFrame | None = None
    places: DataFrame | None = None
    roles: DataFrame | None = None
    tiers: DataFrame | None = None
    labels: DataFrame | None = None


def _marked(ads: DataFrame, f: Filters) -> DataFrame:
    return ads.withColumns({name: mark for name, mark in f.marks().items() if name not in ads.columns})


def role_filter(ads: DataFrame, f: Filters, **tables: DataFrame | None) -> DataFrame:
    """The ads on which every filter holds. Undated ads pass a filter of dates; country and city must be of one place.

    Tiers A and B-esperienza rest on certain ads: there the other filters must hold on one of those.
    """
    c, ads = Tables(**tables), _marked(ads, f)
    if f.location:
        ads = ads.where("near")
    if f.posted_since:
        ads = ads.where(F.col("day").isNull() | (F.col("day") >= f.posted_since))
    if f.source:
        ads = ads.join(c.sources.where(F.col("source") == f.source).select(F.col("opportunity_id").alias("id")), "id", "left_semi")
    if f.country or f.city:
        place = (F.col("country") == f.country if f.country else F.lit(True)) & (F.col("city") == f.city if f.city else F.lit(True))
        ads = ads.join(c.places.where(place).select(F.col("opportunity_id").alias("id")), "id", "left_semi")
    if f.eligibility:
        ads = ads.join(c.roles.where(F.col("eligibility") == f.eligibility).select("id"), "id", "left_semi")
    if f.phd:
        ads = ads.join(c.roles.where("phd").select("id"), "id", "left_semi")
    if f.tier in ("A", "B-esperienza"):
        ads = ads.join(qualifying(c.roles, f.tier), "id", "left_semi")
    return ads


def _text_of(c: DataFrame) -> Column:
    return F.concat(F.coalesce(c["name"], F.lit("")), F.lit(" "), F.coalesce(c["description"], F.lit("")), F.lit(" "), F.coalesce(c["sectors"], F.lit("")))


def matches(companies: DataFrame, ads: DataFrame, statuses: DataFrame, f: Filters, **tables: DataFrame | None) -> DataFrame:
    """All companies that answer, with status, opportunity_count, matching_roles, text_roles and latest_posted.

    `ads` has (id, company_id, day) and either the columns of `Filters.marks` or those they are made of; `tables` are
    those of `Tables`. A text is looked for in the company or in an ad's payload; if ads hold it, only those count. Ads
    are counted by company, in one pass, before the join.
    """
    c, ads = Tables(**tables), _marked(ads, f).select("id", "company_id", "day", "hit", "near")
    passed = role_filter(ads, f, **tables).select("id").withColumn("passed", F.lit(True)) if f.on_ads else None
    ads = ads.join(passed, "id", "left") if f.on_ads else ads.withColumn("passed", F.lit(True))
    counts = ads.groupBy(F.col("company_id").alias("id")).agg(
        F.count("*").alias("opportunity_count"), F.count_if("passed").alias("roles"), F.count_if(F.col("passed") & F.col("hit")).alias("text_roles"), F.max(F.when(F.col("passed"), F.col("day"))).alias("latest_posted"))
    rows = companies.withColumn("_own", like(_text_of(companies), f.text) if f.text else F.lit(True)).select("id", "name", "last_seen", "_own").join(counts, "id", "left")
    rows = rows.join(statuses.select(F.col("company_id").alias("id"), "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    if f.on_ads:
        rows = rows.where("roles > 0")
    if f.text:
        rows = rows.where(F.col("_own") | (F.coalesce("text_roles", F.lit(0)) > 0))
    if f.status:
        rows = rows.where(F.col("status") == f.status)
    if f.tier:
        rows = rows.join(c.tiers.where(F.col("tier") == f.tier).select("id"), "id", "left_semi")
    if f.category:
        labelled = c.labels if f.category == UNLABELLED else c.labels.where(F.col("category") == f.category)
        rows = rows.join(labelled.select(F.col("company_id").alias("id")), "id", "left_anti" if f.category == UNLABELLED else "left_semi")
    matching = F.coalesce(F.nullif("text_roles", F.lit(0)), "roles", F.lit(0)).cast("long")
    return rows.select("id", "name", "status", "last_seen", F.coalesce("opportunity_count", F.lit(0)).alias("opportunity_count"), matching.alias("matching_roles"), F.coalesce("text_roles", F.lit(0)).alias("text_roles"), "latest_posted")


def search(companies: DataFrame, ads: DataFrame, statuses: DataFrame, f: Filters, **tables: DataFrame | None) -> DataFrame:
    """A page of `matches`, in the order asked for."""
    key, down = SORTS[f.sort]
    rows = matches(companies, ads, statuses, f, **tables).withColumn("name_order", ascii_lower("name"))
    order = F.desc_nulls_last(key) if down else F.asc_nulls_first(key)
    page = rows.orderBy(order, F.asc_nulls_first("name_order"), "id").offset(max(f.offset, 0)).limit(min(max(f.limit, 1), 500))
    return page.select("id", "name", "status", "opportunity_count", "matching_roles", "latest_posted")


def matching_ads(found: DataFrame, ads: DataFrame, f: Filters, **tables: DataFrame | None) -> DataFrame:
    """(company_id, id): the ads that answer a search, for the companies of a page or of all `matches`; a row each, as a company may have any number.

    Where ads of a company hold the text, only they match.
    """
    own = role_filter(ads, f, **tables).join(found.select(F.col("id").alias("company_id")), "company_id")
    texts = own.groupBy(F.col("company_id").alias("c")).agg(F.bool_or("hit").alias("any_hit"))
    return own.join(texts, F.col("company_id") == F.col("c")).where(~F.col("any_hit") | F.col("hit")).select("company_id", "id")
