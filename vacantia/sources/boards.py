"""Answers of public job boards as common rows: what was fetched is text in a column, mapped by one expression a board."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.html import html_text
from vacantia.functions.text import clean, day

ROW = ("title", "source_url", "description", "posted_at", "locations", "remote_policy", "employment_type")


@dataclass(frozen=True)
class Board:
    """How a board's answer is read: its form, where the jobs are, and the columns of a row from `j`."""

    schema: str
    jobs: str
    title: str
    url: str
    text: tuple[str, ...]
    posted: tuple[str, ...]
    places: str
    remote: str = "null"
    kind: str = "null"
    listed: str = "true"
    xml: bool = False


_MODE = "case when {0} then 'remote' when {1} then 'hybrid' end"
#: The fields of each board's public answer.
BOARDS = {
    "greenhouse": Board(
        "struct<jobs:array<struct<title:string,absolute_url:string,content:string,first_published:string,updated_at:string,location:struct<name:string>,metadata:array<struct<name:string,value:string>>>>>",
        "a.jobs", "j.title", "j.absolute_url", ("j.content",), ("j.first_published", "j.updated_at"), "array(j.location.name)",
        kind="filter(j.metadata, m -> lower(m.name) = 'employment type')[0].value"),
    "lever": Board(
        "array<struct<text:string,hostedUrl:string,openingPlain:string,descriptionPlain:string,additionalPlain:string,createdAt:string,workplaceType:string,lists:array<struct<text:string,content:string>>,"
        "categories:struct<location:string,allLocations:array<string>,commitment:string>>>",
        "a", "j.text", "j.hostedUrl", ("j.openingPlain", "j.descriptionPlain", "concat_ws('<br>', transform(j.lists, x -> concat_ws('<br>', x.text, x.content)))", "j.additionalPlain"), ("j.createdAt",),
        "coalesce(j.categories.allLocations, array(j.categories.location))", "case when j.workplaceType in ('remote', 'hybrid') then j.workplaceType end", "j.categories.commitment"),
    "ashby": Board(
        "struct<jobs:array<struct<title:string,jobUrl:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string,location:string,secondaryLocations:array<struct<location:string>>,workplaceType:string,isRemote:boolean,isListed:boolean,employmentType:string>>>",
        "a.jobs", "j.title", "j.jobUrl", ("coalesce(nullif(j.descriptionPlain, ''), j.descriptionHtml)",), ("j.publishedAt",), "concat(array(j.location), coalesce(j.secondaryLocations.location, array()))",
        _MODE.format("coalesce(j.isRemote, false) or lower(j.workplaceType) = 'remote'", "lower(j.workplaceType) = 'hybrid'"), "j.employmentType", "coalesce(j.isListed, true)"),
    "workable": Board(
        "struct<jobs:array<struct<title:string,shortlink:string,url:string,description:string,published_on:string,created_at:string,city:string,country:string,locations:array<struct<city:string,region:string,country:string>>,telecommuting:boolean,employment_type:string>>>",
        "a.jobs", "j.title", "coalesce(j.shortlink, j.url)", ("j.description",), ("j.published_on", "j.created_at"),
        "if(size(j.locations) > 0, transform(j.locations, x -> concat_ws(', ', x.city, x.region, x.country)), array(concat_ws(', ', j.city, j.country)))", _MODE.format("j.telecommuting", "false"), "j.employment_type"),
    "smartrecruiters": Board(
        "struct<content:array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<fullLocation:string,city:string,country:string,remote:boolean,hybrid:boolean>,typeOfEmployment:struct<label:string>,jobAd:struct<sections:map<string,struct<title:string,text:string>>>>>>",
        "a.content", "j.name", "concat('https://jobs.smartrecruiters.com/', slug, '/', j.id)", ("concat_ws('<br>', transform(map_values(j.jobAd.sections), x -> concat_ws('<br>', x.title, x.text)))",), ("j.releasedDate",),
        "array(coalesce(j.location.fullLocation, concat_ws(', ', j.location.city, j.location.country)))", _MODE.format("j.location.remote", "j.location.hybrid"), "j.typeOfEmployment.label"),
    "recruitee": Board(
        "struct<offers:array<struct<title:string,careers_url:string,description:string,requirements:string,published_at:string,created_at:string,location:string,city:string,country:string,remote:boolean,hybrid:boolean,employment_type_code:string>>>",
        "a.offers", "j.title", "j.careers_url", ("j.description", "j.requirements"), ("j.published_at", "j.created_at"), "array(coalesce(j.location, concat_ws(', ', j.city, j.country)))", _MODE.format("j.remote", "j.hybrid"), "j.employment_type_code"),
    "personio": Board(
        "struct<position:array<struct<id:string,name:string,office:array<string>,createdAt:string,schedule:string,employmentType:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>>",
        "a.position", "j.name", "concat('https://', slug, '.jobs.personio.de/job/', j.id)", ("concat_ws('<br>', transform(j.jobDescriptions.jobDescription, x -> concat_ws('<br>', x.name, x.value)))",), ("j.createdAt",), "j.office",
        kind="coalesce(j.schedule, j.employmentType)", xml=True),
    "teamtailor": Board(
        "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string,remoteStatus:string,`tt:locations`:struct<`tt:location`:array<struct<`tt:city`:string,`tt:country`:string>>>>>>>",
        "a.channel.item", "j.title", "j.link", ("j.description",), ("j.pubDate",), "transform(j.`tt:locations`.`tt:location`, x -> concat_ws(', ', x.`tt:city`, x.`tt:country`))",
        "case when lower(j.remoteStatus) in ('remote', 'hybrid') then lower(j.remoteStatus) end", xml=True),
    "workday": Board(
        "struct<jobPostings:array<struct<title:string,externalPath:string,locationsText:string,jobPostingInfo:struct<jobDescription:string,startDate:string,timeType:string,location:string,additionalLocations:array<string>>>>>",
        "a.jobPostings", "j.title", "concat(base, j.externalPath)", ("j.jobPostingInfo.jobDescription",), ("j.jobPostingInfo.startDate",),
        "if(j.jobPostingInfo.location is null, array(j.locationsText), concat(array(j.jobPostingInfo.location), coalesce(j.jobPostingInfo.additionalLocations, array())))", kind="j.jobPostingInfo.timeType",
        listed="j.externalPath is not null"),
}
BOARDS["lever_eu"] = BOARDS["lever"]


def _rfc_day(c: Column) -> Column:
    """The ISO date of `Tue, 10 Sep 2026 08:00:00 +0000`; the weekday is left to the calendar."""
    return F.date_format(F.try_to_date(F.regexp_extract(c, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), "d MMM yyyy"), "yyyy-MM-dd")


def board_rows(answers: DataFrame, board: str) -> DataFrame:
    """(slug, *ROW) of the jobs in fetched answers (slug, base, body) of one board.

    An answer that can't be read gives no rows; jobs that aren't listed are left out. Texts lose their markup, entities
    that are escaped twice included; dates become ISO dates; empty places go.
    """
    b = BOARDS[board]
    read = F.from_xml("body", b.schema) if b.xml else F.from_json("body", b.schema)
    rows = answers.select("slug", "base", read.alias("a")).select("slug", "base", F.explode(F.expr(b.jobs)).alias("j")).where(F.expr(b.listed))
    when = F.coalesce(*[F.coalesce(day(F.expr(p)), _rfc_day(F.expr(p))) for p in b.posted])
    parts = [F.nullif(F.trim(html_text(html_text(F.expr(t)))), F.lit("")) for t in b.text]
    places = F.filter(F.array_distinct(F.transform(F.expr(b.places), clean)), lambda x: x != "")
    return rows.select(
        "slug", F.expr(b.title).alias("title"), F.expr(b.url).alias("source_url"), F.concat_ws("\n\n", *parts).alias("description"), when.alias("posted_at"),
        F.coalesce(places, F.array().cast("array<string>")).alias("locations"), F.expr(b.remote).cast("string").alias("remote_policy"), F.expr(b.kind).cast("string").alias("employment_type"))


def watch_list(boards: DataFrame) -> DataFrame:
    """Each (board, slug) once, slugs regardless of case; of repeated entries the first by company."""
    held = boards.withColumn("slug", F.lower("slug")).groupBy("board", "slug").agg(F.min("company").alias("company"))
    return held.where("slug is not null and board is not null")


def paged(rows: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """(rows without repeated addresses, (query, pages, stop)) of pages (query, page, pos, url, ...).

    The first row of an address counts. A query stops at an empty page, one without new addresses, a short one, or its cap.
    """
    rest = [c for c in rows.columns if c not in ("query", "url", "page", "pos")]
    firsts = rows.groupBy("query", "url").agg(F.min(F.struct("page", "pos", *rest)).alias("r")).select("query", "url", "r.*")
    pages = rows.groupBy("query", "page").agg(F.count("url").alias("n")).join(firsts.groupBy("query", "page").agg(F.count("url").alias("fresh")), ["query", "page"], "left")
    last = pages.groupBy("query").agg(F.max(F.struct("page", "n", F.coalesce("fresh", F.lit(0)).alias("fresh"))).alias("l"))
    stop = F.when(F.col("l.n") == 0, "empty_or_blocked").when(F.col("l.fresh") == 0, "no_new_urls").when(F.col("l.n") < wanted, "short_page").otherwise("page_cap")
    return firsts.where("url is not null"), last.select("query", (F.col("l.page") + 1).alias("pages"), stop.alias("stop"))


def embedded_rows(tables: DataFrame) -> DataFrame:
    """(id, row map<string,string>) of an embedded table's answer: column ids to names, choice ids to labels, lists joined.

    `tables` has `body`, a JSON object with `columns` (id, name, choices) and `rows` (id, cells by column id).
    """
    schema = "struct<columns:array<struct<id:string,name:string,choices:map<string,struct<name:string>>>>,rows:array<struct<id:string,cellValuesByColumnId:map<string,string>>>>"
    t = tables.select(F.from_json("body", schema).alias("t"))
    names = F.map_from_entries(F.transform("t.columns", lambda c: F.struct(c["id"], c["name"])))
    labels = F.flatten(F.transform("t.columns", lambda c: F.transform(F.map_entries(F.coalesce(c["choices"], F.create_map().cast("map<string,struct<name:string>>"))), lambda e: F.struct(e["key"], e["value"]["name"].alias("value")))))
    rows = t.select(names.alias("n"), F.map_from_entries(labels).alias("l"), F.explode("t.rows").alias("r"))

    def text(v: Column) -> Column:
        linked = F.map_values(F.from_json(F.get_json_object(v, "$.valuesByForeignRowId"), "map<string,string>"))
        items = F.coalesce(F.from_json(v, "array<string>"), linked, F.array(F.coalesce(F.get_json_object(v, "$.url"), v)))
        return F.array_join(F.filter(F.transform(items, lambda x: clean(F.coalesce(F.col("l")[x], x))), lambda x: x != ""), ", ")

    cells = F.map_filter("r.cellValuesByColumnId", lambda k, v: F.map_contains_key("n", k))
    return rows.select(F.col("r.id").alias("id"), F.map_from_entries(F.transform(F.map_entries(cells), lambda e: F.struct(F.col("n")[e["key"]], text(e["value"])))).alias("row"))
