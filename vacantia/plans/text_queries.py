"""Scalar operators over the archive's own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.functions.fold import fold
from vacantia.functions.html import html_lines, html_text
from vacantia.functions.languages import detect_language
from vacantia.plans.archive import SQL, ads, feedback
from vacantia.runtime import table

LEGAL_FORMS = ("srl", "spa", "gmbh", "ltd", "inc", "ag", "ab", "bv", "sa", "plc", "sp", "zoo", "z", "oo", "limited", "incorporated", "publ")


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, website, sectors): display texts of companies, sentinels as empty."""
    return table(spark, folder, "companies").select("id", *[T.clean(c).alias(c) for c in ("name", "website", "sectors")])


def salary_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, low, high, currency, period): finite amounts and cleaned units."""
    s = ads(spark, folder, "salary")
    return s.select("id", T.number("salary.min").alias("low"), T.number("salary.max").alias("high"), F.upper(T.clean("salary.currency")).alias("currency"), F.lower(T.clean("salary.period")).alias("period"))


def identity_hash(spark: SparkSession, folder: str) -> DataFrame:
    """(id, key): the compact id of each company's name and host."""
    c = table(spark, folder, "companies")
    return c.select("id", T.identity(F.concat_ws("|", F.lower(T.clean("name")), T.host("website"))).alias("key"))


def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Every observed address: canonical form, registered domain, outbound form, board."""
    urls = table(spark, folder, "observations").select("source_url", F.lower(F.trim("source")).alias("source")).distinct()
    boards = {"boardnova": "nova", "jobcrate": "crate"}
    return urls.select("source_url", "source", T.canonical_url("source_url").alias("url"), T.registrable("source_url").alias("domain"), T.outbound("source_url").alias("outbound"), T.canonical_source("source_url", "source", boards).alias("board"))


def website_kind(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, companies): what the saved addresses of companies are."""
    kind = T.site_kind("website", ["profilehub.example"]).alias("kind")
    return table(spark, folder, "companies").groupBy(kind).agg(F.count("*").alias("companies"))


def posted_day(spark: SparkSession, folder: str) -> DataFrame:
    """(id, day): the date of each ad's posting, whatever its notation."""
    return ads(spark, folder, "posted_at").select("id", T.day("posted_at").alias("day"))


def display_text(spark: SparkSession, folder: str) -> DataFrame:
    """(id, note, note_length, waited): notes cut for a list, numbers and durations as shown."""
    f = feedback(spark, folder)
    waited = F.unix_timestamp("undone_at") - F.unix_timestamp("created_at")
    return f.select("id", T.compact("note", 40).alias("note"), T.thousands(F.col("id") * 97).alias("shown"), F.when(waited.isNotNull(), T.duration(waited)).alias("waited"))


def like_search(spark: SparkSession, folder: str) -> DataFrame:
    """(id): companies whose name, description or sectors hold a text, ASCII case aside."""
    c = table(spark, folder, "companies")
    whole = F.concat("name", F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("sectors", F.lit("")))
    return c.where(T.like(whole, "ENERGY")).select("id")


def html_lines_query(spark: SparkSession, folder: str) -> DataFrame:
    """(id, lines, first_line, judgeable): descriptions as lines of text."""
    lines = ads(spark, folder, "description").select("id", html_lines("description").alias("lines"))
    return lines.select("id", F.size("lines").cast("long").alias("lines"), F.get("lines", F.lit(0)).alias("first_line"), (F.size("lines") > 0).alias("judgeable"))


def html_text_query(spark: SparkSession, folder: str) -> DataFrame:
    """(id, characters): length of descriptions without markup."""
    return ads(spark, folder, "description").select("id", F.length(html_text("description")).cast("long").alias("characters"))


def language_detect(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, code, hits, confidence): language by frequent words; empty code where it stays undetermined."""
    profiles = table(spark, folder, "common_words")
    return detect_language(table(spark, folder, "documents"), "doc_id", "text", profiles)


def name_words_query(spark: SparkSession, folder: str) -> DataFrame:
    """(id, words, guesses): significant words of company names and the slugs they suggest."""
    words = table(spark, folder, "companies").select("id", T.name_words(fold("name"), LEGAL_FORMS).alias("words"))
    return words.select("id", F.array_join("words", " ").alias("words"), F.array_join(T.slug_guesses("words"), " ").alias("guesses"))


QUERIES = {
    "clean_text": clean_text, "salary_numbers": salary_numbers, "identity_hash": identity_hash, "url_normalize": url_normalize, "website_kind": website_kind, "posted_day": posted_day,
    "display_text": display_text, "like_search": like_search, "html_lines": html_lines_query, "html_text": html_text_query, "language_detect": language_detect, "name_words": name_words_query,
}

_CLEAN = r"case when {0} is null or lower(trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))) in ('n/a', 'none', 'null', 'nan') then '' else trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g')) end"
_HOST = r"regexp_replace(lower(regexp_extract(website, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@\s]+)', 1)), '^www\.', '')"
ORACLES = {
    "clean_text": f"select id, {_CLEAN.format('name')} as name, {_CLEAN.format('website')} as website, {_CLEAN.format('sectors')} as sectors from companies",
    "salary_numbers": f"""{SQL} select id, try_cast(json_extract_string(data, '$.salary.min') as double) as low, try_cast(json_extract_string(data, '$.salary.max') as double) as high,
      upper({_CLEAN.format("json_extract_string(data, '$.salary.currency')")}) as currency, lower({_CLEAN.format("json_extract_string(data, '$.salary.period')")}) as period from ads""",
    "identity_hash": f"select id, sha256(lower({_CLEAN.format('name')}) || '|' || coalesce({_HOST}, ''))[1:20] as key from companies",
    "url_normalize": r"""
      with u as (select distinct source_url, lower(trim(source)) as source from observations),
      p as (select *, lower(regexp_extract(source_url, '^(https?)://', 1)) as scheme, lower(regexp_extract(source_url, '^https?://([^/?#]+)', 1)) as h,
        regexp_replace(regexp_extract(source_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as path,
        array_to_string(list_filter(string_split(regexp_extract(source_url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$')), '&') as q from u),
      d as (select *, array_to_string(string_split(regexp_replace(h, '^www\.', ''), '.')[-2:], '.') as domain from p)
      select source_url, source, scheme || '://' || h || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end as url, domain,
        regexp_replace(source_url, '[?#].*$', '') as outbound,
        case string_split(domain, '.')[1] when 'boardnova' then 'nova' when 'jobcrate' then 'crate' else source end as board from d""",
    "website_kind": f"""select case when h = '' then 'none' when array_to_string(string_split(h, '.')[-2:], '.') = 'profilehub.example' then 'shared' else 'company' end as kind, count(*) as companies
      from (select coalesce({_HOST}, '') as h from companies) group by 1""",
    "posted_day": SQL + r"""select id, case when regexp_matches(posted_at, '^\d{4}-\d{2}-\d{2}') then posted_at[1:10]
      when regexp_matches(posted_at, '^\d{2}/\d{2}/\d{4}') then posted_at[7:10] || '-' || posted_at[4:5] || '-' || posted_at[1:2] end as day from ads""",
    "display_text": SQL + rf"""select id, case when length(n) > 40 then rtrim(n[1:39]) || '…' else n end as note,
      case when id * 97 < 10000 then cast(id * 97 as varchar) else replace(format('{{:,}}', id * 97), ',', '.') end as shown,
      case when s is null then null when s >= 3600 then printf('%d h %02d min', s // 3600, s % 3600 // 60) when s >= 60 then printf('%d min %02d s', s // 60, s % 60) else printf('%d s', s) end as waited
      from (select id, {_CLEAN.format('note')} as n, greatest(0, cast(floor(epoch(undone_at)) - floor(epoch(created_at)) as bigint)) + case when undone_at is null then null else 0 end as s from events_log)""",
    "like_search": "select id from companies where lower(name || ' ' || coalesce(description, '') || ' ' || coalesce(sectors, '')) like '%energy%'",
    "language_detect": r"""
      with p as (select distinct lang, lower(word) as word from common_words), w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nl}\p{No}]+') as ws from documents),
      n as (select doc_id, len(ws) as n from w), h as (select doc_id, p.lang, count(*) as hits from (select doc_id, unnest(ws) as word from w) x join p using (word) group by 1, 2),
      r as (select *, sum(hits) over (partition by doc_id) as total, row_number() over (partition by doc_id order by hits desc, lang) as k, lead(hits) over (partition by doc_id order by hits desc, lang) as second from h),
      b as (select * from r where k = 1)
      select n.doc_id, case when n.n >= 20 and hits >= 5 and hits <> coalesce(second, 0) and hits / total >= 0.3 then lang else '' end as code,
        case when n.n >= 20 then coalesce(hits, 0) else 0 end as hits, case when n.n >= 20 then round(coalesce(hits / total, 0), 4) else 0.0 end as confidence
      from n left join b using (doc_id)""",
}
