"""Queries that keep the archive current, read places, and measure its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.functions.fold import STROKES, fold
from vacantia.functions.html import html_lines
from vacantia.functions.places import ANYWHERE, alias_table, resolve
from vacantia.operators import upkeep as U
from vacantia.operators.evidence import employer_sentences as told_by
from vacantia.operators.ranks import examples, latest, running_rank
from vacantia.plans.archive import FLAT, SQL, ads, feedback
from vacantia.plans.company_queries import _DAY
from vacantia.runtime import table

WEEKS = 24 * 21


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observations").select(F.col("opportunity_id").alias("id"), F.lower(F.trim("source")).alias("source"), "source_url", F.col("observed_at").alias("at"), "delivered_at")


def _closures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    seen = _seen(spark, folder)
    day = ads(spark, folder, "posted_at").select("id", "company_id", T.day("posted_at").alias("day"))
    closed = feedback(spark, folder).where("status = 'discarded' and undone_at is null and opportunity_id is not null").select(F.col("opportunity_id").alias("id")).distinct()
    start = seen.agg(F.max("delivered_at") - F.expr("interval 7 days")).scalar()
    hours = F.when(F.col("source").startswith("ats"), F.lit(None).cast("int")).otherwise(F.lit(WEEKS))
    sources = seen.select("source").distinct().withColumn("hours", hours).withColumn("started", start)
    return U.closures(seen, day, closed, sources, 0.5)


def closure_detect(spark: SparkSession, folder: str) -> DataFrame:
    """(source, id): ads a complete sweep didn't find again."""
    return _closures(spark, folder)[0]


def closure_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, population, gone, skipped): the guard against truncated sweeps."""
    return _closures(spark, folder)[1]


def observation_fold(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, url, seen_at): last sight of each ad at each address."""
    return U.fold_observations(_seen(spark, folder).select("id", "source", T.canonical_url("source_url").alias("url"), "at")).withColumnRenamed("at", "seen_at")


def ingest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """(id, first_seen, last_seen, source, characters): deliveries folded into one payload for each ad."""
    text = ads(spark, folder, "description").select("id", F.col("description").alias("text"))
    sent = _seen(spark, folder).select("id", "source", "at").join(text, "id")
    return U.fold_payloads(sent).select("id", "first_seen", "last_seen", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("characters"))


def company_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """(id, company): the conservative identity of each company row."""
    return U.company_identity(table(spark, folder, "companies").select("id", "name", "website"), "name", "website").select("id", "company")


def ingest_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """(id, company_name, title, source_url, remote_policy, reason): payloads as rows of a delivery, refused where incomplete."""
    row = F.from_json("data", "map<string,string>")
    a = ads(spark, folder, keep=("company_id", "data"))
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), "name")
    raw = a.join(c, "company_id", "left").select("id", F.map_concat(row, F.map_from_arrays(F.array(F.lit("company")), F.array("name"))).alias("row"))
    return U.normalized(raw, "archive").select("id", "company_name", "title", "source_url", "remote_policy", "reason")


def _cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    inputs = ads(spark, folder, "description", keep=("content_hash",)).withColumn("content_hash", F.lower("content_hash"))
    held = table(spark, folder, "observations").select(F.col("opportunity_id").alias("id"), "snapshot_no", F.lower("content_hash").alias("content_hash"))
    return inputs, latest(held, ["id"], ["snapshot_no"]).select("id", "content_hash")


def freshness_stale(spark: SparkSession, folder: str) -> DataFrame:
    """(id): ads whose content the last delivery knew differently, or not at all."""
    inputs, held = _cache(spark, folder)
    return U.stale(inputs, held, "id", ["content_hash"]).select("id")


def refresh_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content_hash, characters): a derived table after an incremental refresh; the SQL computes it anew."""
    inputs, held = _cache(spark, folder)
    compute = lambda df: df.select("id", "content_hash", F.coalesce(F.length("description"), F.lit(0)).cast("long").alias("characters"))
    return U.refresh(inputs, compute(inputs.join(held, ["id", "content_hash"], "left_semi")), "id", ["content_hash"], compute)


def resolved_places(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, opportunity_id, country, city, to_map): every place typed, resolved once for each distinct value."""
    aliases = alias_table(table(spark, folder, "geo_reference"), table(spark, folder, "city_reference"))
    places = table(spark, folder, "places").select("opportunity_id", "raw")
    return places.join(resolve(places, "raw", aliases), "raw")


def place_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, country, city, to_map) of every distinct place typed."""
    return resolved_places(spark, folder).select("raw", "country", "city", "to_map").distinct()


def place_options(spark: SparkSession, folder: str) -> DataFrame:
    """(country, total, cities): ads by city under their country as `city:ads`, most first; an ad in two cities of it counts twice in the total."""
    n = resolved_places(spark, folder).where("country is not null").groupBy("country", "city").agg(F.countDistinct("opportunity_id").alias("n"))
    return n.groupBy("country").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "city"))), lambda c: F.concat_ws(":", c["city"], -c["o"])), ",").alias("cities"))


def places_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    """(raw, ads): values that seem to name a city the list lacks."""
    return resolved_places(spark, folder).where("to_map").groupBy("raw").agg(F.countDistinct("opportunity_id").alias("ads"))


def place_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(opportunity_id, labels): the canonical places of each ad."""
    city = table(spark, folder, "city_reference").select(F.col("ref_id").alias("city"), F.concat_ws(", ", "name", "country").alias("label"))
    r = resolved_places(spark, folder).join(city, "city").groupBy("opportunity_id").agg(F.collect_set("label").alias("l"))
    return r.select("opportunity_id", F.array_join(F.array_sort("l"), "; ").alias("labels"))


def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    """(source, ads, with_text): how many ads each source shows, and how many of them have a description."""
    text = ads(spark, folder, "description").select("id", (T.clean("description") != "").alias("has"))
    seen = _seen(spark, folder).select("id", "source").distinct()
    return seen.join(text, "id").groupBy("source").agg(F.count("*").alias("ads"), F.count_if("has").alias("with_text"))


def dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, title, places, ads): ads of one company with the same title and places, case aside."""
    a = ads(spark, folder, "title", "locations")
    places = F.array_join(F.array_sort(F.transform(F.coalesce("locations", F.array().cast("array<string>")), F.lower)), "|")
    return a.groupBy("company_id", F.lower("title").alias("title"), places.alias("places")).agg(F.count("*").alias("ads")).where("ads > 1")


def dup_exact(spark: SparkSession, folder: str) -> DataFrame:
    """(id, copies): ads of one company with the same title, places and text of at least 200 characters once markup is gone."""
    a = ads(spark, folder, "title", "locations", "description").withColumn("t", fold(F.array_join(html_lines("description"), " "))).where("length(t) >= 200")
    key = F.sha2(F.to_json(F.struct(F.lower(F.trim("title")), "locations", "t")), 256)
    keyed = a.select("id", "company_id", key.alias("k"))
    n = keyed.groupBy("company_id", "k").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(n, ["company_id", "k"]).select("id", (F.col("n") - 1).alias("copies"))


def fair_queue(spark: SparkSession, folder: str) -> DataFrame:
    """(id, rank): ads without text in the order they are to be fetched, one of each company before a second of any."""
    a = ads(spark, folder, "description").where(T.clean("description") == "").select("id", "company_id")
    return running_rank(a, ["company_id"], ["id"]).select("id", "rank")


def excluded_companies(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id): companies whose standing decision excludes them, unless for a passing reason."""
    events = feedback(spark, folder).where("opportunity_id is null and undone_at is null").select("company_id", "id", "status", "reason")
    last = latest(events, ["company_id"], ["id"])
    return last.where(F.col("status").isin("discarded", "contacted") & ~F.coalesce("reason", F.lit("")).isin("not_now", "no_current_roles")).select("company_id")


def protected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id): ads a reset keeps, because a decision, a document or a card refers to them."""
    f = feedback(spark, folder).select(F.col("opportunity_id").alias("id"))
    d = table(spark, folder, "documents").where("doc_type = 'review_note'").select(F.col("opportunity_id").alias("id"))
    c = feedback(spark, folder).where("opportunity_id is null and status = 'saved'").select("company_id").distinct()
    own = ads(spark, folder).join(c, "company_id", "left_semi").select("id")
    return ads(spark, folder).select("id").join(f.union(d).union(own).distinct(), "id", "left_semi")


def reset_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id): ads a reset removes."""
    return ads(spark, folder).select("id").join(protected_rows(spark, folder), "id", "left_anti")


def wanted_written(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ads): texts wanted and written, wanted and missing."""
    wanted = ads(spark, folder, "description").where(T.clean("description") != "").select("id")
    written = table(spark, folder, "documents").where("doc_type = 'card_summary' and opportunity_id is not null").select(F.col("opportunity_id").alias("id"))
    one = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("ads"))
    return one("written", wanted.intersect(written)).union(one("missing", wanted.subtract(written)))


def title_examples(spark: SparkSession, folder: str) -> DataFrame:
    """(source, title, company_id): three example ads of each source, each of another company."""
    a = ads(spark, folder, "title", "source").where("source is not null").select("source", "company_id", "id", "title")
    return examples(a, ["source"], ["company_id"], ["id"], 3).select("source", "title", "company_id")


def employer_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, text, id): what companies say about themselves in their ads."""
    return told_by(ads(spark, folder, "description"), table(spark, folder, "companies"))


QUERIES = {f.__name__: f for f in (
    closure_detect, closure_shares, observation_fold, ingest_upsert, company_resolution, ingest_normalize, freshness_stale, refresh_equivalence, place_resolve, place_options, places_unmapped, place_labels,
    source_quality, dup_groups, dup_exact, fair_queue, excluded_companies, protected_rows, reset_rows, wanted_written, title_examples, employer_sentences)}

_SEEN = "seen as (select opportunity_id as id, lower(trim(source)) as source, source_url, observed_at as seen_at, delivered_at, snapshot_no, lower(content_hash) as content_hash from observations)"
_CLOSE = f"""{SQL}, {_SEEN}, st as (select max(delivered_at) - interval 7 day as started from seen), cl as (select distinct opportunity_id as id from events_log where status = 'discarded' and undone_at is null and opportunity_id is not null),
  m as (select s.source, a.id, l.last < st.started and (s.source like 'ats%' or coalesce({_DAY} >= strftime(st.started - interval {WEEKS} hour + interval 1 day, '%Y-%m-%d'), false)) as gone
    from (select distinct id, source from seen) s join ads a on a.id = s.id join (select id, max(seen_at) as last from seen group by 1) l on l.id = s.id cross join st where a.id not in (select id from cl)),
  t as (select source, count(*) as population, count(*) filter (gone) as gone, count(*) filter (gone) > 0.5 * count(*) as skipped from m group by 1)"""
_EMPTY = "coalesce(lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))), '') in ('', 'n/a', 'none', 'null', 'nan')"
_HELD = "held as (select id, content_hash from (select *, row_number() over (partition by id order by snapshot_no desc, content_hash desc nulls last) as k from seen) where k = 1)"
_PROTECTED = """p as (select opportunity_id as id from events_log union select opportunity_id from documents where doc_type = 'review_note'
  union select id from ads where company_id in (select company_id from events_log where opportunity_id is null and status = 'saved'))"""
#: Folding in SQL, enough for what the tables hold.
def _fold_sql(c: str) -> str:
    out = f"lower({c})"
    for letter, plain in {"ß": "ss", **STROKES}.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return f"strip_accents({out})"


_WORDS = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
PLACES_SQL = f"""with al0 as (select ref_id as country, null::int as city, false as alone, unnest(list_distinct([name] || coalesce(aliases, []))) as alias from geo_reference
  union all select g.ref_id, c.ref_id, null, unnest(list_distinct([c.name] || coalesce(c.aliases, []))) from city_reference c join geo_reference g on g.name = c.country),
al as (select distinct a.country, a.city, coalesce(alone, list_contains(c.standalone_aliases, alias), false) as alone, length(alias) <= 3 as short, array_to_string({_WORDS.format(_fold_sql('alias'))}, ' ') as words from al0 a left join city_reference c on c.ref_id = a.city),
v as (select raw, {_fold_sql('raw')} as f from (select distinct raw from places where raw is not null)),
cut as (select raw, {_WORDS.format('f')} as w, list_filter(list_transform(regexp_split_to_array(f, '[,;|/()\\[\\]]| - | · '), lambda s: array_to_string({_WORDS.format('s')}, ' ')), lambda s: s <> '') as s from v),
said as (select raw, array_to_string(w[i + 1 : i + n], ' ') as words, i as pos, false as segment from (select raw, w, i, unnest(range(1, len(w) - i + 1)) as n from (select raw, w, unnest(range(0, len(w))) as i from cut)) where n <= 12
  union all select raw, x, len(w) - coalesce(list_position(list_reverse(w), x), 0), true from (select raw, w, unnest(s) as x from cut)),
whole as (select raw, count(*) as n from said where segment group by 1),
hits as (select h.*, a.country, a.city, a.alone and segment and n = 1 as sole from said h join al a using (words) join whole using (raw) where segment = short and words <> ''),
found as (select raw, max(struct_pack(country := country, city := city)) filter (sole) as sole, struct_extract(max(struct_pack(pos := pos, country := country)) filter (city is null), 'country') as named, list(distinct words) filter (city is null) as country_words from hits group by 1),
best as (select h.raw, max(struct_pack(size := length(words), country := h.country, city := h.city, segment := segment)) as best from hits h join found f using (raw) where h.city is not null and ((named is null and not segment) or h.country = named) group by 1),
r0 as (select c.raw, coalesce(sole.country, named, best.country) as country, coalesce(sole.city, best.city) as city, string_split(coalesce(s[1], ''), ' ') as first, list_transform(coalesce(country_words, []), lambda x: string_split(x, ' ')) as used from cut c left join found using (raw) left join best using (raw)),
resolved as (select raw, country, city, city is null and len(list_filter(first, lambda x: x <> '' and not list_contains({list(ANYWHERE)}, x) and not list_contains(flatten(used), x))) > 0 as to_map from r0),
rp as (select p.opportunity_id, r.* from places p join resolved r using (raw))"""
ORACLES = {
    "place_resolve": f"{PLACES_SQL} select distinct raw, country, city, to_map from rp",
    "place_options": f"""{PLACES_SQL}, n as (select country, city, count(distinct opportunity_id) as n from rp where country is not null group by 1, 2)
      select country, cast(sum(n) as bigint) as total, string_agg(case when city is null then '' || n else city || ':' || n end, ',' order by n desc, city nulls first) as cities from n group by 1""",
    "places_unmapped": f"{PLACES_SQL} select raw, count(distinct opportunity_id) as ads from rp where to_map group by 1",
    "place_labels": f"""{PLACES_SQL} select opportunity_id, string_agg(label, '; ' order by label) as labels from (select distinct opportunity_id, c.name || ', ' || c.country as label from rp join city_reference c on c.ref_id = rp.city) group by 1""",
    "ingest_normalize": rf"""{SQL}, n as (select a.id, {FLAT.format('c.name')} as company_name, {FLAT.format('a.title')} as title, {FLAT.format('a.source_url')} as u, nullif({FLAT.format('a.remote_policy')}, '') as remote_policy from ads a left join companies c on c.id = a.company_id),
      p as (select *, regexp_full_match(u, '(?i)https?://[^/?#@\s]+(/[^?#\s]*)?(\?[^#\s]*)?(#.*)?') as good, lower(regexp_extract(u, '(?i)^(https?)://', 1)) as scheme, lower(regexp_extract(u, '(?i)^https?://([^/?#@\s]+)', 1)) as h,
        regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#@\s]+(/[^?#\s]*)', 1), '/+$', '') as path,
        array_to_string(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$')), '&') as q from n),
      o as (select id, company_name, title, case when good then scheme || '://' || h || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end else '' end as source_url, remote_policy from p)
      select *, case when company_name = '' or title = '' or source_url = '' then 'company_name, title and one http(s) address are required' end as reason from o""",
    "closure_detect": _CLOSE + " select m.source, m.id from m join t using (source) where m.gone and not t.skipped",
    "closure_shares": _CLOSE + " select * from t",
    "freshness_stale": f"{SQL}, {_SEEN}, {_HELD} select a.id from ads a left join held h on h.id = a.id where h.id is null or h.content_hash is distinct from lower(a.content_hash)",
    "refresh_equivalence": f"{SQL} select id, lower(content_hash) as content_hash, coalesce(length(description), 0) as characters from ads",
    "source_quality": f"{SQL}, {_SEEN} select s.source, count(*) as ads, count(*) filter (not {_EMPTY}) as with_text from (select distinct id, source from seen) s join ads a on a.id = s.id group by 1".replace("description", "a.description").replace("'$.a.description') as a.description", "'$.description') as description"),
    "dup_groups": f"{SQL} select company_id, lower(title) as title, array_to_string(list_sort(list_transform(locations, lambda x: lower(x))), '|') as places, count(*) as ads from ads group by 1, 2, 3 having count(*) > 1",
    "fair_queue": f"{SQL} select id, row_number() over (partition by company_id order by id) - 1 as rank from ads where {_EMPTY}",
    "excluded_companies": f"{SQL}, l as (select *, row_number() over (partition by company_id order by id desc) as k from events_log where opportunity_id is null and undone_at is null) select company_id from l where k = 1 and status in ('discarded', 'contacted') and coalesce(reason, '') not in ('not_now', 'no_current_roles')",
    "protected_rows": f"{SQL}, {_PROTECTED} select id from ads where id in (select id from p)",
    "reset_rows": f"{SQL}, {_PROTECTED} select id from ads where id not in (select id from p where id is not null)",
    "wanted_written": f"""{SQL}, w as (select id from ads where not {_EMPTY}), t as (select distinct opportunity_id as id from documents where doc_type = 'card_summary' and opportunity_id is not null)
      select 'written' as kind, count(*) as ads from (select id from w intersect select id from t) union all select 'missing', count(*) from (select id from w except select id from t)""",
    "title_examples": f"{SQL}, f as (select source, company_id, min(id) as id, min_by(title, id) as title from ads where source is not null group by 1, 2) select source, title, company_id from (select *, row_number() over (partition by source order by id, company_id) as k from f) where k <= 3",
    "observation_fold": f"""{_SEEN.replace('seen as', 'with seen as', 1)}, u as (select id, source, seen_at, lower(regexp_extract(source_url, '^https?://([^/?#]+)', 1)) as h, regexp_extract(source_url, '^(https?)', 1) as s, regexp_replace(regexp_extract(source_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as path,
      array_to_string(list_filter(string_split(regexp_extract(source_url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|fbclid|gclid)(=.*)?$')), '&') as q from seen)
      select id, source, s || '://' || h || case when path = '' then '/' else path end || case when q = '' then '' else '?' || q end as url, max(seen_at) as seen_at from u group by 1, 2, 3""",
    "ingest_upsert": f"{SQL}, {_SEEN} select a.id, min(seen_at) as first_seen, max(seen_at) as last_seen, (max((seen_at, s.source))).source as source, coalesce(max(length(a.description)), 0) as characters from seen s join ads a on a.id = s.id group by 1".replace("(max((seen_at, s.source))).source", "max(struct_pack(seen_at := seen_at, source := s.source)).source"),
    "company_resolution": r"""with k as (select id, lower(nfc_normalize(trim(regexp_replace(name, '[\s\p{Z}]+', ' ', 'g')))) as key, coalesce(regexp_replace(lower(regexp_extract(website, '^(?i:https?)://([^/?#:@\s]+)', 1)), '^www\.', ''), '') as h from companies),
      n as (select key, min(h) as a, max(h) as b from k where h <> '' group by 1)
      select id, sha256(k.key || '|' || case when a is null then '' when a = b then a else h end)[1:20] as company from k left join n on n.key = k.key""",
}
