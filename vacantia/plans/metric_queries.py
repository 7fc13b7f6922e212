"""Measures over the archive: summaries, partitions, lenses, samples, plans of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.functions.languages import detect_language
from vacantia.operators import decisions as D
from vacantia.operators import grounding as G
from vacantia.operators import lenses as L
from vacantia.operators import ranks as R
from vacantia.plans.archive import FLAT, SQL, ads, feedback
from vacantia.plans.upkeep_queries import _EMPTY
from vacantia.plans.text_queries import ORACLES as TEXTS
from vacantia.runtime import table

NONE = "Non determinato"


def metrics_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row: counts of ads by what is known of them, gathered in one pass."""
    a = ads(spark, folder, "description", "posted_at", "locations", "language", keep=("company_id", "content_hash", "first_seen", "last_seen"))
    text = T.clean("description")
    return a.agg(
        F.count("*").alias("ads"), F.countDistinct("company_id").alias("companies"), F.count_if(text != "").alias("with_text"), F.count_if(F.length(text) >= 600).alias("long_text"),
        F.count_if(F.col("posted_at").isNull()).alias("undated"), F.count_if(F.coalesce(F.size("locations"), F.lit(0)) <= 0).alias("nowhere"), F.count_if(F.col("language").isNull()).alias("unlabelled"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def distribution_remote(spark: SparkSession, folder: str) -> DataFrame:
    """(label, ads): ads by remote policy."""
    label = F.coalesce(F.nullif(F.lower(T.clean("remote_policy")), F.lit("")), F.lit(NONE))
    return ads(spark, folder, "remote_policy").groupBy(label.alias("label")).agg(F.count("*").alias("ads"))


def distributions_multi(spark: SparkSession, folder: str) -> DataFrame:
    """(label, ads): ads by the last word of each of their places; an ad counts once for each different label."""
    places = T.clean_list("locations")
    words = F.array_distinct(F.transform(places, lambda p: F.lower(F.regexp_extract(p, r"([A-Za-z]+)[^A-Za-z]*$", 1))))
    label = F.explode(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(NONE))))
    return ads(spark, folder, "locations").select("id", label.alias("label")).groupBy("label").agg(F.count("*").alias("ads"))


def _stage() -> F.Column:
    return D.decision_table([
        (F.col("content_hash").isNull(), "stale"), (F.coalesce("title", F.lit("")).rlike("(?i)junior|intern"), "rejected"), (T.clean("description") == "", "blocked"),
        (F.length("description") < 700, "short"), (F.coalesce(F.size("locations"), F.lit(0)) <= 0, "nowhere"), (F.col("language").isNull(), "unlabelled")], "ready")


def funnel_partition(spark: SparkSession, folder: str) -> DataFrame:
    """(stage, ads): every ad in exactly one stage, the first that holds."""
    a = ads(spark, folder, "title", "description", "locations", "language", keep=("content_hash",))
    return a.groupBy(_stage().alias("stage")).agg(F.count("*").alias("ads"))


def stage_cards(spark: SparkSession, folder: str) -> DataFrame:
    """(step, done, total, state): how far each step is."""
    a = ads(spark, folder, "description", "locations", keep=("content_hash",))
    n = a.agg(F.count("*").alias("total"), F.count_if(T.clean("description") != "").alias("descriptions"), F.count_if(F.col("content_hash").isNotNull()).alias("hashes"), F.count_if(F.coalesce(F.size("locations"), F.lit(0)) > 0).alias("places"), F.lit(0).cast("long").alias("cards"))
    long = n.select("total", F.explode(F.create_map(*[x for s in ("descriptions", "hashes", "places", "cards") for x in (F.lit(s), F.col(s))])).alias("step", "done"))
    state = F.when(F.col("total") == 0, "empty").when(F.col("done") == F.col("total"), "complete").when(F.col("done") == 0, "missing").otherwise("partial")
    return long.select("step", "done", "total", state.alias("state"))


def date_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_type, documents, oldest, newest): extent of each kind of document, nulls aside."""
    return table(spark, folder, "documents").groupBy("doc_type").agg(F.count("*").alias("documents"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def _lenses(spark: SparkSession, folder: str) -> list[DataFrame]:
    """(id, lens, facet) of the twelve lenses, one pass over each table; no payload is shuffled."""
    text, label, source = T.clean("description"), F.lower(T.clean("language")), F.col("source")
    marks = L.marked({
        "missing_text": (text == "", source), "short_text": ((text != "") & (F.length(text) < 300), source), "unlabelled": ((label == "") | label.isin("und", "unknown", "??"), source),
        "by_label": (label != "", label), "undated": (F.col("posted_at").isNull(), source), "nowhere": (F.coalesce(F.size("locations"), F.lit(0)) <= 0, source),
        "markup": (F.col("description").contains("<"), source), "long_title": (F.length("title") > 40, source)})
    a = ads(spark, folder, "description", "source", "language", "posted_at", "title", "locations", keep=(), derived={"marks": marks})
    status = F.col("status")
    f = feedback(spark, folder).select("id", L.marked({
        "decided": (F.col("undone_at").isNull(), status), "undone": (F.col("undone_at").isNotNull(), status), "reasonless": ((status == "discarded") & F.col("reason").isNull(), F.lit(""))}).alias("marks"))
    c = table(spark, folder, "companies").select("id", L.marked({"no_site": (T.host("website") == "", F.lower(T.clean("sectors")))}).alias("marks"))
    return [df.select(F.col("id").cast("string").alias("id"), F.explode("marks").alias("m")).select("id", "m.lens", "m.facet") for df in (a, f, c)]


def lens_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(lens, facet, n) of all twelve lenses, with totals."""
    return L.tally(_lenses(spark, folder))


def lens_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of ads with markup in their text."""
    return L.page({"markup": lambda: _lenses(spark, folder)[0].where("lens = 'markup'").select("id", "facet")}, "markup", limit=25, offset=25)


def verdict_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """(l_returnflag, verdict, n): an ordered table of thresholds over four scores in [0, 1]."""
    s = _scores(spark, folder)
    return s.groupBy("l_returnflag", _verdict(0.75, 0.6).alias("verdict")).agg(F.count("*").alias("n"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12.5).alias("c"))


def _verdict(high: float, middle: float) -> F.Column:
    return D.decision_table([
        (F.col("c") >= high, "exclude"), ((F.col("b") >= middle) & (F.col("a") >= middle), "review"), ((F.col("b") >= middle) & (F.col("a") <= 0.2), "exclude"),
        (F.col("b") < 0.05, "review"), (F.col("a") >= high, "keep"), (F.col("a") <= 0.2, "exclude")], "review")


def rekey_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """(before, after, n): saved scores under a changed table of thresholds."""
    s = _scores(spark, folder)
    return s.groupBy(_verdict(0.75, 0.6).alias("before"), _verdict(0.6, 0.7).alias("after")).agg(F.count("*").alias("n"))


def sector_choice(spark: SparkSession, folder: str) -> DataFrame:
    """(c_custkey, labels): one or two labels from each customer's shares of priorities."""
    o = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    total = o.groupBy("o_custkey").agg(F.sum("n").alias("t"))
    s = o.join(total, "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct((F.col("n") / F.col("t")).alias("score"), F.col("o_orderpriority").alias("name"))).alias("s"))
    return s.select("c_custkey", F.array_join(D.choose(F.col("s"), 0.2, 0.35, 0.6), "+").alias("labels"))


SECTORS = {"Energy": ["energy", "solar", "clean"], "Water": ["water"], "Mobility": ["mobility", "transport"], "Automation": ["automation", "robot"], "Food": ["food"], "Software": ["software", "data"]}


def keyword_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, outcome, labels): sectors by terms, from the sectors field, else the name; one label assigns, several conflict."""
    c = table(spark, folder, "companies").select("id", F.lower(T.clean("sectors")).alias("s"), F.lower(T.clean("name")).alias("n"))
    found = lambda t: F.array_compact(F.array(*[F.when(reduce(lambda x, y: x | y, [t.contains(w) for w in ws]), F.lit(k)) for k, ws in SECTORS.items()]))
    both = c.select("id", found(F.col("s")).alias("a"), found(F.col("n")).alias("b"))
    labels = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))
    outcome = F.when(F.size(labels) == 1, "assigned").when(F.size(labels) > 1, "conflict").otherwise("insufficient")
    return both.select("id", outcome.alias("outcome"), F.array_join(labels, "+").alias("labels"))


PATTERNS = {"engineer": "engineer|ingegner|ingenieur|techniker|technician|tecnico", "analyst": "analyst|analista|analyste|analist", "planner": "planner|planificad|pianificator|planer|planificateur", "support": "support|assistenza|betreuer|soporte|conseiller"}


def question_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(key, companies, ads): undecided ads by the patterns their titles match; an ad may be in several groups."""
    a = ads(spark, folder, "title").select("id", "company_id", F.explode(D.rule_flags(F.coalesce("title", F.lit("")), PATTERNS)).alias("key"))
    return a.groupBy("key").agg(F.countDistinct("company_id").alias("companies"), F.count("*").alias("ads"))


def grounded_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, grounded): whether the first sentence of a card stands word for word in a description of its ad."""
    cards = table(spark, folder, "documents").where("doc_type in ('card_summary', 'evidence') and opportunity_id is not null and text is not null")
    quote = F.regexp_extract("text", r"^\s*([^.!?]*[.!?])", 1)
    joined = cards.select("doc_id", quote.alias("q"), F.col("opportunity_id").alias("id")).join(ads(spark, folder, "description"), "id", "left")
    return joined.groupBy("doc_id").agg(F.bool_or(G.verbatim(F.col("q"), F.col("description"))).alias("grounded"))


def queue_plan(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, n, characters): texts planned, too long or without content, in an order given by a hash of their id."""
    d = table(spark, folder, "documents").select("doc_id", F.length(T.clean("text")).alias("size"))
    kind = F.when(F.col("size") == 0, "empty").when(F.col("size") > 4000, "oversized").otherwise("planned")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("characters"))


def queue_order(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, place): the first hundred texts of the queue, in an order that looks random and never changes."""
    d = table(spark, folder, "documents").where("n_chars between 1 and 4000").select("doc_id")
    key = F.sha2(F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"')), 256)
    first = d.withColumn("k", key).orderBy("k", "doc_id").limit(100)
    return first.select("doc_id", F.row_number().over(Window.orderBy("k", "doc_id")).alias("place"))


def budget_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(company_id, texts, characters): up to three texts of a company that still fit in a budget, in order of id."""
    d = table(spark, folder, "documents").where("company_id is not null and n_chars > 0").select("company_id", "doc_id", F.length("text").cast("long").alias("size"))
    kept = R.within_budget(d, "company_id", "doc_id", "size", 2400, 3)
    return kept.groupBy("company_id").agg(F.count("*").alias("texts"), F.sum("size").alias("characters"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc_type, position, split): forty documents, one of each kind in turn, every fifth held out."""
    d = table(spark, folder, "documents").where("n_chars > 0").select("doc_id", "doc_type")
    return R.round_robin(d, "doc_type", "doc_id", "20260908", 40).select("doc_id", "doc_type", "position", "split")


def audit_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(l_returnflag, item, kind): of each flag, items of all lines nearest the limit and others at random."""
    li = table(spark, folder, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), "l_quantity")
    return R.audit_sample(li, "l_returnflag", F.abs(F.col("l_quantity") - 37.5), "item", "audit", 15).select("l_returnflag", "item", "kind")


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(expected, predicted, n): labels of documents against the frequent-word rule; unlabelled ones are pending."""
    d = table(spark, folder, "documents")
    found = detect_language(d, "doc_id", "text", table(spark, folder, "common_words")).select("doc_id", F.col("code").alias("predicted"))
    return d.select("doc_id", F.coalesce(F.lower("lang"), F.lit("pending")).alias("expected")).join(found, "doc_id").groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def nearest_rank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """(event_type, n, p50, p95): percentiles that are values of the data."""
    return R.nearest_rank(table(spark, folder, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def breaker_first_stop(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, calls, failures, why): where a run of failing calls should have been stopped."""
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"), "value")
    return R.first_stop(e, "user_id", ["ts", "event_id"], "failed", F.col("value") > 490, 3, 8, 0.4)


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(event_type, runs, users, total): sums by outcome."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def worst_status(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, status): the gravest outcome of each user's day, by a fixed order of gravity."""
    grave = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])
    e = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.array_position(grave, F.col("event_type"))).alias("g"))
    return e.groupBy("user_id", F.get(grave, (F.col("g") - 1).cast("int")).alias("status")).agg(F.count("*").alias("days"))


def latest_success(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, event_id, fresh): the last purchase of each user, and whether it is at most a day before the last event."""
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    last = R.latest(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", "event_id", (F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr("interval 1 day")).alias("fresh"))


def json_payload_facets(spark: SparkSession, folder: str) -> DataFrame:
    """(event_type, k, n): values inside a JSON payload."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_type, outcome, n): texts by what came of reading them."""
    d = table(spark, folder, "documents")
    outcome = F.when(F.col("text").isNull(), "missing").when(T.clean("text") == "", "blank").when(F.length("text") < 80, "stub").otherwise("available")
    return d.groupBy("doc_type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def retry_queue(spark: SparkSession, folder: str) -> DataFrame:
    """(id): standing decisions whose date to come back has passed by the log's last day; without a date they wait."""
    f = feedback(spark, folder)
    end = f.agg(F.date_format(F.max("created_at"), "yyyy-MM-dd")).scalar()
    return f.where("undone_at is null").where(F.col("until_date") <= end).select("id")


def staleness(spark: SparkSession, folder: str) -> DataFrame:
    """(id, stale): ads not seen for two weeks before the archive's last sight; never seen is stale."""
    a = ads(spark, folder, keep=("last_seen",))
    return a.select("id", F.coalesce(F.datediff(a.agg(F.max("last_seen")).scalar(), "last_seen") >= 14, F.lit(True)).alias("stale"))


def population_freeze(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, members, digest): a session's population in 64 batches by id, with an order-free digest of each."""
    a = ads(spark, folder, "description").where(T.clean("description") != "").select("id", (F.conv(F.substring("id", 1, 4), 16, 10).cast("long") % 64).alias("batch"))
    return a.groupBy("batch").agg(F.count("*").alias("members"), F.bit_xor(F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("long")).alias("digest"))


def answer_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, complete, missing, foreign): orders as batches asked for their parts, returned items as answers."""
    li = table(spark, folder, "lineitem")
    asked = li.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("id")).distinct()
    said = li.where("l_linestatus = 'F' or l_quantity > 25").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") < 0.09).alias("valid"))
    return G.batches(asked, said)


def category_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """(n_name, c_mktsegment, customers): coverage of labels by group, in one pass over a join with a small table."""
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("customers"))


#: Reasons that rules may give at present.
ACTIVE = ("location", "sector", "seniority", "other")


def subset_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind): decisions on ads that aren't of the company they name, or don't exist, and decisions for a reason that isn't active."""
    f = feedback(spark, folder).select("id", "company_id", "opportunity_id", "reason")
    own = ads(spark, folder).select(F.col("id").alias("opportunity_id"), "company_id")
    foreign = f.where("opportunity_id is not null").join(own, ["opportunity_id", "company_id"], "left_anti").select("id", F.lit("ad").alias("kind"))
    return foreign.unionByName(f.where(~F.col("reason").isin(*ACTIVE)).select("id", F.lit("reason").alias("kind")))


QUERIES = {f.__name__: f for f in (
    metrics_summary, distribution_remote, distributions_multi, funnel_partition, stage_cards, date_ranges, lens_counts, lens_rows, verdict_thresholds, rekey_transitions, sector_choice, keyword_sectors,
    question_groups, grounded_quotes, queue_plan, queue_order, budget_texts, stratified_sample, audit_sample, confusion_matrix, nearest_rank_percentiles, breaker_first_stop, run_totals, worst_status,
    latest_success, json_payload_facets, attempt_outcomes, retry_queue, staleness, population_freeze, answer_batches, category_coverage, subset_violations)}

_C = lambda c: f"case when {c} is null or lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) in ('n/a', 'none', 'null', 'nan') then '' else trim(regexp_replace({c}, '\\s+', ' ', 'g')) end"
_NOWHERE = "coalesce(len(locations), 0) = 0"
_VERDICT = """case when c >= {0} then 'exclude' when b >= {1} and a >= {1} then 'review' when b >= {1} and a <= 0.2 then 'exclude' when b < 0.05 then 'review' when a >= {0} then 'keep' when a <= 0.2 then 'exclude' else 'review' end"""
_SCORED = "(select *, l_quantity / 50 as a, l_discount * 10 as b, l_tax * 12.5 as c from lineitem)"
_LENS = f"""l as (
  select 'missing_text' as lens, source as facet from ads where {_EMPTY} union all select 'short_text', source from ads where not {_EMPTY} and length({_C('description')}) < 300
  union all select 'unlabelled', source from ads where lower({_C('language')}) in ('', 'und', 'unknown', '??') union all select 'by_label', lower({_C('language')}) from ads where {_C('language')} <> ''
  union all select 'undated', source from ads where posted_at is null union all select 'nowhere', source from ads where {_NOWHERE} union all select 'markup', source from ads where description like '%<%'
  union all select 'long_title', source from ads where length(title) > 40 union all select 'decided', status from events_log where undone_at is null union all select 'undone', status from events_log where undone_at is not null
  union all select 'reasonless', '' from events_log where status = 'discarded' and reason is null
  union all select 'no_site', lower({_C('sectors')}) from companies where not regexp_matches(coalesce(website, ''), '^(?i:https?)://[^/?#]'))"""
ORACLES = {
    "metrics_summary": f"""{SQL} select count(*) as ads, count(distinct company_id) as companies, count(*) filter (not {_EMPTY}) as with_text, count(*) filter (length({_C('description')}) >= 600) as long_text,
      count(*) filter (posted_at is null) as undated, count(*) filter ({_NOWHERE}) as nowhere, count(*) filter (language is null) as unlabelled, min(first_seen) as first_seen, max(last_seen) as last_seen from ads""",
    "distribution_remote": f"{SQL} select coalesce(nullif(lower({_C('remote_policy')}), ''), '{NONE}') as label, count(*) as ads from ads group by 1",
    "distributions_multi": f"""{SQL}, w as (select id, list_distinct(list_transform(list_filter(list_transform(locations, lambda x: {_C('x')}), lambda x: x <> ''), lambda x: lower(regexp_extract(x, '([A-Za-z]+)[^A-Za-z]*$', 1)))) as ws from ads)
      select label, count(*) as ads from (select id, unnest(case when len(ws) > 0 then ws else ['{NONE}'] end) as label from w) group by 1""",
    "funnel_partition": f"""{SQL} select case when content_hash is null then 'stale' when regexp_matches(coalesce(title, ''), '(?i)junior|intern') then 'rejected' when {_EMPTY} then 'blocked' when length(description) < 700 then 'short'
      when {_NOWHERE} then 'nowhere' when language is null then 'unlabelled' else 'ready' end as stage, count(*) as ads from ads group by 1""",
    "stage_cards": f"""{SQL}, n as (select count(*) as total, count(*) filter (not {_EMPTY}) as a, count(content_hash) as b, count(*) filter (not {_NOWHERE}) as c from ads),
      s as (select 'descriptions' as step, a as done, total from n union all select 'hashes', b, total from n union all select 'places', c, total from n union all select 'cards', 0, total from n)
      select step, done, total, case when total = 0 then 'empty' when done = total then 'complete' when done = 0 then 'missing' else 'partial' end as state from s""",
    "date_ranges": "select doc_type, count(*) as documents, min(created_at) as oldest, max(created_at) as newest from documents group by 1",
    "lens_counts": f"{SQL}, {_LENS} select lens, coalesce(facet, '') as facet, count(*) as n from l group by 1, 2 union all select lens, null, count(*) from l group by 1",
    "lens_rows": f"{SQL} select id, source as facet from ads where description like '%<%' order by id limit 25 offset 25",
    "verdict_thresholds": f"select l_returnflag, {_VERDICT.format(0.75, 0.6)} as verdict, count(*) as n from {_SCORED} group by 1, 2",
    "rekey_transitions": f"select {_VERDICT.format(0.75, 0.6)} as before, {_VERDICT.format(0.6, 0.7)} as after, count(*) as n from {_SCORED} group by 1, 2",
    "sector_choice": """with s as (select o_custkey, o_orderpriority as name, count(*) / sum(count(*)) over (partition by o_custkey) as score from orders group by 1, 2),
      r as (select o_custkey, list(name order by score desc, name) filter (score >= 0.2) as ns, list(score order by score desc, name) filter (score >= 0.2) as ss from s group by 1)
      select o_custkey as c_custkey, case when len(ss) >= 2 and ss[1] + ss[2] >= 0.6 then ns[1] || '+' || ns[2] when ss[1] >= 0.35 then ns[1] else '' end as labels from r""",
    "keyword_sectors": "with c as (select id, lower(" + _C("sectors") + ") as s, lower(" + _C("name") + ") as n from companies), f as (select id, " + ", ".join(
        "array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains({t}, '{w}')" for w in ws) + f" then '{k}' end" for k, ws in SECTORS.items()) + f"], lambda x: x is not null), '+') as {o}" for t, o in (("s", "a"), ("n", "b"))) +
        " from c), g as (select id, case when a <> '' then a else b end as labels from f) select id, case when labels = '' then 'insufficient' when contains(labels, '+') then 'conflict' else 'assigned' end as outcome, labels from g",
    "question_groups": f"{SQL}, h as (" + " union all ".join(f"select '{k}' as key, id, company_id from ads where regexp_matches(coalesce(title, ''), '(?i){p}')" for k, p in PATTERNS.items()) + ") select key, count(distinct company_id) as companies, count(*) as ads from h group by 1",
    "grounded_quotes": f"""{SQL}, q as (select doc_id, opportunity_id, trim(regexp_replace(regexp_extract(text, '^\\s*([^.!?]*[.!?])', 1), '\\s+', ' ', 'g')) as q from documents where doc_type in ('card_summary', 'evidence') and opportunity_id is not null and text is not null)
      select doc_id, bool_or(q <> '' and contains(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')), q)) as grounded from q left join ads on ads.id = q.opportunity_id group by 1""",
    "queue_order": """with d as (select doc_id, sha256('"' || doc_id || '"') as k from documents where n_chars between 1 and 4000) select doc_id, row_number() over (order by k, doc_id) as place from d order by k, doc_id limit 100""",
    "budget_texts": """with recursive d as (select company_id, length(text) as n, row_number() over (partition by company_id order by doc_id) as i from documents where company_id is not null and n_chars > 0),
      s as (select company_id, 0 as i, 0::bigint as texts, 0::bigint as characters from d group by 1
        union all select s.company_id, d.i, case when s.texts < 3 and s.characters + d.n <= 2400 then s.texts + 1 else s.texts end, case when s.texts < 3 and s.characters + d.n <= 2400 then s.characters + d.n else s.characters end
          from s join d on d.company_id = s.company_id and d.i = s.i + 1)
      select company_id, texts, characters from s where i = (select max(i) from d where d.company_id = s.company_id) and texts > 0""",
    "stratified_sample": """with s as (select doc_id, doc_type, sha256('20260908:' || doc_id) as h from documents where n_chars > 0), r as (select *, row_number() over (partition by doc_type order by h, doc_id) as turn from s),
      c as (select doc_id, doc_type, row_number() over (order by turn, doc_type) - 1 as position from r) select *, case when position % 5 = 4 then 'holdout' else 'development' end as split from c where position < 40""",
    "audit_sample": """with i as (select l_returnflag, l_quantity, l_orderkey || '-' || l_linenumber as item from lineitem), n as (select *, row_number() over (partition by l_returnflag order by abs(l_quantity - 37.5), item) as k, sha256('audit:' || item) as h from i),
      m as (select *, case when k <= 8 then 'boundary' else 'random' end as kind from n), o as (select *, row_number() over (partition by l_returnflag, kind order by h, item) as p from m)
      select l_returnflag, item, kind from o where p <= case when kind = 'boundary' then 8 else 7 end""",
    "nearest_rank_percentiles": """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
      select event_type, max(n) as n, max(value) filter (i = least(floor(n * 0.5), n - 1)) as p50, max(value) filter (i = least(floor(n * 0.95), n - 1)) as p95 from r group by 1""",
    "breaker_first_stop": """with e as (select *, event_type = 'error' as failed, row_number() over w as c, sum((event_type = 'error')::int) over w as f, sum((event_type <> 'error')::int) over w as i from events window w as (partition by user_id order by ts, event_id)),
      s as (select *, sum(failed::int) over (partition by user_id, i order by ts, event_id) as s from e),
      y as (select user_id, c as calls, f as failures, case when not failed then null when value > 490 then 'refused' when s >= 3 then 'streak' when c >= 8 and f > c * 0.4 then 'share' end as why from s)
      select user_id, calls, failures, why from (select *, row_number() over (partition by user_id order by calls) as k from y where why is not null) where k = 1""",
    "run_totals": "select event_type, count(*) as runs, count(distinct user_id) as users, round(sum(value), 2) as total from events group by 1",
    "worst_status": """select user_id, ['view', 'click', 'purchase', 'signup', 'error'][g] as status, count(*) as days from (select user_id, cast(ts as date) as day, max(list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type)) as g from events group by 1, 2) group by 1, 2""",
    "latest_success": "select user_id, event_id, ts >= (select max(ts) from events) - interval 1 day as fresh from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'purchase') where k = 1",
    "json_payload_facets": "select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2",
    "retry_queue": f"{SQL} select id from events_log where undone_at is null and until_date <= (select strftime(max(created_at), '%Y-%m-%d') from events_log)",
    "staleness": f"{SQL} select id, coalesce(date_diff('day', cast(last_seen as date), cast((select max(last_seen) from ads) as date)) >= 14, true) as stale from ads",
    "answer_batches": """with a as (select distinct l_orderkey as batch, l_partkey as id, 1 as a from lineitem where l_returnflag <> 'N'), b as (select distinct l_orderkey as batch, l_partkey as id, 1 as b from lineitem where (l_linestatus = 'F' or l_quantity > 25) and l_discount < 0.09)
      select batch, count(*) filter (b is null) = 0 and count(*) filter (a is null) = 0 as complete, count(*) filter (b is null) as missing, count(*) filter (a is null) as foreign from a full join b using (batch, id) group by 1""".replace(" as foreign", ' as "foreign"'),
    "category_coverage": "select n_name, c_mktsegment, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1, 2",
    "subset_violations": f"""{SQL} select e.id, 'ad' as kind from events_log e where opportunity_id is not null and not exists (select 1 from ads a where a.id = e.opportunity_id and a.company_id = e.company_id)
      union all select id, 'reason' from events_log where reason not in {ACTIVE}""",
    "population_freeze": f"{SQL} select cast('0x' || id[1:4] as bigint) % 64 as batch, count(*) as members, bit_xor(cast('0x' || md5(id)[1:15] as bigint)) as digest from ads where {FLAT.format('description')} <> '' group by 1",
    "queue_plan": f"""select case when size = 0 then 'empty' when size > 4000 then 'oversized' else 'planned' end as kind, count(*) as n, cast(sum(size) as bigint) as characters from (select length({FLAT.format('text')}) as size from documents) group by 1""",
    "attempt_outcomes": f"""select doc_type, case when text is null then 'missing' when {FLAT.format('text')} = '' then 'blank' when length(text) < 80 then 'stub' else 'available' end as outcome, count(*) as n from documents group by 1, 2""",
    "confusion_matrix": f"select coalesce(lower(d.lang), 'pending') as expected, f.code as predicted, count(*) as n from documents d join ({TEXTS['language_detect']}) f on f.doc_id = d.doc_id group by 1, 2",
}
