"""Work on the archive between runs: queues, populations, plans of cards, deliveries due, texts read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.ranks import running_rank
from vacantia.operators.verdicts import DROP, KEEP, UNKNOWN


def answer_error(probability: Column, option: Column, allowed: Sequence[str], confidence: Column) -> Column:
    """What is wrong with a typed answer: a number outside [0, 1] or an option that was never offered; null if nothing is."""
    outside = lambda c: c.isNull() | F.isnan(c) | ~c.between(0.0, 1.0)
    return F.when(outside(probability), "probability").when(option.isNull() | ~option.isin(*allowed), "option").when(outside(confidence), "confidence")


def guarded_by_degree(verdict: Column, degree: Column, for_students: Column) -> Column:
    """A refusal because a place is for students doesn't decide where the ad asks for a doctorate."""
    return F.when((verdict == DROP) & degree & for_students, UNKNOWN).otherwise(verdict)


def added(held: DataFrame, new: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """The rows of `new` that an append takes: those whose identity `held` lacks, the first of each by `order`.

    Appending twice adds nothing. Null parts of an identity are equal to each other.
    """
    first = new.groupBy(*identity).agg(F.min(F.struct(order, *[c for c in new.columns if c not in (*identity, order)])).alias("_r"))
    rows = first.select(*identity, "_r.*").alias("n")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}"))
    return rows.join(held.select(*identity).alias("h"), same, "left_anti").select(*new.columns)


def work_queue(requests: Sequence[tuple[str, DataFrame]], most: int) -> DataFrame:
    """(kind, id, size, outcome, ticket): requests (id, size) of several kinds in one queue; `ticket` orders it in a way that looks random and never changes.

    A request without content (null or no size) is empty, one over `most` oversized, the others are planned.
    """
    queue = None
    for kind, df in requests:
        part = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        queue = part if queue is None else queue.unionByName(part)
    outcome = F.when(F.col("size") == 0, "empty").when(F.col("size") > most, "oversized").otherwise("planned")
    return queue.select("*", outcome.alias("outcome"), F.sha2(F.concat_ws(":", "kind", "id"), 256).alias("ticket"))


def card_plan(tiers: DataFrame, roles: DataFrame, readable: DataFrame, facts: DataFrame) -> DataFrame:
    """(company_id, id, kind): the cards to be written.

    `role` cards for open kept ads with readable text (id) of companies of tiers A and B-esperienza; a `company` card
    (null id) for companies of tiers A and B- that have facts (company_id).
    """
    chosen = tiers.where(F.col("tier").isin("A", "B-esperienza")).select(F.col("id").alias("company_id"))
    role = roles.where((F.col("verdict") == KEEP) & ~F.col("closed")).join(chosen, "company_id", "left_semi").join(readable.select("id"), "id", "left_semi")
    company = tiers.where((F.col("tier") == "A") | F.col("tier").startswith("B-")).select(F.col("id").alias("company_id")).join(facts.select("company_id"), "company_id", "left_semi")
    return role.select("company_id", "id", F.lit("role").alias("kind")).unionByName(company.select("company_id", F.lit(None).cast("string").alias("id"), F.lit("company").alias("kind")))


def provenance(texts: DataFrame, owner: str, text: str, source: str, key: str) -> DataFrame:
    """(owner, digest, source, key, copies): the different texts of each owner, blanks aside, each with the least source and key it comes from."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = texts.where(F.col(owner).isNotNull() & F.col(text).isNotNull()).select(owner, F.md5(flat).alias("digest"), (flat == "").alias("blank"), source, key).where("not blank")
    return rows.groupBy(owner, "digest").agg(F.min(F.struct(source, key)).alias("f"), F.count("*").alias("copies")).select(owner, "digest", f"f.{source}", f"f.{key}", "copies")


def frozen(population: DataFrame, key: str, size: int) -> DataFrame:
    """(key, place, batch): a population fixed in the order of its keys, in batches of `size`; a cursor is the number of the next batch.

    Places are counted over range partitions, so no task sees the whole population.
    """
    rows = running_rank(population.select(key).distinct().withColumn("_one", F.lit(1)), ["_one"], [key])
    return rows.select(key, F.col("rank").alias("place"), F.floor(F.col("rank") / size).cast("long").alias("batch"))


def populations(roles: DataFrame, tiers: DataFrame, decided: DataFrame) -> DataFrame:
    """(population, id): `undecided` open ads no judge settles, `to_apply` open kept ads of tier A without a decision (id), `selection` all open kept ads."""
    first = tiers.where(F.col("tier") == "A").select(F.col("id").alias("company_id"))
    rows = roles.where(~F.col("closed")).join(decided.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left")
    rows = rows.join(first.distinct().withColumn("_a", F.lit(True)), "company_id", "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    keep = F.col("verdict") == KEEP
    names = F.array_compact(F.array(
        F.when((F.col("verdict") == UNKNOWN) & ~F.col("_d"), "undecided"), F.when(keep & F.coalesce("_a", F.lit(False)) & ~F.col("_d"), "to_apply"), F.when(keep, "selection")))
    return rows.select(F.explode(names).alias("population"), "id")


def due(runs: DataFrame, sources: DataFrame, now: Column, hours: int) -> DataFrame:
    """(source, last, due): whether a source (source, fingerprint) is to be read: it has no successful run with the same fingerprint in the last `hours`.

    `runs` has (source, fingerprint, at, ok).
    """
    last = runs.where("ok").groupBy("source", "fingerprint").agg(F.max("at").alias("last"))
    return sources.join(last, ["source", "fingerprint"], "left").select("source", "last", (F.col("last").isNull() | (F.col("last") < now - F.make_interval(hours=F.lit(hours)))).alias("due"))


def reread(before: Column, after: Column) -> Column:
    """What reading a page again means for its text: `same`, `respaced` (to be replaced, as only blanks differ), `found`, `lost`, `differs` or `none`."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return (
        F.when((bare(before) == "") & (bare(after) == ""), "none").when(bare(before) == "", "found").when(bare(after) == "", "lost")
        .when(before == after, "same").when(bare(before) == bare(after), "respaced").otherwise("differs"))


def shortlist(tiers: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """(id, tier, keeps): a page of at most 100 companies, tiers in the order given, then those with most kept ads."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tier"))
    rows = tiers.withColumn("_p", place).where("_p > 0")
    return rows.orderBy("_p", F.desc("keeps"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 100)).select("id", "tier", "keeps")


def version(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """(name, rows, version): an order-free digest of a table that changes with any of its rows, as a key for what is computed from it."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.lpad(F.lower(F.hex(F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")))), 16, "0")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.concat(part(0), part(1)).alias("version"))
