"""Two verdicts and a tier: what judges say of each ad, what a company's labels say of it, and what follows. Nothing is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import decisions as D

#: Outcomes of judges, of the labels, and the tiers.
KEEP, DROP, UNKNOWN = "tieni", "scarta", "non_so"
WANTED, UNWANTED, NO_EVIDENCE = "interessante", "non_interessante", "evidenza_mancante"
TIERS = ("A", "B-attesa", "B-esperienza", "evidenza-mancante", "scarto")
UNLABELLED = "Da classificare"
#: How an ad's verdict reads as a state of eligibility.
ELIGIBILITY = {KEEP: "potential", UNKNOWN: "review", DROP: "excluded"}


def role_verdicts(ads: DataFrame, chain: Sequence[tuple[str, Column]], primary: Column, overrides: Sequence[tuple[str, DataFrame]], closed: DataFrame, phd: Column | None = None) -> DataFrame:
    """(id, company_id, verdict, judge, primary, closed, eligibility, phd) of each ad.

    `chain` are judges over columns of `ads`, strongest first: the first that decides stands. `overrides` are reviewers
    with their own tables (id, verdict), stronger than all judges, strongest first; what a reviewer keeps counts as
    primary. `closed` has the ids of closed ads. A judge that says null or UNKNOWN doesn't decide.
    """
    rows = ads
    said = []
    for judge, table in overrides:
        rows = rows.join(table.select("id", F.col("verdict").alias(f"_{judge}")), "id", "left")
        said.append(D.judgement(F.col(f"_{judge}"), judge))
    final = D.first_decided([*said, *[D.judgement(v, judge) for judge, v in chain]], [KEEP, DROP], UNKNOWN)
    rows = rows.join(closed.select("id").distinct().withColumn("_closed", F.lit(True)), "id", "left").withColumn("_f", final)
    reviewed = F.col("_f.judge").isin(*[judge for judge, _ in overrides]) & (F.col("_f.verdict") == KEEP) if overrides else F.lit(False)
    state = F.lit(None).cast("string")
    for verdict, name in ELIGIBILITY.items():
        state = F.when(F.col("_f.verdict") == verdict, name).otherwise(state)
    return rows.select(
        "id", "company_id", "_f.verdict", "_f.judge", F.coalesce(primary | F.coalesce(reviewed, F.lit(False)), F.lit(False)).alias("primary"),
        F.coalesce("_closed", F.lit(False)).alias("closed"), state.alias("eligibility"), F.coalesce(phd if phd is not None else F.lit(False), F.lit(False)).alias("phd"))


def qualifying(roles: DataFrame, tier: str) -> DataFrame:
    """(id): the ads a tier rests on: open ones that are kept, primary ones alone for B-esperienza."""
    kept = roles.where((F.col("verdict") == KEEP) & ~F.col("closed"))
    return (kept.where("primary") if tier == "B-esperienza" else kept).select("id")


def label_summary(companies: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, category, method, labels): the first label by rank with all labels in order; UNLABELLED and `unknown` where there is none.

    `labels` has (company_id, category, rank, method). A company has few labels, as a label is of a fixed list.
    """
    own = labels.groupBy("company_id").agg(F.array_sort(F.collect_set(F.struct("rank", "category", "method"))).alias("_l"))
    first = F.get("_l", F.lit(0))
    none = F.array().cast("array<string>")
    return companies.select("id").join(own.withColumnRenamed("company_id", "id"), "id", "left").select(
        "id", F.coalesce(first["category"], F.lit(UNLABELLED)).alias("category"), F.coalesce(first["method"], F.lit("unknown")).alias("method"),
        F.coalesce(F.transform("_l", lambda x: x["category"]), none).alias("labels"))


def replaced_labels(held: DataFrame, new: DataFrame, by_hand: str) -> DataFrame:
    """(company_id, category, rank, method): `held` with the labels of each company in `new` in place of its own, unless one of those was given by hand."""
    fixed = held.where(F.col("method") == by_hand).select("company_id").distinct()
    taken = new.join(fixed, "company_id", "left_anti").select("company_id", "category", "rank", "method")
    return held.join(taken.select("company_id").distinct(), "company_id", "left_anti").select(*taken.columns).unionByName(taken)


def company_tiers(summary: DataFrame, roles: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """(id, category, axis, tier, keeps): both verdicts composed. Closed ads hold no tier up.

    Ads are counted by company with map-side sums before the join, so a company of any number of ads is one row.
    """
    kept = (F.col("verdict") == KEEP) & ~F.col("closed")
    counts = roles.groupBy(F.col("company_id").alias("id")).agg(F.count_if(kept).alias("keeps"), F.count_if(kept & F.col("primary")).alias("primaries"))
    axis = D.axis(F.filter("labels", lambda x: x != UNLABELLED), preferred, NO_EVIDENCE, WANTED, UNWANTED)
    rows = summary.join(counts, "id", "left").select("id", "category", axis.alias("axis"), F.coalesce("keeps", F.lit(0)).alias("keeps"), F.coalesce("primaries", F.lit(0)).alias("primaries"))
    tier = D.decision_table([
        ((F.col("axis") == WANTED) & (F.col("keeps") > 0), "A"), (F.col("axis") == WANTED, "B-attesa"), (F.col("primaries") > 0, "B-esperienza"), (F.col("axis") == NO_EVIDENCE, "evidenza-mancante")], "scarto")
    return rows.select("id", "category", "axis", tier.alias("tier"), "keeps")
