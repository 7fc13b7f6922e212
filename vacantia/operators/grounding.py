"""Answers held against what they cite: keys must exist, quotes must be verbatim, batches complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verbatim(quote: Column, source: Column) -> Column:
    """Whether a quote that isn't empty stands in the source, blanks aside."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return (flat(quote) != "") & (F.instr(flat(source), flat(quote)) > 0)


def facts_error(facts: Column, catalog: Column, fields: Sequence[str]) -> Column:
    """Why a list of (field, text, key) facts can't be accepted, null if it can: unknown field, no text, key not listed."""
    bad = lambda test: F.exists(facts, test)
    return (
        F.when(bad(lambda f: ~f["field"].isin(*fields)), "unknown field")
        .when(bad(lambda f: F.trim(F.coalesce(f["text"], F.lit(""))) == ""), "fact without text")
        .when(bad(lambda f: ~F.map_contains_key(catalog, F.coalesce(f["key"], F.lit("")))), "reference that isn't in the catalog"))


def cited(facts: Column, catalog: Column) -> Column:
    """Facts with the line they cite in place of its key."""
    return F.transform(facts, lambda f: F.struct(f["field"].alias("field"), f["text"].alias("text"), catalog[f["key"]].alias("quote")))


def batches(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(batch, complete, missing, foreign) of asked (batch, id) against answered (batch, id, pos, valid).

    Of several answers to an id the first valid one counts. A batch is complete if its ids are exactly those asked.
    """
    first = answers.where("valid").groupBy("batch", "id").agg(F.min("pos").alias("pos"))
    both = asked.withColumn("a", F.lit(1)).join(first.withColumn("b", F.lit(1)), ["batch", "id"], "full_outer")
    n = both.groupBy("batch").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("foreign"))
    return n.select("batch", ((F.col("missing") == 0) & (F.col("foreign") == 0)).alias("complete"), "missing", "foreign")
