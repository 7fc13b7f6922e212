"""Named views of rows that need attention, each with a facet, read as counts or as pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> function giving (id, facet)
Lenses = dict[str, Callable[[], DataFrame]]


def marked(lenses: dict[str, tuple[Column, Column]]) -> Column:
    """The (lens, facet) pairs of a row as an array, from (condition, facet) of each lens, so that one pass serves all of them."""
    each = [F.when(where, F.struct(F.lit(name).alias("lens"), F.coalesce(facet, F.lit("")).alias("facet"))) for name, (where, facet) in lenses.items()]
    return F.array_compact(F.array(*each))


def tally(rows: Sequence[DataFrame]) -> DataFrame:
    """(lens, facet, n) of rows (lens, facet), with a row of null facet for all rows of a lens; counted before anything is shuffled."""
    whole = reduce(DataFrame.unionByName, [df.select("lens", "facet") for df in rows])
    part = whole.rollup("lens", "facet").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3")
    return part.select("lens", F.when(F.col("g") == 0, F.col("facet")).alias("facet"), "n")


def counts(lenses: Lenses) -> DataFrame:
    """(lens, facet, n) with a row of null facet and all rows of a lens as its total."""
    out = None
    for name, rows in lenses.items():
        part = rows().rollup("facet").agg(F.count("*").alias("n"), F.grouping("facet").alias("g"))
        part = part.select(F.lit(name).alias("lens"), F.when(F.col("g") == 0, F.coalesce("facet", F.lit(""))).alias("facet"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def page(lenses: Lenses, name: str, facet: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of 1 to 200 rows of one lens in order of id, of one facet if given."""
    if name not in lenses:
        raise ValueError(f"unknown lens {name!r}; one of {', '.join(lenses)}")
    rows = lenses[name]()
    if facet is not None:
        rows = rows.where(F.coalesce("facet", F.lit("")) == facet)
    return rows.orderBy("id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))
