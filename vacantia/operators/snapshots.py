"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Deliveries whose numbers are held as a literal list in the plan; beyond it their order is found by a join.
LITERAL_DELIVERIES = 10_000


def row_digest(parts: Sequence[Column]) -> Column:
    """128-bit digest of the canonical form of a row's columns; a null differs from every text."""
    fields = [F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]
    sized = [F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in fields]
    return F.unhex(F.md5(F.concat(*sized)))


def latest_state(rows: DataFrame, keys: Sequence[str], snapshot: str, order: str, payload: Sequence[str]) -> DataFrame:
    """The row of each (snapshot, key) with the largest `order`; nulls of `order` come before all values.

    Ties are broken by the payload itself, so repeated rows and file order don't matter. Partial aggregation on the
    map side keeps a record that is repeated a million times from reaching one task a million times.
    """
    newest = F.max(F.struct(F.col(order), *[F.col(c) for c in payload])).alias("_s")
    held = rows.groupBy(snapshot, *keys).agg(newest)
    return held.select(snapshot, *keys, *[F.col("_s")[c].alias(c) for c in payload])


def with_successor(states: DataFrame, snapshots: DataFrame, snapshot: str) -> DataFrame:
    """`states` with `_next`, the number of the following delivery (null for the last), and `_later`, false for the first."""
    numbers = snapshots.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    few = sorted(r[0] for r in numbers.limit(LITERAL_DELIVERIES + 1).collect())
    if len(few) > LITERAL_DELIVERIES:
        by_number = Window.orderBy(snapshot)
        order = numbers.select(snapshot, F.lead(snapshot).over(by_number).alias("_next"), (F.row_number().over(by_number) > 1).alias("_later"))
        return states.join(order, snapshot, "left")
    if not few:
        return states.withColumn("_next", F.col(snapshot)).withColumn("_later", F.lit(False))
    following = F.array(*[F.lit(x) for x in few[1:]]) if len(few) > 1 else F.array().cast("array<int>")
    place = F.array_position(F.array(*[F.lit(x) for x in few]), F.col(snapshot)).cast("int")
    return states.withColumn("_next", F.get(following, place - 1)).withColumn("_later", F.col(snapshot) > few[0])


def snapshot_changes(
    rows: DataFrame,
    keys: Sequence[str],
    snapshot: str,
    order: str,
    strict: Sequence[str],
    lenient: Sequence[str] = (),
) -> DataFrame:
    """(snapshot, *keys, change) for every two consecutive deliveries.

    `change` is `added` (only in the later), `removed` (only in the earlier) or `changed`: the digest of the `strict`
    columns differs, or that of a `lenient` column differs with neither side null. Deliveries are ordered by number,
    whatever gaps they leave; rows without a number or without a complete key belong to no delivery and are left out.
    An empty table and a single delivery give no rows. Columns besides those named are ignored, whatever they are called.

    Plan: one shuffle for the state of each delivery (reused by both sides), one for the earlier side, which must meet
    its successor's number; the full outer join compares 16-byte digests only.
    """
    named = [F.col(c) for c in dict.fromkeys([snapshot, *keys, order, *strict, *lenient])]
    whole = rows.select(*named).dropna(subset=[snapshot, *keys])
    slim = whole.select(
        snapshot, *keys, order, row_digest([F.col(c) for c in strict]).alias("_d"),
        *[F.when(F.col(c).isNotNull(), row_digest([F.col(c)])).alias(f"_l{i}") for i, c in enumerate(lenient)],
    )
    marks = ["_d", *[f"_l{i}" for i in range(len(lenient))]]
    states = with_successor(latest_state(slim, keys, snapshot, order, marks), rows, snapshot)
    later = states.where("_later").select(
        snapshot, *keys, F.lit(True).alias("_new"), *[F.col(m).alias(f"{m}n") for m in marks])
    earlier = states.where(F.col("_next").isNotNull()).select(
        F.col("_next").alias(snapshot), *keys, F.lit(True).alias("_old"), *[F.col(m).alias(f"{m}o") for m in marks])
    both = later.join(earlier, [snapshot, *keys], "full_outer")
    differs = F.col("_dn") != F.col("_do")
    for m in marks[1:]:
        differs = differs | F.coalesce(F.col(f"{m}n") != F.col(f"{m}o"), F.lit(False))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differs, "changed")
    return both.select(snapshot, *keys, change.alias("change")).where(F.col("change").isNotNull())
