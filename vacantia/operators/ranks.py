"""Rows chosen by rank: latest states, first examples, samples, percentiles, streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.runtime import materialize


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order` (nulls first, ties by all other columns). Aggregated map-side."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    held = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return held.select(*keys, *[F.col("_r")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def examples(df: DataFrame, group: Sequence[str], distinct: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of each group by `order`, one for each value of `distinct`; `_rank` counts from 1."""
    first = df.groupBy(*group, *distinct).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in (*group, *distinct, *order)])).alias("_r"))
    rows = first.select(*group, *distinct, "_r.*")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order, *distinct))
    return rows.withColumn("_rank", place).where(F.col("_rank") <= k)


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rank`, from 0, of each row among those of its key, exact whatever the size of a key.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows lies in many partitions; each
    partition counts its own rows of a key, and sums over the partitions before it give the ranks to start from. The
    partitioned rows are written once, as a second evaluation might draw the ranges differently.
    """
    placed = materialize(df.repartitionByRange(*[F.asc_nulls_first(c) for c in (*keys, *order)]).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_p").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_p", *keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    numbered = placed.withColumn("_r", F.row_number().over(own) - 1).alias("x")
    same = F.col("x._p") == F.col("y._p")
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    joined = numbered.join(starts.alias("y"), same)
    return joined.select(*[F.col(f"x.{c}").alias(c) for c in df.columns], (F.col("_r") + F.col("_s")).alias("rank"))


def round_robin(df: DataFrame, stratum: str, key: str, seed: str, limit: int) -> DataFrame:
    """A sample of `limit` rows that takes one of each stratum in turn; `split` holds out every fifth.

    Within a stratum rows come in the order of a seeded hash of their key, so the sample is the same at every run.
    """
    shuffled = df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), key), 256))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    chosen = shuffled.withColumn("_turn", turn).where(F.col("_turn") <= limit).orderBy("_turn", stratum).limit(limit)
    place = F.row_number().over(Window.orderBy("_turn", stratum)) - 1
    return chosen.withColumn("position", place).withColumn("split", F.when(F.col("position") % 5 == 4, "holdout").otherwise("development")).drop("_h", "_turn")


def audit_sample(df: DataFrame, group: str, closeness: Column, key: str, seed: str, size: int) -> DataFrame:
    """`size` rows of each group: half of them (rounded up) nearest the limit, the others by a seeded hash of the key.

    Keys are unique. Both choices are the first ranks of a window, which are cut down inside each partition before the
    shuffle, so a group of any size sends no more than its sample from each task.
    """
    first = lambda rows, n, *order: rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    near = first(df, (size + 1) // 2, closeness, key)
    rest = df.join(near.select(key), key, "left_anti")
    drawn = first(rest, size // 2, F.sha2(F.concat_ws(":", F.lit(seed), key), 256), key)
    return near.withColumn("kind", F.lit("boundary")).unionByName(drawn.withColumn("kind", F.lit("random")))


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: the one at place floor(n * share) of the sorted group, from 0."""
    ranked = running_rank(df.where(F.col(value).isNotNull()).select(group, value), [group], [value])
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n"))
    rows = ranked.join(sizes, group)
    place = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return rows.groupBy(group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("rank") == place(s), F.col(value))).alias(name) for name, s in shares.items()])


def within_budget(df: DataFrame, key: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """(key, order, size, place): the first rows of each key, up to `most`, that still fit in a budget.

    A row that doesn't fit is passed over, not cut. Each place is one aggregation over all rows of the key, so a key of
    any size is never gathered.
    """
    rows = df.select(key, order, size)
    state = rows.where(F.col(size) <= budget).groupBy(key).agg(F.min(F.struct(order, size)).alias("_b")).select(key, F.col("_b")[order].alias(order), F.col("_b")[size].alias(size), F.lit(1).alias("place"), F.col("_b")[size].alias("_used"))
    out = state
    for n in range(2, most + 1):
        last = state.select(F.col(key).alias("_k"), F.col(order).alias("_o"), "_used")
        rest = rows.join(last, F.col(key) == F.col("_k")).where((F.col(order) > F.col("_o")) & (F.col(size) + F.col("_used") <= budget))
        best = rest.groupBy(key).agg(F.min(F.struct(order, size, "_used")).alias("_b"))
        state = best.select(key, F.col("_b")[order].alias(order), F.col("_b")[size].alias(size), F.lit(n).alias("place"), (F.col("_b._used") + F.col("_b")[size]).alias("_used"))
        out = out.unionByName(state)
    return out.drop("_used")


def first_stop(df: DataFrame, run: str, order: Sequence[str], failed: str, refused: Column, streak: int, calls: int, share: float) -> DataFrame:
    """The call at which each run should have stopped, and why: refused credentials, failures in a row, or too many."""
    w = Window.partitionBy(run).orderBy(*order)
    count = df.withColumn("_c", F.row_number().over(w)).withColumn("_f", F.sum(F.col(failed).cast("int")).over(w))
    island = F.sum((~F.col(failed)).cast("int")).over(w)
    rows = count.withColumn("_i", island).withColumn("_s", F.sum(F.col(failed).cast("int")).over(Window.partitionBy(run, "_i").orderBy(*order)))
    why = F.when(~F.col(failed), None).when(refused, "refused").when(F.col("_s") >= streak, "streak").when((F.col("_c") >= calls) & (F.col("_f") > F.col("_c") * share), "share")
    stops = rows.withColumn("why", why).where("why is not null")
    return stops.groupBy(run).agg(F.min(F.struct(F.col("_c").alias("calls"), F.col("_f").alias("failures"), "why")).alias("_r")).select(run, "_r.*")


def remaining_seconds(done: Column, total: Column, attempted: Column, elapsed: Column, least: int = 50) -> Column:
    """Time left at the pace so far; null before `least` attempts."""
    return F.when(attempted >= least, (total - done) * elapsed / attempted)
