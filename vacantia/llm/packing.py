"""Problem 7: items of varying length put into containers of fixed capacity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.tokens import lengths
from vacantia.runtime import materialize, table

#: Items packed together in one task, about; a source of any size is divided by hash into partitions of this many.
PARTITION = 5_000
#: Partitions whose container count isn't proven least that exchange items together, at least, where there are so many.
CIRCLE = 3
#: A container filled beyond this share keeps its items in an exchange.
FULL = 0.985
#: Equal rows that are numbered at once.
STRETCH = 10_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: the largest item first, each into the fullest container it fits in.

    Open containers are kept by what is left in them; the bits of one number say which amounts occur, so finding the
    smallest that suffices takes a shift. Items of equal size keep their order. Sizes are 0 to `capacity`.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_rest: dict[int, list[int]] = {}
    occurs, out, opened = 0, [0] * len(sizes), 0
    for i in order:
        size = sizes[i]
        fits = occurs >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            c = by_rest[rest].pop()
            if not by_rest[rest]:
                occurs &= ~(1 << rest)
        else:
            c, rest, opened = opened, capacity, opened + 1
        rest -= size
        by_rest.setdefault(rest, []).append(c)
        occurs |= 1 << rest
        out[i] = c
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no packing can do without, by dual feasible functions.

    Such a function weighs sizes so that no container's weights exceed 1; the sum of all weights, rounded up, is a
    bound. Used are the identity, Martello and Toth's (items over capacity - t count whole, those under t not at all)
    for every t that occurs, and Fekete and Schepers' roundings u(k) up to k = 30.
    """
    if not any(sizes):
        return 1 if sizes else 0
    order = sorted(sizes)
    total = [0]
    for s in order:
        total.append(total[-1] + s)
    best = -(-total[-1] // capacity)
    n = len(order)
    low, high = 0, n
    for t in sorted({s for s in order if 2 * s <= capacity}):
        while low < n and order[low] < t:
            low += 1
        while high > 0 and order[high - 1] > capacity - t:
            high -= 1
        if high >= low:
            best = max(best, n - high - (-(total[high] - total[low]) // capacity))
    for k in range(1, 31):
        weight = 0  # in units of 1 / (k * capacity)
        for s in order:
            whole, left = divmod((k + 1) * s, capacity)
            weight += k * s if left == 0 else whole * capacity
        best = max(best, -(-weight // (k * capacity)))
    return best


_PLACED = "source string, capacity int, id string, piece int, tokens int, grp string, container string, fill int, bins int, bound int"


def _rows(items: pd.DataFrame, label: str, at: list[int], bound: int) -> pd.DataFrame:
    out = items[["source", "capacity", "id", "piece", "tokens"]].copy()
    index = pd.Series(at, index=out.index)
    out["grp"] = label
    out["container"] = [f"{label}.{c}" for c in at]
    out["fill"] = out.groupby(index)["tokens"].transform("sum")
    out["bins"] = int(index.nunique())
    out["bound"] = bound
    return out


def _pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values(["tokens", "id", "piece"], ascending=[False, True, True])
    capacity, sizes = int(items["capacity"].iloc[0]), items["tokens"].astype(int).tolist()
    return _rows(items, f"{key[0]}|{key[1]}", best_fit_decreasing(sizes, capacity), lower_bound(sizes, capacity))


def _repack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    """Pack what several partitions gave away; where that doesn't save a container, the old ones stay."""
    new = _pack(key, items)
    if new["bins"].iloc[0] < items["container"].nunique():
        return new
    return items[new.columns]


def _copies(items: DataFrame) -> DataFrame:
    """`items` with a `copy` number that tells equal rows apart, so that a row repeated without end is dealt like others.

    Equal rows are counted with map-side sums and given out again in stretches of STRETCH, so none is gathered.
    """
    counted = items.groupBy(*items.columns).agg(F.count("*").alias("n"))
    stretches = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))).alias("stretch"))
    last = F.least(F.col("n"), (F.col("stretch") + 1) * STRETCH)
    return stretches.select(*items.columns, F.explode(F.sequence(F.col("stretch") * STRETCH + 1, last)).alias("copy"))


def _opened(placed: DataFrame) -> int:
    """Containers in use."""
    return placed.select("source", "container").distinct().count()


def pack(items: DataFrame) -> DataFrame:
    """(source, id, piece, tokens, capacity, container) from (source, capacity, id, tokens).

    An item over the capacity is cut into full containers and a rest that is packed like other items; no other item is
    cut. Items of no tokens take no room but get a container. Items without a capacity (null or under 1) get a row with
    a null container; null tokens count as 0. Repeated rows are packed as often as they occur; null ids are packed too.

    Each source is divided by hash into partitions of about PARTITION items, packed by best-fit decreasing; the lower
    bound of a partition certifies its count. Partitions with a gap give the items of their unfilled containers to one
    another, a few partitions at a time, and best-fit decreasing runs again over what was given; a regrouping that
    saves nothing is undone, and its partitions, whose bounds still show the gap, meet others in the next round, until
    a round saves nothing. Only ids and sizes move. The smallest ids and sizes break ties, so the result is the same
    at every run.
    """
    known = items.select("source", F.col("capacity").cast("int").alias("capacity"), F.col("id").cast("string").alias("id"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("int").alias("tokens"))
    homeless = known.where("capacity is null or capacity < 1").select("source", "id", F.lit(1).alias("piece"), "tokens", "capacity", F.lit(None).cast("string").alias("container"))
    fit = known.where("capacity >= 1")
    whole = (F.col("tokens") / F.col("capacity")).cast("int")
    over = fit.where("tokens > capacity").select("*", F.explode(F.sequence(F.lit(1), whole)).alias("piece"))
    full = over.select("source", "id", "piece", F.col("capacity").alias("tokens"), "capacity", F.concat_ws(".", F.concat_ws("|", "source", F.lit("full")), F.coalesce("id", F.lit("")), "piece").alias("container"))
    rest = fit.select(
        "source", "capacity", "id", F.when(F.col("tokens") > F.col("capacity"), whole + 1).otherwise(1).alias("piece"),
        F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") - whole * F.col("capacity")).otherwise(F.col("tokens")).cast("int").alias("tokens"))
    rest = rest.where("tokens > 0 or piece = 1")
    parts = rest.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / PARTITION).alias("parts"))
    dealt = _copies(rest).join(parts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "capacity", "id", "piece", "tokens", F.concat(F.lit("0."), F.pmod(F.pmod(F.xxhash64("id", "piece", "tokens"), "parts") + F.col("copy") - 1, "parts")).alias("grp"))
    placed = materialize(dealt.groupBy("source", "grp").applyInPandas(_pack, _PLACED))
    opened, n = _opened(placed), 0
    while True:
        n += 1
        open_still = F.col("fill") < FULL * F.col("capacity")
        gap = placed.where((F.col("bins") > F.col("bound")) & open_still).select("source", "grp").distinct()
        count = gap.groupBy(F.col("source").alias("c")).agg(F.count("*").alias("count")).where("count > 1")
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("grp", F.lit(n)), "grp")) - 1
        circles = F.greatest(F.lit(1), F.floor(F.col("count") / CIRCLE))
        circle = F.concat(F.lit(f"{n}."), F.floor(F.col("place") * circles / F.col("count"))).alias("circle")
        ranked = gap.withColumn("place", place)
        joined = materialize(ranked.join(count, F.col("source").eqNullSafe(F.col("c"))).select(F.col("source").alias("s"), F.col("grp").alias("p"), circle))
        if joined.isEmpty():
            break
        marked = placed.join(joined, F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("p")), "left")
        given = F.col("circle").isNotNull() & open_still
        moved = marked.where(given).drop("s", "p").groupBy("source", "circle").applyInPandas(_repack, _PLACED)
        placed = materialize(marked.where(~given).select(*placed.columns).unionByName(moved))
        before, opened = opened, _opened(placed)
        if opened >= before:
            break
    return placed.select("source", "id", "piece", "tokens", "capacity", "container").unionByName(full).unionByName(homeless)


def bounds(packed: DataFrame) -> DataFrame:
    """(source, capacity, pieces, tokens, containers, bound): what each source took, and the least it could take.

    The bound is that of the dual feasible functions whose sums need no sorting: identity, halves, and u(1) to u(10).
    """
    c = F.col("capacity")
    s = F.col("tokens")
    sums = [F.sum(s / c), F.sum((2 * s > c).cast("int"))]
    sums += [F.sum(F.when((F.lit(k + 1) * s) % c == 0, s / c).otherwise(F.floor(F.lit(k + 1) * s / c) / k)) for k in range(1, 11)]
    return packed.where("container is not null").groupBy("source", "capacity").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers"),
        F.greatest(*[F.ceil(x - 1e-9) for x in sums]).cast("long").alias("bound"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    sizes = materialize(lengths(table(spark, folder, "documents"), ["doc_id", "source"], "text"))
    targets = table(spark, folder, "pack_targets").groupBy("source").agg(F.max("capacity_tokens").alias("capacity"))
    return pack(sizes.join(targets, "source", "left").select("source", "capacity", F.col("doc_id").alias("id"), "tokens"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, piece_no, source, tokens, container) of every document, or of each of its pieces."""
    return _documents(spark, folder).select(F.col("id").cast("long").alias("doc_id"), F.col("piece").alias("piece_no"), "source", "tokens", "container")


def p7_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each source against the proven least number."""
    return bounds(_documents(spark, folder))


QUERIES = {"p7_containers": p7_containers, "p7_bounds": p7_bounds}
ORACLES: dict[str, str] = {}
