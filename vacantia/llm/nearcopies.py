"""Problem 2: records that share most of their text but differ by small edits."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.darts import band_keys, mix, signatures, sketches
from vacantia.operators.components import connected_components
from vacantia.runtime import materialize, pieces, table

_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Coordinates of a signature, those of a band, and how often the coordinates are cut into bands.
COORDINATES, ROWS, PASSES = 144, 4, 2
#: Shingles in up to this share of all texts have full weight; it falls with the squared logarithm of the share above, to LEAST_WEIGHT.
RARE, LEAST_WEIGHT = 0.01, 0.15
#: Counters of the table of shingle frequencies; two shingles that share one only look a little more common.
COUNTERS = 2**20
#: Agreeing coordinates of the 64 in a sketch, a sixteenth of the others by chance, that a pair needs to be compared exactly.
AGREEING = 16
#: Texts in a bucket that are paired one by one; those of a larger one are compared in blocks.
FEW = 200
#: Texts compared with all others to find groups that hold a large share of the corpus, and how many of them make such a group.
PROBES, HOT = 1000, 8
#: Different texts in a block, about; each two blocks of a crowded group are compared in one task.
BLOCK = 25_000
#: Meetings of two texts in a shingle that are counted at once, and characters that are cut into words at once.
STEP, SPAN = 4_000_000, 1_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased, after tags are removed and entities decoded."""
    return _WORD.findall(_plain(text).lower())


def _plain(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    return html.unescape(text) if "&" in text else text


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text it is of) of every word of `words_of`, in order; computed on the code points of all texts at once."""
    joined = "\0".join("" if t is None else _plain(t).replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.searchsorted(np.flatnonzero(points == 0), starts)
    at = np.flatnonzero(inside)
    size = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    letters = mix((points[at] | (place.astype(np.uint64) << np.uint64(21))) * _ODD)
    return mix(np.add.reduceat(letters, np.cumsum(size) - size)), owner


def grams(texts: list[str | None], size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, how many each text has, which texts have at least `least` words); in order of the text."""
    flat, owner = _words(texts)
    enough = np.bincount(owner, minlength=len(texts)) >= max(least, size)
    if len(flat) < size:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), enough
    x = flat[: len(flat) - size + 1].copy()
    for j in range(1, size):
        x = mix(x * _ODD + flat[j : len(flat) - size + 1 + j])
    whole = (owner[: len(x)] == owner[size - 1 :]) & enough[owner[: len(x)]]
    of = owner[: len(x)][whole]
    _, first = np.unique((of.astype(np.uint64) << np.uint64(32)) | (mix(x[whole]) >> np.uint64(32)), return_index=True)
    first.sort()
    return (mix(x[whole][first]) >> np.uint64(32)).astype(np.uint32), np.bincount(of[first], minlength=len(texts)), enough


def _spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SPAN characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SPAN:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingled(df: DataFrame, key: str, text: Column, size: int, least: int) -> DataFrame:
    """(id, key, grams): the distinct shingles of each text of at least `least` words, as 32-bit hashes in order of the text.

    `key` is a 64-bit hash of the whole set, the same for copies. Among a billion different texts, two share a key
    by chance with a probability of 3 %.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for low, high in _spans(texts):
                x, n, enough = grams(texts[low:high], size, least)
                kept = np.flatnonzero(enough)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64) * _ODD + np.uint64(1)))])
                ends = np.cumsum(n)
                keys = mix(total[ends] - total[ends - n] + n.astype(np.uint64))[kept].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends[kept]), pa.int32()), pa.array(x.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept + low)), pa.array(keys), lists], names=["id", "key", "grams"])

    rows = df.select(F.col(key).cast("string").alias("id"), text.alias("t")).where("id is not null and t is not null")
    return rows.mapInArrow(run, "id string, key long, grams array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each list has) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint32), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _once(keys: np.ndarray) -> np.ndarray:
    """Places of the first of each key."""
    first = np.unique(keys, return_index=True)[1]
    first.sort()
    return first


def common(every: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counters, weights) of the shingles in over a RARE share of all texts; all others weigh 1.

    Counted over all texts, copies within a batch once, in a table of COUNTERS counters for each task, which are summed
    in two steps. Only counters over the share come to the driver: mean shingles a text / RARE of them at most.
    """
    slices = COUNTERS // 2**14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = np.zeros(COUNTERS, np.int64), 0
        for b in batches:
            fresh = _once(b.column(0).to_numpy())
            texts += len(fresh)
            table += np.bincount(_lists(b.column(1).take(pa.array(fresh)))[0] % COUNTERS, minlength=COUNTERS)
        if texts:
            parts = pa.ListArray.from_arrays(pa.array(np.arange(slices + 1) * 2**14, pa.int32()), pa.array(table))
            part = np.arange(slices), np.full(slices, int(table.sum()) % 32)
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(np.full(slices, texts)), parts], names=["slice", "of", "texts", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        flat, _ = rows.column("counts").combine_chunks().flatten().to_numpy(), None
        total = flat.reshape(rows.num_rows, -1).sum(axis=0)
        texts = int(np.sum(rows.column("texts").to_numpy()))
        return pa.table({"slice": rows.column("slice")[:1], "of": rows.column("of")[:1], "texts": pa.array([texts]), "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    def chosen(rows: pa.Table) -> pa.Table:
        row = add(rows)
        total, texts = row.column("counts").combine_chunks().flatten().to_numpy(), row.column("texts")[0].as_py()
        often = np.flatnonzero(total > max(RARE * texts, 1))
        return pa.table({"counter": pa.array(often + row.column("slice")[0].as_py() * 2**14), "share": pa.array(total[often] / texts)})

    shape = "slice long, of long, texts long, counts array<long>"
    summed = every.select("key", "grams").mapInArrow(count, shape).groupBy("slice", "of").applyInArrow(add, shape)
    found = summed.groupBy("slice").applyInArrow(chosen, "counter long, share double").toArrow()
    counter = found.column("counter").to_numpy()
    order = np.argsort(counter)
    share = np.minimum(found.column("share").to_numpy()[order], 1.0)
    return counter[order], np.maximum((np.log(1 / share) / math.log(1 / RARE)) ** 2, LEAST_WEIGHT)


def weighed(g: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The weight of each shingle."""
    counters, weights = listed
    if not len(counters):
        return np.ones(len(g))
    at = np.minimum(np.searchsorted(counters, g % COUNTERS), len(counters) - 1)
    return np.where(counters[at] == g % COUNTERS, weights[at], 1.0)


def signed(every: DataFrame, listed: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, s0, s1, s2, s3, buckets): the sketch and the band keys of each set's DartMinHash signature; copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fresh = _once(b.column(0).to_numpy())
            for part in np.array_split(fresh, len(fresh) // 500 + 1):
                g, n = _lists(b.column(1).take(pa.array(part)))
                sig = signatures(mix(g.astype(np.uint64) + np.uint64(1)), np.repeat(np.arange(len(part)), n), weighed(g, listed), len(part), COORDINATES)
                buckets = band_keys(sig, ROWS, PASSES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * buckets.shape[1], pa.int32()), pa.array(buckets.ravel()))
                marks = [pa.array(s) for s in np.ascontiguousarray(sketches(sig).T)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), *marks, lists], names=["key", "s0", "s1", "s2", "s3", "buckets"])

    return every.select("key", "grams").mapInArrow(run, "key long, s0 long, s1 long, s2 long, s3 long, buckets array<long>")


def bucketed(marks: DataFrame) -> DataFrame:
    """(bucket, a, b): all pairs of different keys in buckets of up to FEW, bucket null; and (bucket, key, null) for each key in a larger one.

    Rows come sorted by bucket and are read as a stream, so a bucket of any size takes no more memory than FEW keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_k, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _ended(batches):
            if batch is None:
                bucket, key = held_b, held_k
            else:
                bucket = np.concatenate([held_b, batch.column(0).to_numpy()])
                key = np.concatenate([held_k, batch.column(1).to_numpy()])
            if not len(bucket):
                continue
            fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]))
            bucket, key = bucket[fresh], key[fresh]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(starts, len(bucket)))
            n = np.repeat(size, size)
            many = n > FEW
            if crowded is not None:
                many |= bucket == crowded
            last = bucket == bucket[-1]
            if batch is not None:
                crowded = bucket[-1] if many[-1] else None
                wait = last & ~many
                held_b, held_k = bucket[wait], key[wait]
                if many[-1]:  # the last key stays to be told from a repeated row
                    held_b, held_k = bucket[-1:], key[-1:]
                    many[-1] = False
                few = ~many & ~last
            else:
                few = ~many
            x, y = [], []
            place = np.flatnonzero(few & (n > 1))
            step = 1
            while len(place):
                place = place[place + step < len(bucket)]
                place = place[bucket[place + step] == bucket[place]]
                x.append(key[place])
                y.append(key[place + step])
                step += 1
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
            a = pa.array(np.concatenate([np.minimum(x, y), key[many]]))
            names = pa.array(np.concatenate([np.zeros(len(x), np.int64), bucket[many]]), mask=np.arange(len(a)) < len(x))
            b = pa.array(np.concatenate([np.maximum(x, y), np.zeros(int(many.sum()), np.int64)]), mask=np.arange(len(a)) >= len(x))
            yield pa.RecordBatch.from_arrays([names, a, b], names=["bucket", "a", "b"])

    rows = marks.select(F.explode("buckets").alias("bucket"), "key")
    rows = rows.repartition(pieces(marks.sparkSession), "bucket").sortWithinPartitions("bucket", "key")
    return rows.mapInArrow(run, "bucket long, a long, b long")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _shared(g: np.ndarray, ends: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of its shingles each set of `x` shares with that of `y`; set i is the n[i] numbers of `g` before ends[i]."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 2000):
        both = np.stack([x[at : at + 2000], y[at : at + 2000]], 1).ravel()
        size = n[both]
        place = np.arange(size.sum()) + np.repeat(ends[both] - np.cumsum(size), size)
        rows = np.sort((np.repeat(np.arange(len(both)) // 2, size) << 32) | g[place])
        out[at : at + 2000] += np.bincount(rows[1:][rows[1:] == rows[:-1]] >> 32, minlength=len(both) // 2)
    return out


def close_pairs(g: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): all sets of `left` and of `right` that share at least `threshold` of all their shingles; none is left out.

    Sets lie in `g` one after the other, n[i] different shingles each. With the rarest first, close sets share one of
    the first n - threshold * n + 1 of either. Those shared are counted; with all that may follow in the set whose first
    ones end sooner they must reach what the threshold asks for. What is left is counted whole.
    """
    owner = np.repeat(np.arange(len(n)), n)
    _, g, often = np.unique(g, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    g = np.sort((owner << 32) | rank[g]) & 0xFFFFFFFF
    ends = np.cumsum(n)
    first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    first = np.minimum(first, n)
    last = g[ends - n + first - 1] if len(n) else n
    begins = np.arange(len(g)) - (ends - n)[owner] < first[owner]
    place = np.full(len(n), -1)
    place[right] = np.arange(len(right))
    posted = np.flatnonzero(begins & (place[owner] >= 0))
    posted = posted[np.argsort(g[posted], kind="stable")]
    holder = place[owner[posted]]
    start = np.searchsorted(g[posted], np.arange(len(often) + 1))
    asked = threshold / (1 + threshold)
    lists = np.diff(start)
    work = np.add.reduceat(np.where(begins, lists[g], 0), ends - n) if len(n) else n
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    done = np.cumsum(work[left])
    at = 0
    while at < len(left):
        to = max(at + 1, min(at + 256, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP))))
        some = left[at:to]
        size = first[some]
        rows = np.arange(size.sum()) + np.repeat((ends - n)[some] - (np.cumsum(size) - size), size)
        count = lists[g[rows]]
        hits = np.arange(count.sum()) + np.repeat(start[g[rows]] - (np.cumsum(count) - count), count)
        met = np.bincount(np.repeat(np.repeat(np.arange(len(some)), size) * len(right), count) + holder[hits], minlength=0)
        cells = np.flatnonzero(met)
        x, y = some[cells // len(right)], right[cells % len(right)]
        rest = np.where(last[x] <= last[y], n[x] - first[x], n[y] - first[y])
        able = (x != y) & (met[cells] + rest >= asked * (n[x] + n[y]) - 1e-9)
        x, y = x[able], y[able]
        shared = _shared(g, ends, n, x, y)
        close = shared >= threshold * (n[x] + n[y] - shared)
        found.append((x[close], y[close]))
        at = to
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def compared(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of keys of a group, not both of one `hot` cluster, whose sets share at least `threshold` of all their shingles.

    `groups` has (name, key, hot), hot null outside of clusters, `sets` (key, grams). The keys of a group are dealt into
    blocks of about BLOCK and each two blocks meet in a task of their own, where a prefix filter leaves no pair out:
    a task is bounded for a group of any size, and only links come out.
    """
    size = groups.groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("hot").isNull()).alias("open"), F.max("hot").alias("x"), F.min("hot").alias("y"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = groups.join(size.where("n > 1 and (open or x != y)"), "name").select(
        "name", "key", "hot", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
    rows = dealt.select("name", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "hot", "block").join(sets, "key")

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        keys, block = part.column("key").to_numpy(), part.column("block").to_numpy()
        hot = part.column("hot").fill_null(-1).to_numpy()
        g, n = _lists(part.column("grams"))
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for cluster in np.unique(hot):
            rest = (block == high) if cluster < 0 else (block == high) & (hot != cluster)
            left = np.flatnonzero((block == low) & (hot == cluster))
            if len(left) and rest.any():
                found.append(close_pairs(g, n, left, np.flatnonzero(rest), threshold))
        x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        a, b = np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y])
        once = (a != b) & ((low != high) | (keys[x] < keys[y]) | (hot[x] != hot[y]))
        return pa.table({"a": pa.array(a[once], pa.int64()), "b": pa.array(b[once], pa.int64())})

    return rows.groupBy("name", "low", "high").applyInArrow(run, "a long, b long")


def hot_groups(every: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame]:
    """((key, hot) of the members of groups of near copies that hold a large share of all texts, or None if there are none; (a, b) of the links met on the way).

    PROBES texts, those of the least keys, are compared exactly with each other. Where HOT or more of them are near
    copies, every text of the corpus is compared with these; whoever is close to one is of its group. A group of a
    share s of all texts holds about PROBES * s of the probes, so one of 2 % is found with 99.9 % certainty.
    """
    spark = every.sparkSession
    names = [r.key for r in every.select("key").distinct().orderBy("key").limit(PROBES).collect()]
    probes = every.where(F.col("key").isin(names)).groupBy("key").agg(F.min("grams").alias("grams")).toArrow()
    keys = probes.column("key").to_numpy()
    g, n = _lists(probes.column("grams"))
    place = np.arange(len(n))
    x, y = close_pairs(g, n, place, place, threshold)
    label = np.arange(len(n))
    for _ in range(len(n)):
        before = label.copy()
        np.minimum.at(label, x, label[y])
        label = label[label]
        if (label == before).all():
            break
    met = keys[x] < keys[y]
    links = spark.createDataFrame(pa.table({"a": pa.array(keys[x[met]], pa.int64()), "b": pa.array(keys[y[met]], pa.int64())}), "a long, b long")
    often = np.bincount(label, minlength=len(n))[label] >= HOT
    if not often.any():
        return None, links
    ends = np.cumsum(n)
    hot = np.flatnonzero(often)
    lists = [g[ends[i] - n[i] : ends[i]] for i in hot]
    sent = spark.sparkContext.broadcast((np.concatenate(lists), n[hot], label[hot]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pg, pn, of = sent.value
        for b in batches:
            fresh = _once(b.column(0).to_numpy())
            for part in np.array_split(fresh, len(fresh) // 2000 + 1):
                g, n = _lists(b.column(1).take(pa.array(part)))
                first = len(pn)
                x, y = close_pairs(np.concatenate([pg, g]), np.concatenate([pn, n]), np.arange(first, first + len(n)), np.arange(first), threshold)
                member, at = np.unique(x, return_index=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part[member - first])), pa.array(of[y[at]])], names=["key", "hot"])

    found = every.select("key", "grams").mapInArrow(run, "key long, hot long")
    return found.groupBy("key").agg(F.min("hot").alias("hot")), links


def linked(every: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of keys whose sets share at least `threshold` of all their shingles, as far as found.

    Pairs inside a hot group are found by comparing its blocks. All others are found if they share a band of their
    DartMinHash signatures; those of a bucket of up to FEW are looked at by sketches and then compared exactly, larger
    buckets are compared in blocks. What bands find depends on how close the rarer shingles of a pair are, not on how
    large the corpus or the bucket is.
    """
    marks = materialize(signed(every, common(every)))
    near = materialize(bucketed(marks))
    sketch = [F.col(f"s{i}") for i in range(4)]
    marked = marks.groupBy("key").agg(*(F.min(s).alias(f"s{i}") for i, s in enumerate(sketch)))
    sides = [marked.select(F.col("key").alias(k), *(s.alias(f"{k}{i}") for i, s in enumerate(sketch))) for k in ("a", "b")]
    pairs = near.where("bucket is null").select("a", "b").distinct().join(sides[0], "a").join(sides[1], "b")
    agree = F.lit(0)
    for i in range(4):
        x = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        agree = agree + 16 - F.bit_count(x)
    likely = materialize(pairs.where(agree >= AGREEING).select("a", "b"))
    wanted = likely.select(F.col("a").alias("key")).union(likely.select(F.col("b").alias("key"))).distinct()
    sets = materialize(every.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("grams").alias("grams")))
    hot, met = hot_groups(every, threshold)
    links = verified(likely, sets, threshold).union(met)
    crowded = near.where("bucket is not null").select(F.col("bucket").alias("name"), F.col("a").alias("key"))
    if hot is None and crowded.isEmpty():
        return links.distinct()
    grouped = crowded.withColumn("hot", F.lit(None).cast("long"))
    whole = []
    if hot is not None:
        hot = materialize(hot)
        grouped = crowded.join(hot, "key", "left").select("name", "key", "hot")
        whole = [hot.select(F.col("hot").alias("name"), "key", F.lit(None).cast("long").alias("hot"))]
    for groups in [grouped, *whole]:
        groups = materialize(groups)
        held = every.join(groups.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("grams").alias("grams"))
        links = links.union(compared(groups, held, threshold))
    return links.distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs whose sets share at least `threshold` of all their shingles, counted exactly."""
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    close = shared >= threshold * (F.size("ga") + F.size("gb") - shared)
    return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")


def near_copies(
    df: DataFrame, key: str, text: Column, size: int = 5, threshold: float = 0.8, least: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (id, key), links (a, b), classes (key, component)) of near copies.

    Two texts of at least `least` words are linked if the Jaccard similarity of their distinct runs of `size` words is
    at least `threshold` and `linked` finds them; every link is checked exactly. Null ids and null texts take no part,
    nor do texts with fewer words; repeated rows of an id count once; texts of the same shingles are one key, whose
    copies are never paired here. The result doesn't depend on other columns of `df`.
    """
    every = materialize(shingled(df, key, text, size, least))
    links = materialize(linked(every, threshold))
    classes = materialize(connected_components(links))
    return every.select("id", "key").distinct(), links, classes.withColumnRenamed("node", "key")


def description() -> Column:
    """The description inside an ad's payload."""
    return F.get_json_object("data", "$.description")


def _ads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return near_copies(table(spark, folder, "opportunities"), "id", description(), size=3, threshold=0.5, least=60)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(opportunity_id_a, opportunity_id_b): all pairs of ads whose descriptions are nearly the same."""
    members, links, _ = _ads(spark, folder)
    members = materialize(members)
    a = members.select(F.col("id").alias("i"), F.col("key").alias("a"))
    b = members.select(F.col("id").alias("j"), F.col("key").alias("b"))
    copies = a.join(b, (F.col("a") == F.col("b")) & (F.col("i") < F.col("j"))).select("i", "j")
    pairs = links.join(a, "a").join(b, "b").select("i", "j").where("i != j").union(copies)
    return pairs.select(F.least("i", "j").alias("opportunity_id_a"), F.greatest("i", "j").alias("opportunity_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(opportunity_id, class_id, links): each ad with its class of near copies and its number of links; ads without any are their own class."""
    members, links, classes = _ads(spark, folder)
    members = materialize(members)
    size = members.groupBy("key").agg(F.count("*").alias("n"))
    both = links.union(links.select("b", "a")).toDF("key", "other")
    degree = both.join(size.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.sum("n").alias("d"))
    placed = members.join(classes, "key", "left").withColumn("c", F.coalesce("component", "key"))
    first = placed.groupBy("c").agg(F.min("id").alias("class_id"))
    linked_ads = placed.join(first, "c").join(size, "key").join(degree, "key", "left").select(
        "id", "class_id", (F.col("n") - 1 + F.coalesce("d", F.lit(0))).alias("links"))
    ads = table(spark, folder, "opportunities").select("id").where("id is not null").distinct()
    return ads.join(linked_ads, "id", "left").select(
        F.col("id").alias("opportunity_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
ORACLES: dict[str, str] = {}
