import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import packing
from vacantia.llm.packing import best_fit_decreasing, bounds, lower_bound, pack


def least(sizes, capacity):
    """The least number of containers, by trying everything."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = len(sizes)

    def go(i, rests):
        nonlocal best
        if len(rests) >= best:
            return
        if i == len(sizes):
            best = len(rests)
            return
        for r in sorted(set(rests)):
            if r >= sizes[i]:
                j = rests.index(r)
                go(i + 1, rests[:j] + [r - sizes[i]] + rests[j + 1 :])
        go(i + 1, [*rests, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_is_below_and_fit_above_the_least(sizes):
    at = best_fit_decreasing(sizes, 20)
    fill = {}
    for c, s in zip(at, sizes):
        fill[c] = fill.get(c, 0) + s
    assert max(fill.values()) <= 20 and lower_bound(sizes, 20) <= least(sizes, 20) <= len(fill)


def test_fullest_container_and_edges():
    assert best_fit_decreasing([], 5) == [] and lower_bound([], 5) == 0 and lower_bound([0, 0], 5) == 1
    assert best_fit_decreasing([0, 0], 5) == [0, 0] and best_fit_decreasing([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert lower_bound([6] * 5, 10) == 5 and lower_bound([4] * 5, 10) == 3


@pytest.mark.parametrize("partition", [5_000, 60])
def test_packing(spark, monkeypatch, partition):
    monkeypatch.setattr(packing, "PARTITION", partition)
    draw = random.Random(3)
    rows = [("a", 100, str(i), draw.randint(1, 70), 1) for i in range(900)] + [("b", 50, str(i), 0, 1) for i in range(5)]
    rows += [("a", 100, "big", 350, 1), ("a", 100, "even", 200, 1), ("a", 100, "fits", 100, 1), ("c", None, "x", 5, 1), ("d", 0, "y", 5, 1), (None, 10, "z", None, 1), ("a", 100, "7", 30, 1), ("a", 100, None, 30, 1)]
    df = spark.createDataFrame(rows, "source string, capacity int, id string, tokens int, grp int")
    out = pack(df)
    got = out.collect()
    fill, size = {}, {}
    for r in got:
        if r.container:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            assert fill[r.container] <= r.capacity
        size[r.source, r.id] = size.get((r.source, r.id), 0) + r.tokens
    want = {}
    for s, _, i, t, _ in rows:
        want[s, i] = want.get((s, i), 0) + (t or 0)
    assert size == want
    assert sorted(r.tokens for r in got if r.id == "big") == [50, 100, 100, 100] and len([r for r in got if r.id == "even"]) == 2
    assert {r.source for r in got if r.container is None} == {"c", "d"} and len({r.container for r in got if r.source == "b"}) == 1
    by = {r.source: r for r in bounds(out).collect()}
    assert by["a"].bound <= by["a"].containers <= 1.03 * by["a"].bound + 1
    assert sorted(map(str, pack(df).collect())) == sorted(map(str, got))
    assert pack(df.limit(0)).count() == 0


def test_partitions_that_saved_nothing_keep_their_bound():
    items = packing.pd.DataFrame([("a", 10, str(i), 1, s) for i, s in enumerate([5, 4, 4, 3, 2, 2])], columns=["source", "capacity", "id", "piece", "tokens"])
    placed = packing._pack(("a", "0.0"), items)
    again = packing._repack(("a", "1.0"), placed)
    assert set(again["bins"]) == {3} and set(again["bound"]) == {2} and set(again["grp"]) == {"a|0.0"}


def test_repeated_rows_and_null_ids_are_dealt_like_others(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 700)
    rows = [("a", 10, "same", 3)] * 20_000 + [("a", 10, None, 3)] * 10_000
    df = spark.createDataFrame(rows, "source string, capacity int, id string, tokens int").repartition(4)
    numbered = packing._copies(df)
    assert numbered.count() == 30_000 and numbered.distinct().count() == 30_000
    packed = pack(df).collect()
    fill, sizes = {}, {}
    for r in packed:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        sizes[r.container.split(".")[1]] = sizes.get(r.container.split(".")[1], 0) + 1
    assert len(packed) == 30_000 and max(fill.values()) <= 10 and len(fill) <= 10_010
    assert len(sizes) == 6 and max(sizes.values()) < 2 * packing.PARTITION
