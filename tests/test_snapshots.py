from datetime import datetime

from vacantia.operators.components import connected_components
from vacantia.operators.snapshots import snapshot_changes

KINDS = "n int, k string, at timestamp, u string, h string, change string, _d string"


def day(n):
    return datetime(2026, 1, n)


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KINDS)
    return {tuple(r) for r in snapshot_changes(df, ["k"], "n", "at", ["u"], ["h"]).collect()}


def test_added_removed_changed_across_a_gap(spark):
    rows = [
        (1, "a", day(1), "x", "1"), (1, "b", day(1), "x", "1"), (1, "c", day(1), "x", None),
        (4, "a", day(2), "y", "1"), (4, "c", day(2), "x", "2"), (4, "d", day(2), "x", "1"),
    ]
    assert changes(spark, rows) == {(4, "a", "changed"), (4, "b", "removed"), (4, "d", "added")}


def test_latest_row_of_a_delivery_holds_and_repeats_count_once(spark):
    rows = [
        (1, "a", day(1), "x", "1"), (2, "a", day(3), "x", "1"), (2, "a", day(2), "z", "9"), (2, "a", day(3), "x", "1"),
    ]
    assert changes(spark, rows) == set()


def test_null_time_is_oldest_and_null_keys_are_left_out(spark):
    rows = [
        (1, "a", None, "old", "1"), (1, "a", day(1), "x", "1"), (2, "a", day(1), "x", "2"),
        (None, "a", day(1), "x", "1"), (2, None, day(1), "x", "1"), (1, "b", day(1), None, "1"), (2, "b", day(1), "", "1"),
    ]
    assert changes(spark, rows) == {(2, "a", "changed"), (2, "b", "changed")}


def test_empty_and_single_delivery(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "a", day(1), "x", "1")]) == set()


def test_components_of_chains_hubs_and_self_links(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    hub = [("z000", f"z{i:03}") for i in range(1, 30)]
    links = spark.createDataFrame(chain + hub + [("q", "q"), (None, "q"), ("n003", "n000")], "a string, b string")
    found = dict(connected_components(links).collect())
    assert {found[n] for n in found if n[0] == "n"} == {"n000"} and len(found) == 41 + 30 + 1
    assert {found[n] for n in found if n[0] == "z"} == {"z000"} and found["q"] == "q"
    assert connected_components(links.limit(0)).count() == 0
