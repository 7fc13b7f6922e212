from datetime import datetime

from pyspark.sql import functions as F

from vacantia.operators import review as W
from vacantia.operators.verdicts import DROP, KEEP, UNKNOWN


def test_answers_and_degrees(spark):
    rows = [(0.5, "a", 1.0), (1.1, "a", 0.0), (None, "a", 0.0), (float("nan"), "a", 0.0), (0.0, "c", 0.5), (0.0, None, 0.5), (1.0, "b", -0.1)]
    df = spark.createDataFrame(rows, "p double, o string, c double")
    assert [r[0] for r in df.select(W.answer_error(F.col("p"), F.col("o"), ("a", "b"), F.col("c"))).collect()] == [None, "probability", "probability", "probability", "option", "option", "confidence"]
    v = spark.createDataFrame([(DROP, True, True), (DROP, True, False), (KEEP, True, True)], "v string, d boolean, s boolean").select(W.guarded_by_degree(F.col("v"), F.col("d"), F.col("s"))).collect()
    assert [r[0] for r in v] == [UNKNOWN, DROP, KEEP]


def test_appending_twice_adds_nothing(spark):
    held = spark.createDataFrame([("a", "x", 1), (None, "z", 2)], "c string, t string, id int")
    new = spark.createDataFrame([("a", "x", 3), ("a", "y", 5), ("a", "y", 4), (None, "z", 6), (None, "w", 7)], held.schema)
    took = W.added(held, new, ["c", "t"], "id")
    assert {tuple(r) for r in took.collect()} == {("a", "y", 4), (None, "w", 7)}
    assert W.added(held.union(took), new, ["c", "t"], "id").count() == 0 and W.added(held, new.limit(0), ["c", "t"], "id").count() == 0


def test_queue_and_batches(spark):
    rows = spark.createDataFrame([(i, i * 10) for i in range(4)] + [(9, None)], "id int, size int")
    queue = W.work_queue([("role", rows), ("category", rows.limit(1))], 20).collect()
    assert sorted((r.kind, r.id, r.outcome) for r in queue) == [("category", "0", "empty"), ("role", "0", "empty"), ("role", "1", "planned"), ("role", "2", "planned"), ("role", "3", "oversized"), ("role", "9", "empty")]
    ids = spark.createDataFrame([(f"{i:03}",) for i in range(120)] + [("000",)], "id string")
    frozen = {r.id: (r.place, r.batch) for r in W.frozen(ids, "id", 50).collect()}
    assert len(frozen) == 120 and frozen["000"] == (0, 0) and frozen["049"] == (49, 0) and frozen["119"] == (119, 2)


def test_texts_and_sources(spark):
    pairs = [("a b", "a b"), ("a b", "ab"), (None, " "), ("", "x"), ("x", None), ("a", "b")]
    got = spark.createDataFrame(pairs, "b string, a string").select(W.reread(F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["same", "respaced", "none", "found", "lost", "differs"]
    at = lambda h: datetime(2026, 9, 2, h)
    runs = spark.createDataFrame([("x", "f", at(1), True), ("x", "g", at(9), True), ("y", "f", at(9), False)], "source string, fingerprint string, at timestamp, ok boolean")
    sources = spark.createDataFrame([("x", "f"), ("x", "g"), ("y", "f")], "source string, fingerprint string")
    assert sorted((r.source, r.due, r.last is None) for r in W.due(runs, sources, F.lit(at(10)), 5).collect()) == [("x", False, False), ("x", True, False), ("y", True, True)]
    texts = spark.createDataFrame([("c", "a  b", "s2", 2), ("c", "a b", "s1", 3), ("c", " ", "s", 1), (None, "x", "s", 1), ("c", None, "s", 1)], "c string, t string, s string, k int")
    assert [(r.s, r.k, r.copies) for r in W.provenance(texts, "c", "t", "s", "k").collect()] == [("s1", 3, 2)]


def test_shortlist_and_versions(spark):
    tiers = spark.createDataFrame([("a", "A", 1), ("b", "A", 3), ("c", "B-attesa", 0), ("d", "scarto", 9)], "id string, tier string, keeps int")
    assert [r.id for r in W.shortlist(tiers, ("B-attesa", "A"), 500).collect()] == ["c", "b", "a"] and W.shortlist(tiers, ("A",), 1, 1).first().id == "a"
    key = lambda df: W.version(df, "t", "id", "tier").first().version
    assert key(tiers) == key(tiers.orderBy("keeps").repartition(3)) != key(tiers.where("id <> 'd'")) and len(key(tiers)) == 32
