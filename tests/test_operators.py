from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.operators import decisions as D
from vacantia.operators import grounding as G
from vacantia.operators import lenses as L
from vacantia.operators import ranks as R
from vacantia.operators import upkeep as U
from vacantia.operators.search import Filters, matching_ads, search


def day(n, h=0):
    return datetime(2026, 9, n, h)


def test_cascade_and_tables(spark):
    j = lambda v, who: D.judgement(F.lit(v), who)
    got = spark.range(1).select(D.first_decided([j("unknown", "user"), j("drop", "rules"), j("keep", "model")], ["keep", "drop"], "unknown").alias("x"), D.first_decided([j("unknown", "a")], ["keep"], "unknown").alias("y")).first()
    assert (got.x.verdict, got.x.judge, got.y.verdict, got.y.judge) == ("drop", "rules", "unknown", None)
    flags = spark.createDataFrame([("Senior Sales Manager",), ("senior intern",), ("DIREKTØR",)], "t string").select(D.rule_flags(F.col("t"), {"senior": r"\bsenior\b", "sales": "sales", "boss": "direktør"}, {"senior": "intern"})).collect()
    assert [r[0] for r in flags] == [["senior", "sales"], [], ["boss"]]
    axis = spark.createDataFrame([([],), (["a"],), (["b", "c"],), (None,)], "l array<string>").select(D.axis(F.col("l"), ["c"], "m", "y", "n")).collect()
    assert [r[0] for r in axis] == ["m", "n", "y", "m"]
    scores = spark.createDataFrame([([(0.5, "b"), (0.4, "a")],), ([(0.62, "b"), (0.1, "a")],), ([(0.45, "b")],), ([],)], "s array<struct<score:double,name:string>>").select(D.choose(F.col("s"), 0.4, 0.6, 0.8)).collect()
    assert [r[0] for r in scores] == [["b", "a"], ["b"], [], []]


def test_ranks(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(300)] + [("b", 1, 1), (None, 1, 1), (None, 1, 2)], "k string, v int, id int")
    got = {(r.k, r.id): r.rank for r in R.running_rank(df, ["k"], ["v", "id"]).collect()}
    want = sorted([(i % 7, i) for i in range(300)])
    assert all(got["a", i] == n for n, (_, i) in enumerate(want)) and got["b", 1] == 0 and got[None, 2] == 1 and len(got) == 303
    p = R.nearest_rank(df, "k", "v", {"p50": 0.5, "p95": 0.95}).where("k = 'a'").first()
    assert (p.n, p.p50, p.p95) == (300, want[150][0], want[285][0])
    assert {r.k: r.id for r in R.latest(df, ["k"], ["id"]).collect()} == {"a": 299, "b": 1, None: 2}
    e = R.examples(df.where("k = 'a'"), ["k"], ["v"], ["id"], 3).collect()
    assert sorted((r.v, r.id) for r in e) == [(0, 0), (1, 1), (2, 2)]
    s = R.round_robin(df, "v", "id", "seed", 9).collect()
    assert len(s) == 9 and [r.split for r in sorted(s, key=lambda r: r.position)].count("holdout") == 1 and {r.v for r in s} >= {0, 1, 2, 3, 4, 5, 6}
    a = R.audit_sample(df.where("k = 'a'"), "k", F.abs(F.col("id") - 100), "id", "s", 5).collect()
    assert {r.id for r in a if r.kind == "boundary"} == {100, 99, 101} and len(a) == 5


def test_budget_and_breaker(spark):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate([50, 60, 30, 30, 5])] + [("d", 0, 500)], "k string, o int, n int")
    assert [(r.o, r.place) for r in sorted(R.within_budget(df, "k", "o", "n", 100, 3).collect(), key=lambda r: r.place)] == [(0, 1), (2, 2), (4, 3)]
    calls = [("r", i, f, c) for i, (f, c) in enumerate([(False, 200), (True, 500), (True, 500), (True, 500)])] + [("q", 0, True, 401), ("ok", 0, False, 200)]
    runs = spark.createDataFrame(calls, "run string, i int, failed boolean, code int")
    got = {r.run: (r.calls, r.failures, r.why) for r in R.first_stop(runs, "run", ["i"], "failed", F.col("code").isin(401, 402, 403), 3, 20, 0.5).collect()}
    assert got == {"r": (4, 3, "streak"), "q": (1, 1, "refused")}
    left = spark.range(1).select(R.remaining_seconds(F.lit(50), F.lit(100), F.lit(50), F.lit(10.0)), R.remaining_seconds(F.lit(5), F.lit(100), F.lit(5), F.lit(10.0))).first()
    assert tuple(left) == (10.0, None)


def test_same_ad_filters(spark):
    c = spark.createDataFrame([("m", "Mixed", None, None, day(1)), ("l", "Local energy", "x", None, day(2)), ("z", "Zed", None, None, None)], "id string, name string, description string, sectors string, last_seen timestamp")
    a = spark.createDataFrame([("1", "m", "2026-09-01", ["Milano"], '{"t":"senior"}'), ("2", "m", None, ["Roma"], '{"t":"data"}'), ("3", "l", "2026-01-01", ["Milano"], '{"t":"Data"}')], "id string, company_id string, day string, locations array<string>, data string")
    s = spark.createDataFrame([("l", "saved")], "company_id string, status string")
    seen = spark.createDataFrame([("2", "x"), ("3", "y")], "opportunity_id string, source string")
    ids = lambda f: [r.id for r in search(c, a, s, f, sources=seen).collect()]
    assert ids(Filters(location="milano", source="x")) == [] and ids(Filters(location="ROMA", source="x")) == ["m"]
    assert ids(Filters(location="mil", posted_since="2026-06-01")) == ["m"] and ids(Filters(location="roma", posted_since="2026-06-01")) == ["m"]
    assert ids(Filters(text="DATA", sort="roles")) == ["l", "m"] and ids(Filters(text="energy")) == ["l"] and ids(Filters(status="saved")) == ["l"] and ids(Filters(status="new", sort="name")) == ["m", "z"]
    assert ids(Filters(sort="recent")) == ["l", "m", "z"] and ids(Filters(sort="recent", limit=1, offset=1)) == ["m"]
    f = Filters(text="data")
    assert {tuple(r) for r in matching_ads(search(c, a, s, f), a, f).collect()} == {("m", "2"), ("l", "3")}
    with pytest.raises(ValueError, match="sort"):
        Filters(sort="x")
    with pytest.raises(ValueError, match="status"):
        Filters(status="x")


def test_closures_and_guard(spark):
    seen = spark.createDataFrame([("gone", "a", day(1)), ("again", "a", day(1)), ("again", "b", day(20)), ("old", "a", day(1)), ("undated", "a", day(1)), ("done", "a", day(1)), ("x", "b", day(1))], "id string, source string, at timestamp")
    ads = spark.createDataFrame([("gone", "c", "2026-09-18"), ("again", "c", "2026-09-18"), ("old", "c", "2026-08-20"), ("undated", "c", None), ("done", "c", "2026-09-18"), ("x", "c", None)], "id string, company_id string, day string")
    closed = spark.createDataFrame([("done",)], "id string")
    sweeps = spark.createDataFrame([("a", day(19), 72)], "source string, started timestamp, hours int")
    rows, shares = U.closures(seen, ads, closed, sweeps, 0.4)
    assert {tuple(r) for r in rows.collect()} == {("a", "gone")} and tuple(shares.first()) == ("a", 4, 1, False)
    everything = sweeps.withColumn("hours", F.lit(None).cast("int"))
    assert {r.id for r in U.closures(seen, ads, closed, everything, 0.8)[0].collect()} == {"gone", "old", "undated"}
    assert U.closures(seen, ads, closed, everything, 0.4)[0].count() == 0


def test_refresh_equals_recomputation(spark):
    inputs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id int, h string, t string")
    compute = lambda df: df.select("id", "h", F.upper("t").alias("u"))
    cache = spark.createDataFrame([(1, "a", "X"), (2, "old", "?"), (3, None, "Z"), (9, "q", "Q")], "id int, h string, u string")
    assert {r.id for r in U.stale(inputs, cache, "id", ["h"]).collect()} == {2}
    assert sorted(map(tuple, U.refresh(inputs, cache, "id", ["h"], compute).collect())) == sorted(map(tuple, compute(inputs).collect()))


def test_folds_and_identity(spark):
    rows = spark.createDataFrame([("1", "a", day(2), "short"), ("1", "b", day(1), "a much longer text"), ("2", "a", day(2), "new"), ("2", "a", day(1), "older and longer"), ("3", "a", day(1), "kept"), ("3", "a", day(2), None)], "id string, source string, at timestamp, text string")
    got = {r.id: (r.text, r.source, r.last_seen.day) for r in U.fold_payloads(rows).collect()}
    assert got == {"1": ("a much longer text", "a", 2), "2": ("new", "a", 2), "3": ("kept", "a", 2)}
    c = spark.createDataFrame([(1, "Acme", None), (2, "ACME ", "https://www.acme.example/x"), (3, "Beta", "https://a.example"), (4, "beta", "https://b.example"), (5, "Beta", None), (6, None, None)], "i int, n string, w string")
    k = {r.i: r.company for r in U.company_identity(c, "n", "w").collect()}
    assert k[1] == k[2] and len({k[3], k[4], k[5]}) == 3 and k[6] is None


def test_normalized_rows(spark):
    rows = spark.createDataFrame([({"Company": "Acme", "Job Title": "Dev", "job_url": "https://x.example/1?utm_source=q", "is_remote": "true", "min_amount": "4e4", "location": " Milan "},), ({"title": "No company"},)], "row map<string,string>")
    a, b = U.normalized(rows, "s").collect()
    assert (a.company_name, a.title, a.source_url, a.application_url, a.remote_policy, a.salary.min, a.locations, a.reason) == ("Acme", "Dev", "https://x.example/1", "https://x.example/1", "remote", 40000.0, ["Milan"], None)
    assert b.reason.startswith("company_name")


def test_lenses(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, facet string")
    lenses = {"all": lambda: rows, "none": lambda: rows.limit(0)}
    assert {tuple(r) for r in L.counts(lenses).collect()} >= {("all", "x", 2), ("all", "", 1), ("all", None, 3)}
    assert [r.id for r in L.page(lenses, "all", "x", limit=1, offset=1).collect()] == [2]
    with pytest.raises(ValueError, match="lens"):
        L.page(lenses, "other")


def test_grounding(spark):
    facts = "array<struct<field:string,text:string,key:string>>"
    df = spark.createDataFrame([([("what", "t", "S0")],), ([("x", "t", "S0")],), ([("what", " ", "S0")],), ([("what", "t", "S9")],), ([],)], f"f {facts}").withColumn("c", F.create_map(F.lit("S0"), F.lit("line")))
    assert [r[0] for r in df.select(G.facts_error(F.col("f"), F.col("c"), ["what"])).collect()] == [None, "unknown field", "fact without text", "reference that isn't in the catalog", None]
    assert df.select(G.cited(F.col("f"), F.col("c"))).first()[0][0].quote == "line"
    v = spark.createDataFrame([("a  b", "x a b c"), ("q", "x"), ("", "x"), (None, None)], "q string, s string").select(G.verbatim(F.col("q"), F.col("s"))).collect()
    assert [r[0] for r in v] == [True, False, False, False]
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch int, id string")
    said = spark.createDataFrame([(1, "a", 0, True), (1, "a", 1, True), (1, "b", 2, True), (2, "c", 0, False), (2, "z", 1, True)], "batch int, id string, pos int, valid boolean")
    assert {tuple(r) for r in G.batches(asked, said).collect()} == {(1, True, 0, 0), (2, False, 1, 1)}


def test_employer_sentences(spark):
    from vacantia.operators.evidence import employer_sentences

    text = "<p>We build pumps. You are great.</p><p>Acme (X) is a leading provider of water. We are looking for a manufacturer. We are excited. We build pumps.</p><p>Our company provides equal opportunity.</p>"
    ads = spark.createDataFrame([("2", "c", text), ("1", "c", "We build pumps."), ("3", "d", None)], "id string, company_id string, description string")
    companies = spark.createDataFrame([("c", "Acme (X)"), ("d", None)], "id string, name string")
    got = {(r.company_id, r.text, r.id) for r in employer_sentences(ads, companies).collect()}
    assert got == {("c", "We build pumps.", "1"), ("c", "Acme (X) is a leading provider of water.", "2")}
