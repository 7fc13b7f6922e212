import pytest
from pyspark.sql import functions as F

from vacantia.operators import lenses as L
from vacantia.operators import verdicts as V
from vacantia.operators.search import Filters, matches, matching_ads, search


@pytest.fixture(scope="module")
def archive(spark):
    ads = spark.createDataFrame(
        [("1", "a", "keep", "London"), ("2", "a", "drop", "Milano"), ("3", "b", "keep", "Milano"), ("4", "b", None, "Milano"), ("5", "c", "keep", "Roma"), ("6", "d", "drop", "Roma"), ("7", "e", "keep", "Roma"), ("8", None, "keep", "Roma")],
        "id string, company_id string, said string, place string")
    said = F.when(F.col("said") == "keep", V.KEEP).when(F.col("said") == "drop", V.DROP)
    users = spark.createDataFrame([("6", V.KEEP), ("5", V.DROP), ("9", V.KEEP), ("4", None)], "id string, verdict string")
    closed = spark.createDataFrame([("7",), ("7",)], "id string")
    roles = V.role_verdicts(ads, [("rules", said)], F.col("id") == "3", [("user", users)], closed, F.col("id") == "4")
    companies = spark.createDataFrame([(x, f"Company {x}", None, None) for x in "abcdefg"], "id string, name string, description string, sectors string").withColumn("last_seen", F.lit(1))
    labels = spark.createDataFrame([("a", "Energy", 1, "rules"), ("a", "Food", 0, "hand"), ("b", "Food", 0, "rules"), ("b", "Food", 0, "rules"), ("c", "Energy", 0, "rules"), ("d", "Da classificare", 0, "rules")], "company_id string, category string, rank int, method string")
    return ads, roles, companies, labels


def test_roles(archive):
    got = {r.id: (r.verdict, r.judge, r.primary, r.closed, r.eligibility, r.phd) for r in archive[1].collect()}
    assert got["1"] == (V.KEEP, "rules", False, False, "potential", False) and got["5"] == (V.DROP, "user", False, False, "excluded", False)
    assert got["4"] == (V.UNKNOWN, None, False, False, "review", True) and got["6"][:3] == (V.KEEP, "user", True) and got["7"][3] and len(got) == 8 and got["3"][2]


def test_labels(spark, archive):
    _, _, companies, labels = archive
    got = {r.id: (r.category, r.method, r.labels) for r in V.label_summary(companies, labels).collect()}
    assert got["a"] == ("Food", "hand", ["Food", "Energy"]) and got["b"][2] == ["Food"] and got["e"] == (V.UNLABELLED, "unknown", [])
    new = spark.createDataFrame([("a", "Water", 0, "rules"), ("c", "Water", 0, "rules"), ("z", "Water", 0, "rules")], labels.schema)
    out = {(r.company_id, r.category) for r in V.replaced_labels(labels, new, "hand").collect()}
    assert out == {("a", "Energy"), ("a", "Food"), ("b", "Food"), ("c", "Water"), ("d", "Da classificare"), ("z", "Water")}


def test_tiers(archive):
    _, roles, companies, labels = archive
    tiers = {r.id: r.tier for r in V.company_tiers(V.label_summary(companies, labels), roles, ["Energy"]).collect()}
    assert tiers == {"a": "A", "b": "B-esperienza", "c": "B-attesa", "d": "B-esperienza", "e": "evidenza-mancante", "f": "evidenza-mancante", "g": "evidenza-mancante"}
    assert {r.id for r in V.qualifying(roles, "A").collect()} == {"1", "3", "6", "8"} and {r.id for r in V.qualifying(roles, "B-esperienza").collect()} == {"3", "6"}


def test_search_crosses_filters_on_the_same_ad(spark, archive):
    ads, roles, companies, labels = archive
    tiers = V.company_tiers(V.label_summary(companies, labels), roles, ["Energy"])
    rows = ads.withColumns({"day": F.lit(None).cast("string"), "locations": F.array("place"), "data": F.col("place")})
    statuses = spark.createDataFrame([("a", "saved")], "company_id string, status string")
    places = spark.createDataFrame([("1", 1, 10), ("1", 2, 20), ("5", 1, 20)], "opportunity_id string, country int, city int")
    context = {"roles": roles, "tiers": tiers, "labels": labels, "places": places}
    ids = lambda **f: sorted(r.id for r in search(companies, rows, statuses, Filters(**f), **context).collect())
    assert ids(tier="A", location="milano") == [] and ids(tier="A", location="london") == ["a"] and ids(tier="evidenza-mancante") == ["e", "f", "g"]
    assert ids(eligibility="review") == ["b"] and ids(phd=True) == ["b"] and ids(category="Energy") == ["a", "c"] and ids(category=V.UNLABELLED) == ["e", "f", "g"]
    assert ids(country=1, city=20) == ["c"] and ids(city=20) == ["a", "c"] and ids(country=2) == ["a"]
    f = Filters(tier="A")
    found = matches(companies, rows, statuses, f, **context)
    assert [tuple(r) for r in matching_ads(found, rows, f, **context).collect()] == [("a", "1")] and found.count() == 1
    for bad in ({"tier": "C"}, {"eligibility": "maybe"}):
        with pytest.raises(ValueError, match="unknown"):
            Filters(**bad)


def test_empty_archive(archive):
    ads, roles, companies, labels = (df.limit(0) for df in archive)
    assert V.company_tiers(V.label_summary(companies, labels), roles, ["Energy"]).count() == 0
    assert V.role_verdicts(ads, [("rules", F.lit(V.KEEP))], F.lit(True), [], ads.select("id")).count() == 0


def test_lenses_in_one_pass(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, f string")
    rows = df.select(F.explode(L.marked({"all": (F.lit(True), F.col("f")), "odd": (F.col("id") % 2 == 1, F.col("f")), "none": (F.lit(False), F.col("f"))})).alias("m")).select("m.*")
    assert {tuple(r) for r in L.tally([rows, rows.limit(0)]).collect()} == {("all", "x", 2), ("all", "", 1), ("all", None, 3), ("odd", "x", 1), ("odd", "", 1), ("odd", None, 2)}
