import json

from pyspark.sql import functions as F

from vacantia.sources import boards as B
from vacantia.sources import files
from vacantia.streaming.deliveries import current, fold_into, read_observations, windowed_counts


def rows_of(spark, board, body, slug="acme", base="https://acme.example/site"):
    df = spark.createDataFrame([(slug, base, body)], "slug string, base string, body string")
    return [r.asDict(recursive=True) for r in B.board_rows(df, board).collect()]


def test_json_boards(spark):
    got = rows_of(spark, "greenhouse", json.dumps({"jobs": [{
        "title": "Engineer", "absolute_url": "https://x.example/1", "content": "&lt;p&gt;Build &amp;amp; run&lt;/p&gt;", "first_published": "2026-09-18T10:00:00Z", "location": {"name": "Milan"},
        "metadata": [{"name": "Employment Type", "value": "Full"}]}]}))
    assert got == [{"slug": "acme", "title": "Engineer", "source_url": "https://x.example/1", "description": "Build & run", "posted_at": "2026-09-18", "locations": ["Milan"], "remote_policy": None, "employment_type": "Full"}]
    got = rows_of(spark, "lever", json.dumps([{"text": "Analyst", "hostedUrl": "u", "descriptionPlain": "Hello", "lists": [{"text": "You", "content": "<li>SQL</li>"}], "createdAt": 1789000000000, "workplaceType": "hybrid", "categories": {"location": "Rome", "commitment": "Part"}}]))
    assert got[0]["description"] == "Hello\n\nYou\nSQL" and got[0]["posted_at"] == "2026-09-10" and got[0]["locations"] == ["Rome"] and got[0]["remote_policy"] == "hybrid"
    got = rows_of(spark, "ashby", json.dumps({"jobs": [{"title": "A", "jobUrl": "u", "isListed": False}, {"title": "B", "jobUrl": "v", "location": "Paris", "secondaryLocations": [{"location": "Lyon"}], "isRemote": True}]}))
    assert [(r["title"], r["locations"], r["remote_policy"]) for r in got] == [("B", ["Paris", "Lyon"], "remote")]
    got = rows_of(spark, "smartrecruiters", json.dumps({"content": [{"id": "7", "name": "C", "location": {"city": "Bonn", "country": "de", "remote": True}}]}))
    assert got[0]["source_url"] == "https://jobs.smartrecruiters.com/acme/7" and got[0]["locations"] == ["Bonn, de"]
    assert rows_of(spark, "workable", "not json") == [] and rows_of(spark, "recruitee", json.dumps({"offers": []})) == []
    got = rows_of(spark, "workday", json.dumps({"jobPostings": [{"title": "D", "externalPath": "/job/1", "locationsText": "2 Locations"}, {"title": "E"}]}))
    assert [(r["source_url"], r["locations"]) for r in got] == [("https://acme.example/site/job/1", ["2 Locations"])]


def test_xml_boards(spark):
    body = "<workzag-jobs><position><id>9</id><name>Dev</name><office>Ulm</office><createdAt>2026-08-20T00:00:00</createdAt><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<b>Code</b>]]></value></jobDescription></jobDescriptions><schedule>full-time</schedule></position></workzag-jobs>"
    got = rows_of(spark, "personio", body)
    assert got[0]["source_url"] == "https://acme.jobs.personio.de/job/9" and got[0]["description"] == "Tasks\nCode" and got[0]["locations"] == ["Ulm"] and got[0]["posted_at"] == "2026-08-20"
    body = "<rss><channel><item><title>Ops</title><link>l</link><description>&lt;p&gt;Run&lt;/p&gt;</description><pubDate>Thu, 10 Sep 2026 08:00:00 +0200</pubDate><remoteStatus>Hybrid</remoteStatus></item></channel></rss>"
    got = rows_of(spark, "teamtailor", body)
    assert got[0]["posted_at"] == "2026-09-10" and got[0]["remote_policy"] == "hybrid" and got[0]["description"] == "Run" and got[0]["locations"] == []


def test_watch_list_pages_and_embedded_table(spark):
    w = spark.createDataFrame([("lever", "Acme", "b"), ("lever", "acme", "a"), ("ashby", "acme", "c"), (None, "x", "d")], "board string, slug string, company string")
    assert {tuple(r) for r in B.watch_list(w).collect()} == {("lever", "acme", "a"), ("ashby", "acme", "c")}
    p = spark.createDataFrame([("q", 0, 0, "u1", "a"), ("q", 0, 1, "u1", "b"), ("q", 1, 0, "u2", "c"), ("r", 0, 0, "u1", "d"), ("r", 1, 0, "u1", "e")], "query string, page int, pos int, url string, t string")
    rows, stops = B.paged(p, 2)
    assert {(r.query, r.url, r.t) for r in rows.collect()} == {("q", "u1", "a"), ("q", "u2", "c"), ("r", "u1", "d")}
    assert {tuple(r) for r in stops.collect()} == {("q", 2, "short_page"), ("r", 2, "no_new_urls")}
    body = {"columns": [{"id": "c1", "name": "Title"}, {"id": "c2", "name": "Tags", "choices": {"x1": {"name": "Solar"}, "x2": {"name": "Wind"}}}, {"id": "c3", "name": "Link"}],
            "rows": [{"id": "r1", "cellValuesByColumnId": {"c1": "Dev", "c2": ["x1", "x2"], "c3": {"url": "https://e.example"}, "c9": "no"}}]}
    t = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert B.embedded_rows(t).first()["row"] == {"Title": "Dev", "Tags": "Solar, Wind", "Link": "https://e.example"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"title": "X", "n": 1}, {"title": "Y", "list": ["a"]}]), encoding="utf-8")
    got = files.read_json_rows(spark, str(tmp_path / "a.json")).collect()
    assert [r.row for r in got] == [{"title": "X", "n": "1"}, {"title": "Y", "list": '["a"]'}] and got[0].observed is not None
    (tmp_path / "b.csv").write_text('title,text\nX,"line\n""two"""\n', encoding="utf-8")
    assert files.read_csv_rows(spark, str(tmp_path / "b.csv")).first()["row"] == {"title": "X", "text": 'line\n"two"'}
    c = spark.createDataFrame([("1", "=SUM(A1)", ["a", "b"], 3)], "id string, name string, locations array<string>, opportunity_count long")
    files.write_companies_csv(c, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert tuple(back.asDict()) == files.COMPANY_COLUMNS and back["name"] == "'=SUM(A1)" and back["locations"] == "a, b"
    files.write_documents_json(c, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first()["schema_version"] == "2"
    files.write_review_csv(c, str(tmp_path / "review"))
    assert spark.read.option("header", True).csv(str(tmp_path / "review")).first()["locations"] == "a | b"


def test_stream_folds_and_counts(spark, tmp_path):
    shape = "opportunity_id string, source string, source_url string, observed_at timestamp"
    one = spark.sql("select 'a' opportunity_id, ' X' source, 'u' source_url, timestamp '2026-01-02' observed_at union all select 'b', 'x', 'u', timestamp '2026-01-01'")
    two = spark.sql("select 'a' opportunity_id, 'x' source, 'u' source_url, timestamp '2026-01-01' observed_at union all select 'b', 'x', 'u', timestamp '2026-01-05'")
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for batch in (one, two):
        batch.select(*[F.col(c.split()[0]) for c in shape.split(", ")]).write.mode("append").parquet(folder)
        fold_into(read_observations(spark, folder), state, str(tmp_path / "check")).awaitTermination(120)
    assert {(r.id, r.source, str(r["at"])[:10]) for r in current(spark, state).collect()} == {("a", "x", "2026-01-02"), ("b", "x", "2026-01-05")}
    assert windowed_counts(one).count() == 2
