import json

from pyspark.sql import functions as F

from tidemark.functions import robots
from tidemark.sources import config, payloads, responses, sinks
from tidemark.streaming import events

BOARD = json.dumps({"jobs": [
    {"id": 7, "title": "Planner", "absolute_url": "u", "location": {"name": "Town"}, "content": "&lt;p&gt;One&lt;/p&gt;", "company_name": None, "first_published": None, "updated_at": "2026-01-02T03:04:05Z", "metadata": [], "more": {"x": 1}},
]})
LEVER = json.dumps([{"id": "AB", "text": "Hand", "hostedUrl": "u", "categories": {"location": "Town", "allLocations": []}, "createdAt": 1700000000123, "descriptionPlain": "Base", "lists": [{"text": "Do", "content": "<li>a<li>b"}], "additionalPlain": "End"}])
ASHBY = json.dumps({"jobs": [{"id": "x", "title": "A", "location": "Town", "secondaryLocations": [{"location": "Hill"}], "isListed": True, "publishedAt": "2026-01-02T03:04:05.678Z"}, {"id": "y", "title": "B", "isListed": False}]})
FEED = json.dumps([{"id": "1", "url": "u", "active": True}, {"id": "2", "url": "u", "active": True, "is_visible": False}, {"id": "3", "url": "u", "active": False}])


def body(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_boards(spark):
    args = ("body", F.lit("Acme"), F.lit("Acme Inc"))
    g = payloads.greenhouse(body(spark, BOARD, "{broken", '{"jobs": [{"title": "no id"}]}', None), *args).collect()
    assert [tuple(r) for r in g] == [("greenhouse", "acme", "7", "Acme Inc", "Planner", "u", ["Town"], 1767323045, "One")]
    lever = payloads.lever(body(spark, LEVER), *args).first()
    assert (lever.board_token, lever.job_id, lever.locations, lever.published_at, lever.description) == ("Acme", "ab", ["Town"], 1700000000, "Base\nDo\na\nb\nEnd")
    a = payloads.ashby(body(spark, ASHBY), *args).collect()
    assert [(r.job_id, r.locations, r.published_at) for r in a] == [("x", ["Town", "Hill"], 1767323045)]
    assert [r.id for r in payloads.feed(body(spark, FEED), "body").collect()] == ["1"]
    assert all(df.columns == payloads.POSTING for df in (payloads.greenhouse(body(spark), *args), payloads.lever(body(spark), *args), payloads.ashby(body(spark), *args)))


def test_a_bad_body_fails_alone(spark):
    good, bad = payloads.read_body(body(spark, BOARD, "{broken", None, '{"jobs": [{"id": 1}]}'), "body", payloads.GREENHOUSE, ["jobs.id", "jobs.title"])
    assert good.count() == 1 and bad.count() == 3 and {r.error for r in bad.collect()} == {"unreadable body"}


def test_leads(spark):
    texts = ["Acme &amp; Co | Remote<p>Hi <a href=\"https:&#x2F;&#x2F;a.example\">x</a>", "No bar here<p>x", "https://a.example | x", "é" * 31 + " | x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    got = {r.item_id: (r.company, r.urls) for r in payloads.thread_leads(df, "item_id", "text").collect()}
    assert got == {0: ("Acme & Co", ["https://a.example"]), 1: (None, []), 2: (None, []), 3: (None, []), 4: (None, None)}


def test_config_and_routes(spark, tmp_path):
    (tmp_path / "a.toml").write_text('x = 1\n[t]\ny = ["b"]\n')
    (tmp_path / "bad.toml").write_text("x = ")
    assert config.load_toml(tmp_path / "none.toml", {"d": 1}) == {"d": 1}
    assert [v[:7] for v in config.check_files([str(tmp_path / n) for n in ("a.toml", "bad.toml", "none.toml")]).values()] == ["valid", "invalid", "missing"]
    assert {tuple(r) for r in config.config_table(spark, [str(tmp_path / "a.toml")]).collect()} == {("a", "x", "1"), ("a", "t.y", '["b"]')}
    (tmp_path / "m.toml").write_text('[[route]]\nurl = "u"\nfile = "b.json"\netag = "e"\n[[route]]\nurl = "v"\nstatus = 500\n')
    requests = spark.createDataFrame([("u", None), ("u", "e"), ("v", None), ("w", None)], "url string, etag string")
    got = sorted((r.url, r.etag or "", r.outcome) for r in responses.respond(requests, config.routes(spark, str(tmp_path / "m.toml"))).collect())
    assert got == [("u", "", "body"), ("u", "e", "not_modified"), ("v", "", "failed"), ("w", "", "not_found")]
    config.replace_file(tmp_path / "a.toml", "x = 2\n")
    assert config.load_toml(tmp_path / "a.toml") == {"x": 2}
    jobs = spark.createDataFrame([("10",), ("9",), ("9",), ("x",), (None,)], "j string")
    assert [r.j for r in responses.lowest_ids(jobs, "j", 2).collect()] == [9, 10]
    assert [r.j for r in responses.unprocessed(jobs, spark.createDataFrame([("9",), ("10",)], "j string"), ["j"]).collect()] == ["x", None]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None)], "k int, v string").write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).withColumn("k", F.col("k") + 1), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, None)]
    assert [r.value for r in sinks.as_json(spark.read.parquet(path)).collect()] == ['{"k":2,"v":null}']


def test_gazetteer_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Town\tTown\ta,b\t1.5\t2.5\tUS\tOH\t10\nBad\tBad\t\tx\t1\tUS\tOH\t1\nFar\tFar\t\t95\t1\tUS\tOH\t1\n")
    assert [r.name for r in payloads.gazetteer(spark, str(tmp_path / "c.tsv")).collect()] == ["Town"]


def test_robots(spark):
    df = spark.createDataFrame([("/a/b",), ("/a",), ("/x.pdf",), ("/x.pdfz",), ("/",)], "p string")
    rules = [(False, "/a"), (True, "/a/"), (False, "*.pdf$"), (False, "")]
    assert [r.allowed for r in robots.allowed(df, "p", rules).collect()] == [True, False, False, True, True]
    assert [r.allowed for r in robots.allowed(df.limit(1), "p", []).collect()] == [True]
    tie = robots.allowed(df.limit(1), "p", [(False, "/a"), (True, "/a")])
    assert tie.first().allowed


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2026-01-01 00:00:01', 'a'), (1, timestamp'2026-01-01 00:00:02', 'a'), (2, timestamp'2026-01-01 01:00:00', 'b'), (null, timestamp'2026-01-01 01:00:00', 'b') AS t(id, ts, kind)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "id int, ts timestamp, kind string")
    for name, df in (("once", events.first_seen(stream, ["id"], "ts", "1 hour")), ("per_hour", events.counts(stream, "ts", "1 hour", "1 hour", ["kind"]))):
        mode = "append" if name == "once" else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2]
    assert sorted((r.kind, r.n) for r in spark.table("per_hour").collect()) == [("a", 2), ("b", 2)]
