import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, pay
from tidemark.operators import rollup, state
from tidemark.sources import payloads

STATE = "k int, content string, first_seen bigint, last_seen bigint, closed_at bigint, missed int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_keeps_what_is_not_seen_again(spark):
    old = spark.createDataFrame([(1, "a", 1, 1, None, 0, "x"), (2, "b", 1, 1, None, 0, "y")], STATE + ", board string")
    seen = spark.createDataFrame([(1, "a", None), (3, "c", "z")], "k int, content string, board string")
    assert {r.k: (r.board, r.status) for r in state.upsert(old, seen, ["k"], "content", 9, keep=["board"]).collect()} == {1: ("x", "unchanged"), 2: ("y", None), 3: ("z", "new")}


def test_sources_of_known_records(spark):
    s = spark.createDataFrame([(1, 5, 5, "u"), (2, 1, 1, "v"), (None, 1, 1, "w")], "k int, first_seen bigint, seen_at bigint, url string")
    known = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(state.add_if_known(s.limit(0), s, known, ["k"])) == [(1, 5, 5, "u")]


def test_seen_again(spark):
    kept = spark.createDataFrame([(1, "a", 1, 1, 5, 2), (2, "b", 1, 1, 5, 2), (3, "c", 1, 1, None, 1)], STATE)
    sources = spark.createDataFrame([(1, "feed:x"), (2, "feed:x"), (2, "board")], "k int, source string")
    got = {r.k: (r.closed_at, r.missed, r.last_seen) for r in state.mark_seen(kept, spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), sources, ["k"], 9).collect()}
    assert got == {1: (None, 0, 9), 2: (5, 2, 1), 3: (None, 1, 1)}


def test_facts_of_other_sources_stay(spark):
    kept = spark.createDataFrame([(1, "no", "text"), (2, "no", "feed"), (3, None, None), (4, "no", "feed")], "k int, fact string, fact_source string")
    offered = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "yes"), (4, None)], "k int, fact string")
    assert rows(state.set_fact(kept, offered, ["k"], "fact")) == [(1, "no", "text"), (2, "yes", "feed"), (3, "yes", "feed"), (4, None, None)]


def test_boards(spark):
    boards = spark.createDataFrame([("a", "acme", "acme", None), ("a", "beta", "Beta Inc", True), ("a", "none", None, None)], "ats string, token string, name string, agency boolean")
    offered = spark.createDataFrame([("a", "acme", "Acme Inc", True), ("a", "beta", "Other", None), ("a", "new", None, None)], boards.schema)
    assert rows(state.upsert_boards(boards, offered, ["ats", "token"], "name", "agency")) == [("a", "acme", "Acme Inc", True), ("a", "beta", "Beta Inc", True), ("a", "new", None, None), ("a", "none", None, None)]
    kept = spark.createDataFrame([("acme", 1, None), ("beta", 2, None), ("beta", 3, 4)], "token string, k int, closed_at int")
    left, closed = state.retire(kept, boards.select("token"), offered.where("token <> 'beta'"), ["token"], 9)
    assert rows(left) == [("acme",)] and rows(closed) == [("acme", 1, None), ("beta", 2, 9), ("beta", 3, 4)]
    pending = spark.createDataFrame([("acme", 1), ("acme", 7), ("gone", 1)], "token string, k int")
    assert [r[-1] for r in rows(state.attach(pending, kept, kept, ["token", "k"], ["token"]).select("token", "k", "fate"))] == ["attach", "drop", "stand_in"]


def test_listing_and_caches(spark):
    kept = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 30, None), (4, 20, 5)], "k int, at int, closed_at int")
    judged = spark.createDataFrame([(1, True), (2, False)], "k int, passed boolean")
    sources = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (3, None)], "k int, source string")
    page = state.listing(kept, judged, sources, ["k"], [F.col("closed_at").isNull(), F.col("status") != "filtered_out"], [F.desc("at")], 5)
    assert [(r.k, r.status, r.sources) for r in page.collect()] == [(3, "not_evaluated", ""), (1, "passed", "a|b")]
    assert rows(state.replace_rows(judged, spark.createDataFrame([(2, True), (5, True)], judged.schema), ["k"])) == [(1, True), (2, True), (5, True)]
    probes = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 95, False)], "n string, at int, hit boolean")
    assert [r.n for r in state.cached(probes, "at", "hit", 100, 10).collect()] == ["a", "c"]


def test_near_reposts_meet_in_bands(spark):
    import random

    r = random.Random(4)
    prints = [r.getrandbits(63) for _ in range(20)]
    data = [(k, "c", k, (p ^ sum(1 << b for b in r.sample(range(63), n)))) for k, (p, n) in enumerate([(p, n) for p in prints for n in (0, 1, 3, 4)])]
    got = dict(rows(state.link_reposts(spark.createDataFrame(data, "id int, c string, first_seen int, f bigint"), ["c"], "id", "first_seen", "f")))
    want, root = {}, {}
    for k, _, _, f in data:
        near = [j for j, _, _, g in data[:k] if bin((f ^ g) & (2**64 - 1)).count("1") <= state.NEAR_BITS]
        root[k] = root[near[0]] if near else k
        if near:
            want[k] = root[k]
    assert got == want


def test_pay(spark):
    df = spark.createDataFrame([(90000.0, 120000.5, "USD", "per-year-salary"), (None, 30.0, None, "1 HOUR"), (5.0, None, "EUR", "piece"), (None, None, "EUR", "month"), (1.0, 2.0, "EUR", None)], "lo double, hi double, c string, p string")
    got = [(r.p and tuple(r.p), r.s) for r in df.select(pay.pay(F.col("lo"), F.col("hi"), F.col("c"), F.col("p")).alias("p")).select("p", pay.short_pay(F.col("p")).alias("s")).collect()]
    assert got == [((90000.0, 120000.5, "USD", "year", 120000.5), "90k-120k usd/year"), ((None, 30.0, "USD", "hour", 62400.0), "30 usd/hour"), (None, None), (None, None), (None, None)]
    assert [r.o for r in spark.createDataFrame([(1.0, "mi"), (2.0, "km"), (3.0, "x")], "v double, u string").select(pay.km(F.col("v"), F.col("u")).alias("o")).collect()] == [1.609344, 2.0, None]


@pytest.mark.parametrize(("text", "word", "want"), [
    ("We at Ramp build", "ramp", True), ("Ramp up fast", "ramp", False), ("Hello. Ramp up fast", "ramp", False), ("Plaid is hiring", "plaid", True), ("- Plaid's team", "plaid", True), ("the ramp is steep", "ramp", False), ("use eBay daily", "ebay", True), ("Rampart at Ramparts", "ramp", False), ("", "x", False), (None, "x", False), ("“Ramp” up", "ramp", False),
])
def test_names_of_one_word(text, word, want):
    assert names.names_word(text, word) is want


def test_mentions(spark):
    df = spark.createDataFrame([("Cobalt Harbor is here", "Cobalt Harbor Software Inc"), ("cobalt and harbor", "Cobalt Harbor Software"), ("We at Ramp", "Ramp, Inc."), (None, "Ramp"), ("x", None)], "d string, n string")
    assert [r.o for r in df.select(names.mentions_company(F.col("d"), F.col("n")).alias("o")).collect()] == [True, False, True, False, False]


def body(spark, *bodies):
    return spark.createDataFrame([(None if b is None else json.dumps(b) if not isinstance(b, str) else b,) for b in bodies], "body string")


def test_facts_of_boards(spark):
    g = {"jobs": [{"id": 7, "title": "Planner", "metadata": [{"name": "Workplace Type", "value": None}, {"name": "workplace", "value": "Hybrid"}, {"name": "Employment Type", "value": "Part-time"}]}, {"id": 8, "title": "Intern", "metadata": None}]}
    assert [tuple(r)[2:5] for r in payloads.greenhouse_facts(body(spark, g, "{", None), "body", F.lit("Acme")).collect()] == [("7", "hybrid", "part_time"), ("8", None, "internship")]
    lever = [{"id": "AB", "text": "Hand", "workplaceType": "on-site", "categories": {"commitment": "Full-time"}, "salaryRange": {"min": 10, "currency": None, "interval": "per-hour-wage"}}]
    got = payloads.lever_facts(body(spark, lever), "body", F.lit("Acme")).first()
    assert (got.board_token, got.job_id, got.work_mode, got.job_type, tuple(got.pay)) == ("Acme", "ab", "onsite", "full_time", (10.0, None, "USD", "hour", 20800.0))
    part = lambda kind, interval, low: {"compensationType": kind, "interval": interval, "currencyCode": "EUR", "minValue": low, "maxValue": None}
    ashby = {"jobs": [{"id": "X", "title": "A", "isRemote": True, "compensation": {"summaryComponents": [part("Equity", "1 YEAR", 1), part("Salary", "NONE", 2), part("Salary", "1 YEAR", None), part("Hourly", "1 HOUR", 3)]}}, {"id": "y", "title": "B", "isListed": False}]}
    got = payloads.ashby_facts(body(spark, ashby), "body", F.lit("Acme")).collect()
    assert [(r.board_token, r.job_id, r.work_mode, r.pay.low, r.pay.period) for r in got] == [("acme", "x", "remote", 3.0, "hour")]


def test_threads_names_and_forms(spark):
    titles = spark.createDataFrame([("Ask HN: Who is hiring? (May)",), ("Ask HN: Who wants?",), (None,)], "t string")
    assert [r.o for r in titles.select(payloads.is_hiring_thread(F.col("t")).alias("o")).collect()] == [True, False, False]
    assert rows(payloads.submitted(body(spark, {"submitted": [9, 8]}, "null", None, {}), "body")) == [(0, 9), (1, 8)]
    assert [r.id for r in payloads.thread_items(body(spark, {"id": 4}, "null", None), "body").collect()] == [4]
    assert [r.o for r in body(spark, {"name": "Acme"}, "{", None).select(payloads.board_name(F.col("body")).alias("o")).collect()] == ["Acme", None, None]
    item = lambda label, **kw: {"label": label, **kw}
    form = {"questions": [item(" Name ", required=True, fields=[{"type": "b", "values": [{"label": " z "}, {"label": "a"}, {"label": None}]}, {"type": "a"}]), item(""), item(None)], "location_questions": None, "compliance": [{"questions": [item("C")]}, {"questions": None}], "demographic_questions": {"questions": [item("D", type="t", answer_options=[{"label": "x"}])]}}
    got = [tuple(r) for r in payloads.job_questions(body(spark, form, {}).withColumn("job", F.lit(1)), "body").orderBy("pos").collect()]
    assert got == [(1, 0, "questions", "Name", ["a", "b"], ["a", "z"], True), (1, 3, "compliance", "C", [], [], False), (1, 4, "demographic_questions", "D", ["t"], ["x"], False)]
    feed = body(spark, [{"id": "1", "url": "u", "active": True, "company_name": " A ", "title": "T", "locations": ["x"], "date_posted": 5, "sponsorship": "Offers Sponsorship"}])
    items = payloads.feed(feed, "body")
    assert payloads.listing_postings(items, "feed:x").columns == payloads.POSTING and payloads.listing_postings(items, "feed:x").first().company_name == "A"
    assert [r.o for r in items.select(payloads.sponsorship(F.col("sponsorship")).alias("o")).collect()] == ["offered"]


def test_states_of_questions(spark):
    df = spark.createDataFrame([("a.1", "decline", 1, 1, None, 3), ("a.2", None, 3, 2, None, 1), ("a.3", None, 3, 1, "decline", 5), ("b.1", None, None, None, "always_ask", None), ("b.2", None, 0, 0, None, 7), ("b.3", None, None, None, None, 7)], "id string, policy string, items int, verified int, fallback string, w int")
    states = df.select("id", "w", rollup.state_of(F.col("policy"), F.col("items"), F.col("verified"), F.lit(2), F.col("fallback")).alias("state"))
    assert [r.state for r in states.orderBy("id").collect()] == ["declined", "answered", "suggested", "always_ask", "missing", "missing"]
    draws = spark.createDataFrame([("b.2", "a.*"), ("b.3", "a.3"), ("a.3", "a.2"), ("b.3", None)], "id string, entry string")
    assert {r.id: r.state for r in rollup.compose(states, "id", "state", draws).collect()} == {"a.1": "declined", "a.2": "answered", "a.3": "suggested", "b.1": "always_ask", "b.2": "composable", "b.3": "missing"}
    assert [r.id for r in rollup.top_missing(states, "id", "state", "w").collect()] == ["b.2", "b.3"]
    assert rollup.tally(states, "state", []).first().asDict() == {"answered": 1, "suggested": 1, "declined": 1, "always_ask": 1, "not_applicable": 0, "missing": 2, "composable": 0, "questions": 6}
    assert [r.id for r in rollup.intake(df, "id", "w").collect()] == ["a.2", "a.1", "a.3", "b.2", "b.3"]
    stored = spark.createDataFrame([("a.1",), ("z",), (None,)], "path string")
    assert rows(rollup.unknown_paths(stored, "path", df, "id")) == [("z",)]
