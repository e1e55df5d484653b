from pyspark.sql import functions as F

from tidemark.operators import rollup, rules, state

STATE = "k int, content string, first_seen bigint, last_seen bigint, closed_at bigint, missed int"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1, 1, None, 1), (2, "b", 1, 1, 5, 0), (3, "c", 1, 1, None, 0), (4, None, 1, 1, None, 0)], STATE)
    seen = spark.createDataFrame([(1, "a"), (2, "b"), (4, "x"), (5, None)], "k int, content string")
    got = {r.k: (r.content, r.first_seen, r.last_seen, r.closed_at, r.missed, r.status) for r in state.upsert(old, seen, ["k"], "content", 9).collect()}
    assert got == {1: ("a", 1, 9, None, 0, "unchanged"), 2: ("b", 1, 9, None, 0, "reopened"), 3: ("c", 1, 1, None, 0, None), 4: ("x", 1, 9, None, 0, "updated"), 5: (None, 9, 9, None, 0, "new")}
    assert state.upsert(old.limit(0), seen.limit(0), ["k"], "content", 9).count() == 0


def test_misses_close_on_the_second(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, None, 0), (2, "b", 1, 1, None, 1), (3, "c", 1, 1, 4, 2), (4, "d", 1, 1, None, 1)], STATE)
    listed = spark.createDataFrame([(4,), (4,), (None,)], "k int")
    after = {r.k: (r.missed, r.closed_at) for r in state.take_misses(df, listed, ["k"], 7).collect()}
    assert after == {1: (1, None), 2: (2, 7), 3: (2, 4), 4: (0, None)}
    same = {r.k: (r.missed, r.closed_at) for r in state.take_misses(df, listed, ["k"], 7, F.lit(True)).collect()}
    assert same[1] == (0, None) and same[2] == (2, 7)


def test_sources_and_queue(spark):
    s = spark.createDataFrame([(1, 5, 5, "u"), (1, 3, 9, "v"), (2, 1, 1, None)], "k int, first_seen bigint, seen_at bigint, url string")
    assert {tuple(r) for r in state.add_sources(s.limit(0), s, ["k"]).collect()} == {(1, 3, 9, "v"), (2, 1, 1, None)}
    by = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b")], "k int, source string")
    assert [r.k for r in state.only_from(by, ["k"], "source", "a").collect()] == [2]
    t = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(r.k for r in state.insert_new(t, spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string"), ["k"]).collect()) == [1, 2]
    q = spark.createDataFrame([("a", 50, 1), ("b", None, 2), ("c", 99, 0), ("d", None, 2)], "name string, tried bigint, added bigint")
    assert [r.name for r in state.work_queue(q, "tried", "added", "name", 100, 30, 3).collect()] == ["b", "d", "a"]


def test_reposts_link_to_roots(spark):
    rows = [(1, "a", 10, 0b1111), (2, "a", 20, 0b1111), (3, "a", 30, 0b1110), (4, "a", 40, 0b111111110000), (5, "b", 50, 0b1111), (6, "a", 5, 0), (7, "a", 60, None), (8, None, 60, 0b1111)]
    df = spark.createDataFrame(rows, "id int, c string, first_seen int, f bigint")
    assert sorted(tuple(r) for r in state.link_reposts(df, ["c"], "id", "first_seen", "f").collect()) == [(2, 1), (3, 1)]


def test_reposts_of_reposts_take_their_root(spark):
    # each is three bits from the one before it and further from all others
    chain = [(k, "a", 10 * k, (1 << 3 * k) - 1) for k in range(1, 8)]
    df = spark.createDataFrame([*chain, (8, "a", 99, (1 << 21) - 1), (9, "b", 99, (1 << 6) - 1)], "id int, c string, first_seen int, f bigint")
    assert sorted(tuple(r) for r in state.link_reposts(df, ["c"], "id", "first_seen", "f").collect()) == [(k, 1) for k in range(2, 9)]
    # near two roots of its own: the earlier one
    fork = spark.createDataFrame([(1, "a", 1, 0b111), (2, "a", 2, 0b1110000000), (3, "a", 3, 0b1111000000111), (4, "a", 4, 0b1000000111)], "id int, c string, first_seen int, f bigint")
    assert sorted(tuple(r) for r in state.link_reposts(fork, ["c"], "id", "first_seen", "f").collect()) == [(4, 1)]


def test_reposts_need_the_same_place(spark, tmp_path):
    from datetime import datetime

    from tidemark.plans import reference

    text = "we build the pricing engine and keep the warehouse of all the boards running day and night"
    rows = [(1, "Acme", "Engineer", "Oslo", text, 1), (2, "ACME", "Engineer", "oslo", text, 2), (3, "Acme", "Engineer", "Bergen", text, 3), (4, "Acme", "Engineer", None, text, 4), (5, "Acme", "Engineer", None, text, 5)]
    df = spark.createDataFrame([(*r[:5], datetime(2026, 1, r[5])) for r in rows], "job_id long, company_name string, title string, location_name string, content_html string, fetched_at timestamp")
    df.write.parquet(f"{tmp_path}/greenhouse_jobs.parquet")
    assert sorted(tuple(r) for r in reference.repost_simhash(spark, str(tmp_path)).collect()) == [(2, 1), (5, 4)]


def test_changes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (2, 1, None)], "k int, t int, v string")
    assert [r.status for r in state.changes(df, ["k"], ["t"], F.col("v")).orderBy("k", "t").collect()] == ["new", "unchanged", "updated", "unchanged", "new"]


def test_tri_state(spark):
    df = spark.createDataFrame([(1, True, False), (2, None, False), (3, False, True), (4, True, None)], "k int, a boolean, b boolean")
    out = df.select("k", rules.outcome(rules.check("a", True, rules.tri(F.col("a"))), rules.check("b", False, F.when(F.col("b").isNotNull(), rules.tri(F.col("b"))), "why")).alias("o")).collect()
    assert {r.k: (r.o.passed, [c.verdict for c in r.o.checks]) for r in out} == {1: (True, ["pass", "fail"]), 2: (True, ["unknown", "fail"]), 3: (False, ["fail", "pass"]), 4: (True, ["pass"])}
    best = spark.createDataFrame([(["fail", "unknown"],), (["pass", "fail"],), ([],), (None,)], "v array<string>")
    assert [r.o for r in best.select(rules.best_of(F.col("v")).alias("o")).collect()] == ["unknown", "pass", "unknown", "unknown"]


def test_keywords_and_titles(spark):
    df = spark.createDataFrame([("ships python daily",), ("python and php",), ("rust",), (None,)], "v string")
    assert [r.o for r in df.select(rules.keywords(F.col("v"), ["python"], ["PHP"]).alias("o")).collect()] == ["pass", "fail", "fail", "unknown"]
    assert [r.o for r in df.select(rules.keywords(F.col("v"), [], []).alias("o")).collect()] == ["pass"] * 3 + ["unknown"]
    verdict, phrase = rules.titled(F.col("v"), ["python"], ["php"])
    assert [tuple(r) for r in df.select(verdict.alias("a"), phrase.alias("b")).collect()] == [("pass", "python"), ("fail", "php"), ("fail", None), ("fail", None)]
    ages = spark.createDataFrame([(0,), (86400 * 40,), (None,), (10**12,)], "s bigint")
    assert [r.o for r in ages.select(rules.fresh(F.col("s"), 86400 * 41, 30).alias("o")).collect()] == ["fail", "pass", "unknown", "pass"]


def test_prefixes_and_first_rule(spark):
    ids = spark.createDataFrame([("a.b.c",), ("a.b",), ("x",), (None,)], "id string")
    entries = spark.createDataFrame([("a.*",), ("a.b.*",), ("a.b",), ("y",), ("x",), ("x",)], "entry string")
    assert {tuple(r) for r in rollup.prefix_matches(entries, "entry", ids, "id").collect()} == {("a.*", "a.b.c"), ("a.*", "a.b"), ("a.b.*", "a.b.c"), ("a.b", "a.b"), ("x", "x")}
    listed = spark.createDataFrame([(2, "v", "late"), (1, "v", "early")], "position int, equals string, outcome string")
    got = rollup.first_rule(spark.createDataFrame([("v",), ("w",), (None,)], "x string"), "x", listed).collect()
    assert {r.x: r.outcome for r in got} == {"v": "early", "w": None, None: None}


def test_coverage(spark):
    df = spark.createDataFrame([("answered", 2, False, "s", "p"), ("missing", 3, False, "s", "p"), ("declined", 5, True, "t", "p"), ("missing", 0, False, "t", None)], "state string, w int, always boolean, s string, p string")
    got = {(r.section, r.pack, r.level): (r.questions, r.covered, r.weight, r.covered_weight) for r in rollup.coverage(df, "state", "w", F.col("always"), "s", "p").collect()}
    assert got[None, None, 3] == (4, 2, 5, 2) and got["s", None, 1] == (2, 1, 5, 2) and got["t", None, 1] == (2, 1, 0, 0)
