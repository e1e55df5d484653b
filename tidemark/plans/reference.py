"""Queries over the operators of the core, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names, text, urls
from tidemark.functions.html import links, to_text
from tidemark.operators import evidence, places, rollup, rules, state
from tidemark.session import salted_join, table

# The clock of every query that asks for an age: 2026-11-01 in seconds.
NOW = 1793491200
SQL_NORM = "lower(trim(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')))"


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def sql_norm(column: str) -> str:
    return SQL_NORM.format(column)


def sql_has(norm: str, phrase: str) -> str:
    return f"contains(' ' || {norm} || ' ', ' {phrase} ')"


PHRASES = ["payroll", "field", "machine learning", "cloud"]


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "list_feed").select("item_uuid", "title").distinct()
    return rows.select("item_uuid", text.first_phrase(text.normalize(F.col("title")), PHRASES).alias("phrase")).where("phrase IS NOT NULL")


def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", rules.keywords(text.normalize(F.col("text")), ["route planning", "container builds"], ["pricing engine"]).alias("verdict"))


def classify_first_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "greenhouse_jobs").select("job_id", "title").distinct()
    return rows.select("job_id", text.job_type(F.col("title")).alias("job_type"))


def work_modes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lever_postings").groupBy("workplace_type").count().select("workplace_type", text.work_mode(F.col("workplace_type")).alias("mode"), F.col("count").alias("n"))


def labels_normalized(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "lever_postings").select(F.explode("lists").alias("l"))
    return lists.groupBy(text.normalize_label(F.col("l.heading")).alias("label")).agg(F.count("*").alias("n"))


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "list_feed").groupBy(rules.fresh(seconds("fetched_at"), NOW, 30).alias("verdict")).agg(F.count("*").alias("n"))


COORDINATES = [(k, float(((k * 37) % 160) - 80), float(((k * 53) % 340) - 170)) for k in range(25)]


def distance_filter(spark: SparkSession, sf: str) -> DataFrame:
    points = spark.createDataFrame(COORDINATES, "n_nationkey int, lat double, lon double")
    near = table(spark, sf, "nation").join(F.broadcast(points), "n_nationkey")
    return near.select("n_nationkey", "n_name", F.round(text.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.col("lat"), F.col("lon")), 3).alias("km")).where("km <= 9000")


def tri_state_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    segment = rules.check("segment", True, F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None)).otherwise(rules.tri(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))), F.col("c_mktsegment"))
    balance = rules.check("balance", False, rules.tri(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") >= 1000)))
    nation = rules.check("nation", True, rules.tri(F.col("n_regionkey") != 2))
    judged = c.select("c_custkey", rules.outcome(segment, balance, nation).alias("o"))
    return judged.select("c_custkey", F.col("o.passed").alias("passed"), F.array_join(F.transform("o.checks", lambda x: F.concat_ws(":", x["name"], x["verdict"])), ",").alias("checks"))


def best_verdict(spark: SparkSession, sf: str) -> DataFrame:
    verdict = rules.rank(F.when(F.col("l_tax") > 0.06, "unknown").when(F.col("l_discount") >= 0.09, "pass").otherwise("fail"))
    best = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(verdict).alias("r"))
    return best.select("l_orderkey", F.get(F.array(*map(F.lit, rules.VERDICTS)), (F.col("r") - 1).cast("int")).alias("verdict"))


def listing_topk(spark: SparkSession, sf: str) -> DataFrame:
    # a listing is a report of its first page: the limit is the feature
    jobs = table(spark, sf, "posting_snapshots").where("closed_at IS NULL").groupBy("board_token", "job_id").agg(F.max("first_seen").alias("first_seen"), F.max("title").alias("title"))
    boards = table(spark, sf, "companies").where("ats = 'greenhouse'").select("board_token", "entry_name")
    return jobs.join(boards, "board_token", "left").orderBy(F.col("first_seen").desc_nulls_last(), F.desc("job_id")).limit(50).select("job_id", "title", "entry_name", "first_seen")


def ordered_group_concat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


def sole_source_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Company names that comments state and neither the feed nor the board list has."""
    named = [table(spark, sf, t).select(F.lower(F.trim(F.col(c))).alias("name"), F.lit(t).alias("source")) for t, c in (("leads", "company"), ("list_feed", "company_name"), ("companies", "entry_name"))]
    return state.only_from(named[0].unionByName(named[1]).unionByName(named[2]).where("name IS NOT NULL"), ["name"], "source", "leads")


def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().orderBy("source")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of each item, and what the newest 30 days add to it."""
    rows = table(spark, sf, "list_feed").select("item_uuid", seconds("fetched_at").alias("first_seen"), seconds("fetched_at").alias("seen_at"), "url")
    new_from = (rows.agg(F.max("seen_at")).first()[0] or 0) - 30 * 86400
    old = F.coalesce(F.col("seen_at") < new_from, F.lit(False))
    known = state.add_sources(rows.where("false"), rows.where(old), ["item_uuid"])
    return state.add_sources(known.select(rows.columns), rows.where(~old), ["item_uuid"])


def change_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return state.changes(rows, ["user_id"], ["ts", "event_id"], F.col("event_type")).groupBy("user_id", "status").agg(F.count("*").alias("n"))


def miss_close(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that two deliveries of their board in a row left out: how often each job was closed so."""
    rows = table(spark, sf, "posting_snapshots").where("snapshot_no IS NOT NULL AND board_token IS NOT NULL")
    along = Window.partitionBy("board_token").orderBy("snapshot_no")
    numbers = rows.select("board_token", "snapshot_no").distinct().withColumn("n", F.row_number().over(along))
    last = numbers.groupBy("board_token").agg(F.max("n").alias("last"))
    seen = rows.where("job_id IS NOT NULL").select("board_token", "snapshot_no", "job_id").distinct().join(numbers, ["board_token", "snapshot_no"])
    gaps = seen.withColumn("next", F.lead("n").over(Window.partitionBy("board_token", "job_id").orderBy("n"))).join(last, "board_token")
    closed = F.coalesce("next", F.col("last") + 1) - F.col("n") - 1 >= state.MISSES
    return gaps.groupBy("board_token", "job_id").agg(F.count_if(closed).alias("closed"))


def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    names_seen = table(spark, sf, "leads").where("company IS NOT NULL").groupBy("company").agg(F.min("lead_id").alias("added_at"))
    tried = table(spark, sf, "companies").groupBy(F.col("entry_name").alias("company")).agg((F.lit(NOW) - F.max("company_id") * 86400).alias("tried_at"))
    return state.work_queue(names_seen.join(tried, "company", "left"), "tried_at", "added_at", "company", NOW, 30 * 86400, 200).select("company", "added_at")


def repost_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose words an earlier one of their source has; a much copied text is spread over the salts."""
    key = F.md5(F.concat_ws("\x1f", F.coalesce("source", F.lit("\x1e")), text.normalize(F.col("text"))))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", key.alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    return salted_join(docs, first, ["key"], F.col("doc_id"), how="inner").where("doc_id <> root").select("doc_id", "root")


def _repost_keys(jobs: DataFrame, *columns: Column) -> DataFrame:
    keys = [text.normalize(c).alias(n) for n, c in (("c", F.col("company_name")), ("t", F.col("title")), ("l", F.coalesce("location_name", F.lit(""))))]
    return jobs.select(*columns, *keys, text.simhash(text.normalize(to_text(F.col("content_html"), escaped=True))).alias("f")).where("c IS NOT NULL AND t IS NOT NULL")


def repost_simhash(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "greenhouse_jobs").where("job_id IS NOT NULL AND fetched_at IS NOT NULL").groupBy("job_id").agg(F.max(F.struct("fetched_at", "company_name", "title", "location_name", "content_html")).alias("r"), F.min("fetched_at").alias("first_seen"))
    keyed = _repost_keys(jobs.select("job_id", "first_seen", "r.*"), F.col("job_id"), F.col("first_seen"))
    return state.link_reposts(keyed, ["c", "t", "l"], "job_id", "first_seen", "f")


def repost_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Every fetch of a text that had been there before, under the same company, title and place; the earliest is the root."""
    jobs = table(spark, sf, "greenhouse_jobs").where("job_id IS NOT NULL AND fetched_at IS NOT NULL")
    at = seconds("fetched_at")
    fetched = _repost_keys(jobs, F.concat_ws("@", "job_id", at).alias("row_id"), at.alias("first_seen"))
    return state.link_reposts(fetched.distinct(), ["c", "t", "l"], "row_id", "first_seen", "f")


def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "P", "declined").otherwise("missing")
    orders = table(spark, sf, "orders").select(status.alias("state"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5 + 1).alias("w"), "o_orderpriority", F.concat(F.lit("pack"), (F.col("o_custkey") % 3).cast("string")).alias("pack"))
    out = rollup.coverage(orders, "state", "w", F.col("o_orderpriority") == "5-LOW", "o_orderpriority", "pack")
    return out.select("section", "pack", "level", "questions", "covered", "weight", "covered_weight", F.round("share", 6).alias("share"))


RULES = [(1, "BUILDING", "first"), (2, "AUTOMOBILE", "second"), (3, "BUILDING", "third"), (4, "MACHINERY", "fourth")]


def derive_first_rule(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "position int, equals string, outcome string")
    return rollup.first_rule(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", listed).groupBy("outcome").agg(F.count("*").alias("n"))


def theta_fanout(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "companies").select(F.concat_ws(".", "ats", "time_zone", F.col("company_id").cast("string")).alias("id"))
    entries = ids.select(F.explode(F.array(F.concat(F.substring_index("id", ".", 1), F.lit(".*")), F.concat(F.substring_index("id", ".", 2), F.lit(".*")), F.col("id"))).alias("entry")).distinct()
    return rollup.prefix_matches(entries, "entry", ids, "id").groupBy("entry").agg(F.count("*").alias("n"))


def harvest_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lever_postings").select("board_token", "posting_id", F.posexplode("lists").alias("pos", "l"))
    order = F.struct("posting_id", "pos")
    return rollup.harvest(rows, F.lit("lever"), F.col("l.heading"), text.normalize_label(F.col("l.heading")), order, F.col("board_token"), F.col("posting_id"))


def json_fact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL")


def url_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "list_feed").select("item_uuid", "url").distinct().select("item_uuid", urls.clean_url(F.col("url")).alias("url"))


def url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "greenhouse_jobs").select(F.col("absolute_url").alias("url")).union(table(spark, sf, "lever_postings").select("hosted_url")).union(table(spark, sf, "ashby_jobs").select("job_url")).union(table(spark, sf, "list_feed").select("url"))
    return rows.distinct().select("url", urls.resolve(F.col("url")).alias("r")).groupBy("r.kind", "r.ats").agg(F.count("*").alias("n"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "greenhouse_jobs").select("job_id", "content_html").distinct()
    return jobs.select("job_id", to_text(F.col("content_html"), escaped=True).alias("text"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "hn_items").where("text IS NOT NULL").select("item_id", "text").distinct()
    return items.select("item_id", F.posexplode(links(F.col("text"))).alias("pos", "url"))


def required_years(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", evidence.required_years(F.col("text")).alias("y"))
    return docs.where("y.years IS NOT NULL").select("doc_id", F.col("y.years").alias("years"), F.col("y.preferred").alias("preferred"))


def location_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lever_postings").select(F.col("categories.location_name").alias("location")).where("location IS NOT NULL").groupBy("location").agg(F.count("*").alias("n"))
    entries = rows.select("location", F.posexplode(places.locations(F.col("location"))).alias("pos", "e"))
    return entries.select("location", "pos", F.array_join("e.modes", ",").alias("modes"), F.col("e.anywhere").alias("anywhere"), F.array_join("e.parts", "|").alias("parts"))


def name_slugs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "companies").select("entry_name").distinct()
    return rows.select("entry_name", F.array_join(names.name_words(F.col("entry_name")), " ").alias("words"), F.array_join(names.slug_variants(F.col("entry_name")), ",").alias("slugs"))


def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "list_feed").where("active AND coalesce(is_visible, true)").select("item_uuid", "sponsorship").distinct()
    return rows.groupBy("sponsorship").agg(F.count("*").alias("n"))


def board_postings(spark: SparkSession, sf: str) -> DataFrame:
    """One schema over the three boards' records."""
    g = table(spark, sf, "greenhouse_jobs").select(F.lit("greenhouse").alias("ats"), "board_token", F.col("job_id").cast("string").alias("job_id"), "title", F.col("absolute_url").alias("url"))
    lever = table(spark, sf, "lever_postings").select(F.lit("lever").alias("ats"), "board_token", F.lower("posting_id").alias("job_id"), "title", F.col("hosted_url").alias("url"))
    a = table(spark, sf, "ashby_jobs").where("coalesce(is_listed, true)").select(F.lit("ashby").alias("ats"), "board_token", F.col("job_uuid").alias("job_id"), "title", F.col("job_url").alias("url"))
    return g.unionByName(lever).unionByName(a).distinct()


def _sql_first(norm: str, rules_: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {sql_has(norm, p)} THEN '{k}'" for p, k in rules_) + " END"


_COORDS = ", ".join(f"({k}, {a}, {b})" for k, a, b in COORDINATES)
_RULES = ", ".join(f"({p}, '{e}', '{o}')" for p, e, o in RULES)
_HOST_ATS = " ".join(f"WHEN h = '{h}' THEN '{a}'" for h, a in urls.BOARD_HOSTS.items())
_LEGAL = "|".join(names.LEGAL_FORMS)

SQL = {
    "phrase_match": f"SELECT item_uuid, phrase FROM (SELECT item_uuid, {_sql_first('t', [(p, p) for p in PHRASES])} AS phrase FROM (SELECT DISTINCT item_uuid, title, {sql_norm('title')} AS t FROM list_feed)) WHERE phrase IS NOT NULL",
    "keyword_filter": f"SELECT doc_id, CASE WHEN t IS NULL THEN 'unknown' WHEN {sql_has('t', 'pricing engine')} THEN 'fail' WHEN {sql_has('t', 'route planning')} OR {sql_has('t', 'container builds')} THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT doc_id, {sql_norm('text')} AS t FROM documents)",
    "classify_first_match": f"SELECT job_id, {_sql_first('t', text.JOB_TYPES)} AS job_type FROM (SELECT DISTINCT job_id, title, {sql_norm('title')} AS t FROM greenhouse_jobs)",
    "work_modes": f"SELECT workplace_type, CASE replace({sql_norm('workplace_type')}, ' ', '') {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in text.WORK_MODES.items())} END AS mode, n FROM (SELECT workplace_type, count(*) AS n FROM lever_postings GROUP BY 1)",
    "labels_normalized": "SELECT rtrim(regexp_replace(trim(regexp_replace(lower(l.heading), '\\s+', ' ', 'g')), '[*: ]+$', '')) AS label, count(*) AS n FROM (SELECT unnest(lists) AS l FROM lever_postings) GROUP BY 1",
    "freshness": f"SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 30 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n FROM (SELECT CASE WHEN fetched_at IS NULL THEN NULL ELSE floor(greatest(0, {NOW} - floor(epoch(fetched_at))) / 86400) END AS age FROM list_feed) GROUP BY 1",
    "distance_filter": f"SELECT * FROM (SELECT n_nationkey, n_name, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(37.7749)) / 2), 2) + cos(radians(37.7749)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-122.4194)) / 2), 2)))), 3) AS km FROM nation JOIN (VALUES {_COORDS}) AS c(k, lat, lon) ON k = n_nationkey) WHERE km <= 9000",
    "tri_state_checks": "SELECT c_custkey, NOT (coalesce(s = 'fail', false) OR n = 'fail') AS passed, concat_ws(',', 'segment:' || s, 'balance:' || b, 'nation:' || n) AS checks FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment IS NULL THEN 'unknown' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'pass' ELSE 'fail' END AS s, CASE WHEN c_acctbal >= 1000 THEN 'pass' WHEN c_acctbal >= 0 THEN 'fail' ELSE 'unknown' END AS b, CASE WHEN n_regionkey IS NULL THEN 'unknown' WHEN n_regionkey <> 2 THEN 'pass' ELSE 'fail' END AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)",
    "best_verdict": "SELECT l_orderkey, CASE max(CASE WHEN l_tax > 0.06 THEN 2 WHEN l_discount >= 0.09 THEN 3 ELSE 1 END) WHEN 3 THEN 'pass' WHEN 2 THEN 'unknown' ELSE 'fail' END AS verdict FROM lineitem GROUP BY 1",
    "listing_topk": "SELECT job_id, title, entry_name, first_seen FROM (SELECT board_token, job_id, max(first_seen) AS first_seen, max(title) AS title FROM posting_snapshots WHERE closed_at IS NULL GROUP BY 1, 2) LEFT JOIN (SELECT board_token, entry_name FROM companies WHERE ats = 'greenhouse') USING (board_token) ORDER BY first_seen DESC NULLS LAST, job_id DESC LIMIT 50",
    "ordered_group_concat": "SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1",
    "sole_source_anti": "SELECT DISTINCT lower(trim(company)) AS name FROM leads WHERE company IS NOT NULL AND lower(trim(company)) NOT IN (SELECT lower(trim(company_name)) FROM list_feed WHERE company_name IS NOT NULL UNION SELECT lower(trim(entry_name)) FROM companies WHERE entry_name IS NOT NULL)",
    "distinct_sorted": "SELECT DISTINCT source FROM documents ORDER BY source",
    "upsert_latest": "SELECT item_uuid, min(s) AS first_seen, max(s) AS seen_at, max_by(url, (s, url)) AS url FROM (SELECT item_uuid, url, CAST(floor(epoch(fetched_at)) AS BIGINT) AS s FROM list_feed) GROUP BY 1",
    "change_status": "SELECT user_id, status, count(*) AS n FROM (SELECT user_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 'unchanged' ELSE 'updated' END AS status FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1, 2",
    "miss_close": "WITH d AS (SELECT board_token, snapshot_no, row_number() OVER (PARTITION BY board_token ORDER BY snapshot_no) AS n FROM (SELECT DISTINCT board_token, snapshot_no FROM posting_snapshots)), l AS (SELECT board_token, max(n) AS last FROM d GROUP BY 1), s AS (SELECT DISTINCT board_token, job_id, n FROM posting_snapshots JOIN d USING (board_token, snapshot_no) WHERE job_id IS NOT NULL) SELECT board_token, job_id, count(*) FILTER (WHERE coalesce(nx, last + 1) - n - 1 >= 2) AS closed FROM (SELECT *, lead(n) OVER (PARTITION BY board_token, job_id ORDER BY n) AS nx FROM s) JOIN l USING (board_token) GROUP BY 1, 2",
    "work_queue": f"WITH q AS (SELECT company, min(lead_id) AS added_at FROM leads WHERE company IS NOT NULL GROUP BY 1), t AS (SELECT entry_name AS company, {NOW} - max(company_id) * 86400 AS tried_at FROM companies GROUP BY 1) SELECT company, added_at FROM q LEFT JOIN t USING (company) WHERE tried_at IS NULL OR tried_at < {NOW} - 2592000 ORDER BY tried_at IS NOT NULL, added_at, company LIMIT 200",
    "repost_exact": f"WITH d AS (SELECT doc_id, source, md5({sql_norm('text')}) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS root FROM d WHERE h IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, root FROM d JOIN f ON d.h = f.h AND d.source IS NOT DISTINCT FROM f.source WHERE doc_id <> root",
    "coverage_rollup": "WITH r AS (SELECT o_orderpriority AS section, 'pack' || (o_custkey % 3) AS pack, o_orderkey % 5 + 1 AS w, o_orderstatus IN ('F', 'P') AS c, o_orderpriority = '5-LOW' AS a FROM orders) SELECT section, pack, CAST(grouping(section, pack) AS BIGINT) AS level, count(*) AS questions, count(*) FILTER (WHERE c) AS covered, CAST(sum(CASE WHEN a THEN 0 ELSE w END) AS BIGINT) AS weight, CAST(sum(CASE WHEN c AND NOT a THEN w ELSE 0 END) AS BIGINT) AS covered_weight, round(CASE WHEN sum(CASE WHEN a THEN 0 ELSE w END) = 0 THEN NULL ELSE sum(CASE WHEN c AND NOT a THEN w ELSE 0 END) / sum(CASE WHEN a THEN 0 ELSE w END) END, 6) AS share FROM r GROUP BY GROUPING SETS ((), (section), (pack))",
    "derive_first_rule": f"WITH r AS (SELECT equals, min_by(outcome, position) AS outcome FROM (VALUES {_RULES}) AS v(position, equals, outcome) GROUP BY 1) SELECT outcome, count(*) AS n FROM customer LEFT JOIN r ON c_mktsegment = equals GROUP BY 1",
    "theta_fanout": "WITH i AS (SELECT ats || '.' || time_zone || '.' || company_id AS id FROM companies), e AS (SELECT DISTINCT unnest([split_part(id, '.', 1) || '.*', split_part(id, '.', 1) || '.' || split_part(id, '.', 2) || '.*', id]) AS entry FROM i) SELECT entry, count(*) AS n FROM e JOIN i ON id = entry OR (entry LIKE '%.*' AND starts_with(id, left(entry, length(entry) - 1))) GROUP BY 1",
    "harvest_labels": "WITH r AS (SELECT board_token, posting_id, unnest(lists) AS l, generate_subscripts(lists, 1) AS pos FROM lever_postings), n AS (SELECT *, rtrim(regexp_replace(trim(regexp_replace(lower(l.heading), '\\s+', ' ', 'g')), '[*: ]+$', '')) AS norm FROM r) SELECT 'lever' AS \"group\", norm AS normalized, min_by(l.heading, (posting_id, pos)) AS first_label, count(DISTINCT board_token) AS boards, count(DISTINCT CASE WHEN board_token IS NOT NULL AND posting_id IS NOT NULL THEN (board_token, posting_id) END) AS records FROM n WHERE norm <> '' GROUP BY norm",
    "json_fact": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "url_clean": "WITH u AS (SELECT DISTINCT item_uuid, url, split_part(split_part(url, '#', 1), '?', 1) AS base, CASE WHEN contains(split_part(url, '#', 1), '?') THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS q FROM list_feed), k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN (" + ", ".join(f"'{t}'" for t in urls.TRACKING) + ")), '&') AS kept FROM u) SELECT item_uuid, CASE WHEN regexp_matches(base, '^https?://[^/]+') THEN lower(regexp_extract(base, '^https?://[^/]+')) || CASE WHEN regexp_full_match(base, 'https?://[^/]+') THEN '/' ELSE regexp_replace(base, '^https?://[^/]+', '') END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url FROM k",
    "html_links": "SELECT item_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, replace(replace(replace(unnest(u), '&#x2F;', '/'), '&#x27;', ''''), '&amp;', '&') AS url FROM (SELECT item_id, regexp_extract_all(text, '<a href=\"([^\"]*)\"', 1) AS u FROM (SELECT DISTINCT item_id, text FROM hn_items WHERE text IS NOT NULL))",
    "feed_items": "SELECT sponsorship, count(*) AS n FROM (SELECT DISTINCT item_uuid, sponsorship FROM list_feed WHERE active AND coalesce(is_visible, true)) GROUP BY 1",
    "board_postings": "SELECT DISTINCT * FROM (SELECT 'greenhouse' AS ats, board_token, CAST(job_id AS VARCHAR) AS job_id, title, absolute_url AS url FROM greenhouse_jobs UNION ALL SELECT 'lever', board_token, lower(posting_id), title, hosted_url FROM lever_postings UNION ALL SELECT 'ashby', board_token, job_uuid, title, job_url FROM ashby_jobs WHERE coalesce(is_listed, true))",
    "name_slugs": f"WITH w AS (SELECT DISTINCT entry_name, regexp_replace(regexp_replace({sql_norm('entry_name')}, '^the( |$)', ''), '( ({_LEGAL}))+$', '') AS words FROM companies) SELECT entry_name, words, CASE WHEN words IS NULL THEN NULL ELSE array_to_string(list_filter(CASE WHEN replace(words, ' ', '') = replace(words, ' ', '-') THEN [replace(words, ' ', '')] ELSE [replace(words, ' ', ''), replace(words, ' ', '-')] END, lambda s: regexp_full_match(s, '[\\x00-\\x7F]{{2,60}}')), ',') END AS slugs FROM w",
    "p3_found": "WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, board_token, job_id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST) AS k FROM posting_snapshots) WHERE k = 1), b AS (SELECT board_token, snapshot_no, lag(snapshot_no) OVER (PARTITION BY board_token ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT board_token, snapshot_no FROM posting_snapshots)), c AS (SELECT b.prev, d.* FROM b JOIN d USING (board_token, snapshot_no) WHERE b.prev IS NOT NULL), p AS (SELECT b.snapshot_no AS at, d.* FROM b JOIN d ON d.board_token = b.board_token AND d.snapshot_no = b.prev) SELECT coalesce(c.snapshot_no, p.at) AS snapshot_no, coalesce(c.board_token, p.board_token) AS board_token, coalesce(c.job_id, p.job_id) AS job_id, CASE WHEN p.job_id IS NULL THEN 'added' WHEN c.job_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM c FULL JOIN p ON c.board_token = p.board_token AND c.snapshot_no = p.at AND c.job_id = p.job_id WHERE c.job_id IS NULL OR p.job_id IS NULL OR (c.company_name, c.title, c.url, c.location_raw, c.closed_at, c.duplicate_of) IS DISTINCT FROM (p.company_name, p.title, p.url, p.location_raw, p.closed_at, p.duplicate_of)",
}

_WEB = "regexp_matches(url, '^(?i)https?://[^/?#]+')"
_H = "lower(regexp_replace(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_PATH = "list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_QUERY_OF = "regexp_extract(url, '[?&]{}=([^&#]*)', 1)"
_TOKEN, _DIGITS, _UUID = (p.strip("^$").replace("?:", "") for p in (urls.TOKEN, urls.DIGITS, urls.UUID))
# entities of markup, the ampersand last
_DECODED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_BLOCK_TAGS = "p|br|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote|pre"
_STRIPPED = f"regexp_replace(regexp_replace({_DECODED.format('content_html')}, '</?({_BLOCK_TAGS})\\b[^>]*>', chr(10), 'gi'), '</?[A-Za-z][^>]*>', '', 'g')"
_NUMBER = r"\d{1,2}\s*(?:\+|plus\b)?\s*(?:(?:-|–|to\b)\s*\d{1,2}\s*)?\+?\s*"
_SOFT = r"(over|more\s+than|nearly|almost)"
SQL |= {
    "url_resolve": f"WITH u AS (SELECT absolute_url AS url FROM greenhouse_jobs UNION SELECT hosted_url FROM lever_postings UNION SELECT job_url FROM ashby_jobs UNION SELECT url FROM list_feed), p AS (SELECT url, {_WEB} AS web, CASE {_HOST_ATS.replace('h =', _H + ' =')} END AS a, {_PATH} AS s, {_QUERY_OF.format('gh_jid')} AS jid, {_QUERY_OF.format('for')} AS f, {_QUERY_OF.format('token')} AS tok FROM u), "
    f"r AS (SELECT *, coalesce(a = 'greenhouse' AND s[1] = 'embed', false) AS e FROM p), q AS (SELECT *, CASE WHEN e THEN f ELSE s[1] END AS b, CASE WHEN e THEN tok WHEN a = 'greenhouse' THEN CASE WHEN s[2] = 'jobs' THEN s[3] END ELSE s[2] END AS j FROM r), "
    f"k AS (SELECT CASE WHEN NOT web THEN NULL WHEN a IS NOT NULL AND regexp_full_match(b, '{_TOKEN}') AND CASE WHEN a = 'greenhouse' THEN regexp_full_match(j, '{_DIGITS}') ELSE regexp_full_match(j, '{_UUID}') END THEN 'posting' WHEN a IS NOT NULL AND regexp_full_match(b, '{_TOKEN}') AND CASE WHEN e THEN j = '' ELSE s[2] IS NULL END THEN 'board' WHEN a IS NULL AND regexp_full_match(jid, '{_DIGITS}') THEN 'embed' ELSE 'external' END AS kind, a FROM q) SELECT kind, CASE WHEN kind IS NOT NULL THEN a END AS ats, count(*) AS n FROM k GROUP BY 1, 2",
    "html_text": f"WITH d AS (SELECT DISTINCT job_id, content_html FROM greenhouse_jobs), t AS (SELECT job_id, content_html, regexp_replace(regexp_replace({_DECODED.format('content_html')}, '</?({_BLOCK_TAGS})\\b[^>]*>', chr(10), 'gi'), '</?[A-Za-z][^>]*>', '', 'g') AS x FROM d) "
    f"SELECT job_id, CASE WHEN content_html IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(list_transform(string_split({_DECODED.format('x')}, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)), '') END AS text FROM t",
    # FNV-1a of shingles of three words by 128-bit integers, the majority of each bit, then the first earlier near row and its root
    "repost_fetches": f"WITH RECURSIVE d AS (SELECT DISTINCT job_id || '@' || CAST(floor(epoch(fetched_at)) AS BIGINT) AS row_id, CAST(floor(epoch(fetched_at)) AS BIGINT) AS first_seen, {sql_norm('company_name')} AS c, {sql_norm('title')} AS t, {sql_norm("coalesce(location_name, '')")} AS l, content_html FROM greenhouse_jobs WHERE job_id IS NOT NULL AND fetched_at IS NOT NULL AND company_name IS NOT NULL AND title IS NOT NULL AND content_html IS NOT NULL), "
    f"x AS (SELECT content_html, list_filter(string_split({sql_norm(_DECODED.format(_STRIPPED))}, ' '), lambda w: w <> '') AS w FROM (SELECT DISTINCT content_html FROM d)), s AS (SELECT content_html, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: hex(encode(array_to_string(w[i:i + 2], ' '))))) AS b FROM x WHERE len(w) > 0), "
    "h AS (SELECT content_html, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(0, len(b) // 2), lambda i: CAST('0x' || b[2 * i + 1:2 * i + 2] AS UHUGEINT))), lambda a, v: (xor(a, v) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS v FROM s), "
    "f AS (SELECT content_html, sum(CASE WHEN 2 * n > total THEN 1::HUGEINT << k::HUGEINT ELSE 0 END)::UBIGINT AS f FROM (SELECT content_html, k, sum((v >> k::UBIGINT) & 1::UBIGINT) AS n, count(*) AS total FROM h, range(64) AS r(k) GROUP BY ALL) GROUP BY 1), "
    "g AS (SELECT c, t, l, f, min((first_seen, row_id)) AS head FROM d JOIN f USING (content_html) WHERE f <> 0 GROUP BY ALL), e AS (SELECT a.c, a.t, a.l, a.head, min(b.head) AS root FROM g a JOIN g b ON a.c = b.c AND a.t = b.t AND a.l = b.l AND b.head < a.head AND bit_count(xor(a.f, b.f)::HUGEINT) <= 3 GROUP BY ALL), "
    "z AS (SELECT c, t, l, head, head AS root FROM g UNION SELECT z.c, z.t, z.l, z.head, e.root FROM z JOIN e ON z.root = e.head AND z.c = e.c AND z.t = e.t AND z.l = e.l), o AS (SELECT c, t, l, head, min(root) AS root FROM z GROUP BY ALL) "
    "SELECT row_id, root[2] AS duplicate_of FROM d JOIN f USING (content_html) JOIN g USING (c, t, l, f) JOIN o USING (c, t, l, head) WHERE root[2] <> row_id",
    "required_years": rf"WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n!?;]')) AS clause FROM documents), m AS (SELECT doc_id, clause, unnest(regexp_extract_all(clause, '(?i)(?:^|.*?\W){_NUMBER}(?:years?|yrs?)\b[’'']?(?:\s+of\b)?.{{0,60}}?\bexperience\b')) AS stretch FROM c WHERE contains(lower(clause), 'experience')), "
    rf"p AS (SELECT doc_id, clause, regexp_extract(stretch, '(?i)^(.*?)(\d{{1,2}}){_NUMBER[7:]}((?:years?|yrs?)\b.*)$', ['before', 'years', 'rest']) AS x FROM m), "
    rf"k AS (SELECT doc_id, CAST(x['years'] AS INTEGER) AS years, regexp_matches(clause, '(?i)\b({'|'.join(evidence.WISHES)})\b') AS preferred FROM p WHERE NOT regexp_matches(x['rest'], '(?i)^(years?|yrs?)\s+(old|of\s+age)\b|\b(combined|collective|cumulative)\b') AND NOT regexp_matches(x['before'], '(?i)(\bour|\bwe([’'']ve|\s+have|\s+bring|\s+boast)|^\s*with|\bfor\s+{_SOFT})\s+({_SOFT}\s+)?$')) "
    "SELECT doc_id, min_by(years, (preferred, years)) AS years, min(preferred) AS preferred FROM k GROUP BY 1",
}

_MODE_RE = "(?i)\\b(?:" + "|".join(w.replace(" ", "[ -]+") for w in sorted(places.MODE_WORDS, key=len, reverse=True)) + ")\\b"
_WORD_RE = lambda w: "(?i)\\b" + w.replace(" ", "[ -]+") + "\\b"
_MODES_OF = ", ".join(f"CASE WHEN regexp_matches(e, '{_WORD_RE(w)}') THEN '{m}' END" for w, m in places.MODE_WORDS.items() if m)
_ANYWHERE = " OR ".join(f"regexp_matches(e, '{_WORD_RE(w)}')" for w in sorted(places.ANYWHERE))
_SITE = "|".join(sorted(places.SITES, key=len, reverse=True))
SQL |= {
    "location_entries": "WITH v AS (SELECT DISTINCT categories.location_name AS location FROM lever_postings WHERE categories.location_name IS NOT NULL), s AS (SELECT location, list_filter(list_transform(regexp_split_to_array(location, '[;|\\n]| / | or '), lambda x: trim(x)), lambda x: x <> '') AS es FROM v), "
    "n AS (SELECT location, CAST(i AS INTEGER) AS pos, es[i + 1] AS e FROM s, unnest(range(len(es))) AS r(i)), "
    f"p AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(e, '{_MODE_RE}', ',', 'g'), '[,()–—•·]| - '), lambda x: trim(regexp_replace(regexp_replace(trim(x, chr(9) || ' -/:.'), '(?i)^(?:based )?in\\s+(\\S)', '\\1'), '(?i)(\\S)\\s+(?:{_SITE})$', '\\1'))) AS ps FROM n) "
    # the first of each mode in the order of the words
    f"SELECT location, pos, array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_filter([{_MODES_OF}], lambda m: m IS NOT NULL), lambda m: [m])), lambda a, m: CASE WHEN list_contains(a, m[1]) THEN a ELSE list_concat(a, m) END), ',') AS modes, {_ANYWHERE} AS anywhere, array_to_string(list_filter(ps, lambda x: x <> '' AND lower(x) NOT IN ({', '.join(repr(w) for w in sorted(places.NOTHING))})), '|') AS parts FROM p",
}

QUERIES = {f.__name__: f for f in (
    phrase_match, keyword_filter, classify_first_match, work_modes, labels_normalized, freshness, distance_filter, tri_state_checks, best_verdict, listing_topk, ordered_group_concat, sole_source_anti, distinct_sorted, upsert_latest,
    change_status, miss_close, work_queue, repost_exact, repost_simhash, repost_fetches, coverage_rollup, derive_first_rule, theta_fanout, harvest_labels, json_fact, url_clean, url_resolve, html_text, html_links, required_years, location_entries, name_slugs, feed_items, board_postings,
)}
