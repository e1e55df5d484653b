"""Queries that read the boards' records as the payloads they come in, and rollups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, pay, text
from tidemark.operators import rollup
from tidemark.plans.reference import _sql_first, sql_norm
from tidemark.sources import payloads
from tidemark.session import table


def _body(rows: DataFrame, payload: Column) -> DataFrame:
    """Each record as the body of a board with one job."""
    return rows.select("board_token", F.to_json(payload).alias("body"))


def _flat(facts: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"pay.{c}").alias(f"pay_{c}")
    return facts.distinct().select("board_token", "job_id", "work_mode", "job_type", *[p(c) for c in ("low", "high", "currency", "period", "ceiling")], pay.short_pay(F.col("pay")).alias("pay_text"))


def greenhouse_facts(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.transform("metadata", lambda m: F.struct(m["meta_name"].alias("name"), m["meta_value"].alias("value")))
    rows = table(spark, sf, "greenhouse_jobs").where("job_id IS NOT NULL AND title IS NOT NULL")
    job = F.struct(F.col("job_id").alias("id"), "title", meta.alias("metadata"))
    return _flat(payloads.greenhouse_facts(_body(rows, F.struct(F.array(job).alias("jobs"))), "body", F.col("board_token"))).select("board_token", "job_id", "work_mode", "job_type")


def lever_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lever_postings").where("posting_id IS NOT NULL AND title IS NOT NULL")
    salary = F.struct(*[F.col(f"salary_range.{a}").alias(b) for a, b in (("min_value", "min"), ("max_value", "max"), ("currency", "currency"), ("pay_interval", "interval"))])
    job = F.struct(F.col("posting_id").alias("id"), F.col("title").alias("text"), F.struct("categories.commitment").alias("categories"), F.col("workplace_type").alias("workplaceType"), salary.alias("salaryRange"))
    return _flat(payloads.lever_facts(_body(rows, F.array(job)), "body", F.col("board_token")))


def ashby_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ashby_jobs").where("job_uuid IS NOT NULL AND title IS NOT NULL")
    parts = F.transform("compensation_info.summary_components", lambda c: F.struct(*[c[a].alias(b) for a, b in (("compensation_type", "compensationType"), ("pay_interval", "interval"), ("currency_code", "currencyCode"), ("min_value", "minValue"), ("max_value", "maxValue"))]))
    job = F.struct(F.col("job_uuid").alias("id"), "title", F.col("is_listed").alias("isListed"), F.col("is_remote").alias("isRemote"), F.col("workplace_type").alias("workplaceType"), F.col("employment_type").alias("employmentType"), F.struct(parts.alias("summaryComponents")).alias("compensation"))
    return _flat(payloads.ashby_facts(_body(rows, F.struct(F.array(job).alias("jobs"))), "body", F.col("board_token")))


def feed_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's items read from their payload, as postings of their own."""
    rows = table(spark, sf, "list_feed").where("item_uuid IS NOT NULL AND url IS NOT NULL")
    item = F.struct(F.col("item_uuid").alias("id"), "company_name", "title", "locations", "url", "date_posted", "active", "is_visible", "sponsorship")
    read = payloads.feed(rows.select(F.to_json(F.array(item)).alias("body")), "body")
    facts = payloads.listing_postings(read, "list_feed").select("board_token", "job_id", "company_name", "title", "url", F.array_join("locations", "|").alias("locations"), "published_at", "description")
    said = read.select(F.col("id").alias("job_id"), payloads.sponsorship(F.col("sponsorship")).alias("sponsorship")).distinct()
    return facts.distinct().join(said, "job_id")


def hiring_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Threads with the comments that are theirs."""
    items = table(spark, sf, "hn_items").where("item_id IS NOT NULL")
    body = F.to_json(F.struct(F.col("item_id").alias("id"), "title", "kids", "deleted", "dead"))
    threads = payloads.thread_items(items.select(body.alias("body")), "body").where("title IS NOT NULL").select("id", "title", payloads.is_hiring_thread(F.col("title")).alias("hiring")).distinct()
    counts = items.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count_distinct("item_id").alias("comments"))
    return threads.join(counts, "id", "left").select("id", "title", "hiring", F.coalesce("comments", F.lit(0)).alias("comments"))


def board_facts_per_year(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pay per year by currency and period, before any conversion."""
    rows = table(spark, sf, "greenhouse_jobs").where("pay IS NOT NULL").select("job_id", pay.pay_period(F.col("pay.pay_period")).alias("period"), "pay.currency", F.coalesce("pay.max_value", "pay.min_value").alias("most")).distinct()
    return rows.groupBy("currency", "period").agg(F.count("*").alias("n"), F.round(F.max(pay.per_year(F.col("most"), F.col("period"))), 2).alias("most_a_year"))


def company_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a board that mention the board's company, for names of two words or more."""
    boards = table(spark, sf, "companies").select("board_token", "entry_name").distinct()
    docs = table(spark, sf, "documents").where("board_token IS NOT NULL AND text IS NOT NULL").select("doc_id", "board_token", "text").distinct()
    pairs = docs.join(boards, "board_token").where(F.size(names.name_words(F.col("entry_name"))) >= 2)
    return pairs.where(names.mentions_company(F.col("text"), F.col("entry_name"))).select("doc_id", "board_token", "entry_name")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as questions: a policy, stored lines and how many of them are verified."""
    orders = table(spark, sf, "orders").select(F.concat_ws(".", "o_orderpriority", "o_orderkey").alias("id"), "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("weight"))
    lines = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(F.col("l_linestatus") == "F").alias("verified"))
    policy = F.when(F.col("o_orderstatus") == "P", "decline")
    default = F.when(F.col("o_orderpriority") == "5-LOW", "always_ask").when(F.col("o_orderpriority") == "2-HIGH", "not_applicable")
    state = rollup.state_of(policy, F.col("items"), F.col("verified"), F.lit(2), default)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("id", "o_orderkey", "o_orderpriority", "weight", state.alias("state"))


def state_tally(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.tally(_states(spark, sf), "state", ["o_orderpriority"])


def missing_top(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.top_missing(_states(spark, sf), "id", "state", "weight")


def composed_states(spark: SparkSession, sf: str) -> DataFrame:
    """Missing questions that draw on all questions of high priority, or on one order."""
    states = _states(spark, sf)
    draws = states.select("id", F.explode(F.array(F.concat(F.col("o_orderpriority"), F.lit(".*")), F.concat(F.lit("1-URGENT."), F.col("o_orderkey") + 1))).alias("entry"))
    return rollup.tally(rollup.compose(states.select("id", "o_orderpriority", "state"), "id", "state", draws), "state", ["o_orderpriority"])


def paths_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Company names of the feed that the board list doesn't have."""
    return rollup.unknown_paths(table(spark, sf, "list_feed").select("company_name").distinct(), "company_name", table(spark, sf, "companies"), "entry_name")


def asked_first(spark: SparkSession, sf: str) -> DataFrame:
    headings = table(spark, sf, "lever_postings").select(F.posexplode("lists").alias("pos", "l")).groupBy(text.normalize_label(F.col("l.heading")).alias("label")).agg(F.min(F.when(F.col("pos") < 2, F.col("pos"))).alias("rank"))
    return rollup.intake(headings, "label", "rank")


_MODE = lambda c: f"CASE replace({sql_norm(c)}, ' ', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.WORK_MODES.items()) + " END"
_KIND = lambda c: _sql_first(sql_norm(c), text.JOB_TYPES)
_PERIOD = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), '{w}') THEN '{p}'" for w, p in pay.PERIOD_WORDS) + " END"
_FACTOR = "CASE period " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in pay.A_YEAR.items()) + " END"
_SHORT = "CASE WHEN {0} >= 1000 THEN CAST(CAST(round({0} / 1000) AS BIGINT) AS VARCHAR) || 'k' ELSE regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '') END"
_PAY_COLUMNS = f"CASE WHEN ok THEN low END AS pay_low, CASE WHEN ok THEN high END AS pay_high, CASE WHEN ok THEN coalesce(currency, 'USD') END AS pay_currency, CASE WHEN ok THEN period END AS pay_period, CASE WHEN ok THEN coalesce(high, low) * {_FACTOR} END AS pay_ceiling, CASE WHEN ok THEN lower(concat_ws('-', {_SHORT.format('low')}, {_SHORT.format('high')}) || ' ' || coalesce(currency, 'USD') || '/' || period) END AS pay_text"
_Q = "s AS (SELECT o_orderpriority || '.' || o_orderkey AS id, o_orderkey, o_orderpriority, o_totalprice AS weight, CASE WHEN o_orderstatus = 'P' THEN 'declined' WHEN verified >= 2 THEN 'answered' WHEN items > 0 THEN 'suggested' WHEN o_orderpriority = '5-LOW' THEN 'always_ask' WHEN o_orderpriority = '2-HIGH' THEN 'not_applicable' ELSE 'missing' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE l_linestatus = 'F') AS verified FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON o_orderkey = l_orderkey)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in rollup.STATES)

SQL = {
    "greenhouse_facts": f"WITH g AS (SELECT DISTINCT lower(board_token) AS board_token, CAST(job_id AS VARCHAR) AS job_id, title, list_filter(metadata, lambda m: contains(lower(m.meta_name), 'workplace') AND m.meta_value IS NOT NULL)[1].meta_value AS w, list_filter(metadata, lambda m: contains(lower(m.meta_name), 'employment type') AND m.meta_value IS NOT NULL)[1].meta_value AS e FROM greenhouse_jobs WHERE job_id IS NOT NULL AND title IS NOT NULL) SELECT DISTINCT board_token, job_id, {_MODE('w')} AS work_mode, coalesce({_KIND('e')}, {_KIND('title')}) AS job_type FROM g",
    "lever_facts": f"WITH l AS (SELECT board_token, lower(posting_id) AS job_id, {_MODE('workplace_type')} AS work_mode, coalesce({_KIND('categories.commitment')}, {_KIND('title')}) AS job_type, salary_range.min_value AS low, salary_range.max_value AS high, salary_range.currency AS currency, {_PERIOD('salary_range.pay_interval')} AS period FROM lever_postings WHERE posting_id IS NOT NULL AND title IS NOT NULL), k AS (SELECT *, coalesce(period IS NOT NULL AND (low IS NOT NULL OR high IS NOT NULL), false) AS ok FROM l) SELECT DISTINCT board_token, job_id, work_mode, job_type, {_PAY_COLUMNS} FROM k",
    "ashby_facts": f"WITH a AS (SELECT lower(board_token) AS board_token, lower(job_uuid) AS job_id, coalesce({_MODE('workplace_type')}, CASE WHEN is_remote THEN 'remote' END) AS work_mode, coalesce({_KIND('employment_type')}, {_KIND('title')}) AS job_type, list_filter(compensation_info.summary_components, lambda c: c.compensation_type IN ('Salary', 'Hourly') AND (c.min_value IS NOT NULL OR c.max_value IS NOT NULL) AND regexp_matches(lower(c.pay_interval), 'year|annual|month|week|day|hour'))[1] AS c FROM ashby_jobs WHERE job_uuid IS NOT NULL AND title IS NOT NULL AND coalesce(is_listed, true)), k AS (SELECT *, c.min_value AS low, c.max_value AS high, c.currency_code AS currency, {_PERIOD('c.pay_interval')} AS period, c IS NOT NULL AS ok FROM a) SELECT DISTINCT board_token, job_id, work_mode, job_type, {_PAY_COLUMNS} FROM k",
    "feed_postings": "SELECT DISTINCT 'list_feed' AS board_token, item_uuid AS job_id, trim(company_name) AS company_name, trim(title) AS title, url, array_to_string(locations, '|') AS locations, date_posted AS published_at, '' AS description, CASE sponsorship " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in payloads.SPONSORSHIP.items()) + " END AS sponsorship FROM list_feed WHERE item_uuid IS NOT NULL AND url IS NOT NULL AND active AND coalesce(is_visible, true)",
    "hiring_threads": f"WITH t AS (SELECT DISTINCT item_id AS id, title, starts_with(title, '{payloads.HIRING_THREAD}') AS hiring FROM hn_items WHERE title IS NOT NULL AND item_id IS NOT NULL), c AS (SELECT parent_id AS id, count(DISTINCT item_id) AS comments FROM hn_items WHERE parent_id IS NOT NULL GROUP BY 1) SELECT id, title, hiring, coalesce(comments, 0) AS comments FROM t LEFT JOIN c USING (id)",
    "board_facts_per_year": f"WITH p AS (SELECT DISTINCT job_id, {_PERIOD('pay.pay_period')} AS period, pay.currency AS currency, coalesce(pay.max_value, pay.min_value) AS most FROM greenhouse_jobs WHERE pay IS NOT NULL) SELECT currency, period, count(*) AS n, round(max(most * {_FACTOR}), 2) AS most_a_year FROM p GROUP BY 1, 2",
    "company_mentions": f"WITH w AS (SELECT DISTINCT board_token, entry_name, string_split(regexp_replace(regexp_replace({sql_norm('entry_name')}, '^the( |$)', ''), '( ({'|'.join(names.LEGAL_FORMS)}))+$', ''), ' ') AS w FROM companies) SELECT DISTINCT doc_id, board_token, entry_name FROM documents JOIN w USING (board_token) WHERE len(w) >= 2 AND contains(' ' || {sql_norm('text')} || ' ', ' ' || w[1] || ' ' || w[2] || ' ')",
    "state_tally": f"WITH {_Q} SELECT o_orderpriority, {_COUNTS}, count(*) AS questions FROM s GROUP BY 1",
    "missing_top": f"WITH {_Q} SELECT id, weight FROM s WHERE state = 'missing' ORDER BY weight DESC, id LIMIT 10",
    "composed_states": f"WITH {_Q}, a AS (SELECT DISTINCT o_orderpriority AS p FROM s WHERE state = 'answered'), u AS (SELECT id FROM s WHERE state = 'answered'), c AS (SELECT o_orderpriority, CASE WHEN state = 'missing' AND (o_orderpriority IN (SELECT p FROM a) OR '1-URGENT.' || (o_orderkey + 1) IN (SELECT id FROM u)) THEN 'composable' ELSE state END AS state FROM s) SELECT o_orderpriority, {_COUNTS}, count(*) AS questions FROM c GROUP BY 1",
    "paths_unknown": "SELECT DISTINCT company_name FROM list_feed WHERE company_name IS NOT NULL AND company_name NOT IN (SELECT entry_name FROM companies WHERE entry_name IS NOT NULL)",
    "asked_first": "WITH r AS (SELECT unnest(lists) AS l, generate_subscripts(lists, 1) - 1 AS pos FROM lever_postings), n AS (SELECT rtrim(regexp_replace(trim(regexp_replace(lower(l.heading), '\\s+', ' ', 'g')), '[*: ]+$', '')) AS label, CAST(min(pos) FILTER (WHERE pos < 2) AS INTEGER) AS rank FROM r GROUP BY 1) SELECT label, rank FROM n WHERE rank IS NOT NULL ORDER BY rank, label",
}

QUERIES = {f.__name__: f for f in (greenhouse_facts, lever_facts, ashby_facts, feed_postings, hiring_threads, board_facts_per_year, company_mentions, state_tally, missing_top, composed_states, paths_unknown, asked_first)}
