"""Queries over the kept state of postings: all deliveries before the last one are the state, the last one is what is seen now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators import state
from tidemark.plans.reference import NOW, seconds, sql_has, sql_norm
from tidemark.session import table
from tidemark.sources.payloads import SPONSORSHIP, sponsorship

KEY = ["board_token", "job_id"]
DAY = 86400


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "posting_snapshots").where("snapshot_no IS NOT NULL AND board_token IS NOT NULL AND job_id IS NOT NULL")
    return rows.withColumn("last", F.lit(rows.agg(F.max("snapshot_no")).first()[0]).cast("int"))


def _latest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per key, of its last snapshot; repeated rows by the largest values."""
    filled = {"title": F.coalesce("title", F.lit("")), "closed_at": F.coalesce("closed_at", F.lit(-1)), "company_name": F.coalesce("company_name", F.lit("")), "url": F.coalesce("url", F.lit(""))}
    out = rows.groupBy(*KEY).agg(F.max(F.struct("snapshot_no", *[filled[c].alias(c) for c in columns])).alias("r"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"))
    return out.select(*KEY, *[F.nullif(F.col(f"r.{c}"), F.lit(-1) if c == "closed_at" else F.lit("")).alias(c) for c in columns], "first_seen", "last_seen", F.lit(0).alias("missed"))


def _state(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _latest(_rows(spark, sf).where("snapshot_no < last"), *columns)


def _seen(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _latest(_rows(spark, sf).where("snapshot_no = last"), *columns)


def posting_upsert(spark: SparkSession, sf: str) -> DataFrame:
    seen = _seen(spark, sf, "title", "company_name").select(*KEY, "title", "company_name")
    return state.upsert(_state(spark, sf, "title", "company_name", "closed_at"), seen, KEY, "title", NOW, keep=["company_name"])


def sources_known(spark: SparkSession, sf: str) -> DataFrame:
    """What earlier deliveries say of the jobs that the last one lists."""
    rows = _rows(spark, sf).select(*KEY, "snapshot_no", "last", "first_seen", F.col("first_seen").alias("seen_at"), "url")
    offered = rows.where("snapshot_no < last").drop("snapshot_no", "last")
    return state.add_if_known(offered.where("false"), offered, rows.where("snapshot_no = last"), KEY)


def board_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two polls of every board: what the last two snapshots left out closes."""
    rows = _rows(spark, sf)
    kept = _latest(rows.where("snapshot_no < last - 1"), "title", "closed_at").select(*KEY, "closed_at", "missed")
    for back in (1, 0):
        listed = rows.where(F.col("snapshot_no") == F.col("last") - back)
        polled = listed.select("board_token").distinct().withColumn("polled", F.lit(True))
        # a board that didn't deliver says nothing about its jobs
        kept = state.take_misses(kept.join(polled, "board_token", "left"), listed, KEY, NOW - back, F.col("polled").isNull()).drop("polled")
    return kept


def seen_again(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs that the last delivery lists, reopened unless their board was told apart as a source of its own."""
    rows = _rows(spark, sf)
    feeds = rows.groupBy(*KEY).agg(F.count_distinct("url").alias("n")).select(*KEY, F.when(F.col("n") == 1, "feed:board").otherwise("board").alias("source"))
    kept = _state(spark, sf, "closed_at")
    return state.mark_seen(kept, _seen(spark, sf, "title"), feeds, KEY, NOW).select(*KEY, "closed_at", "missed", "last_seen")


def feed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's sponsorship set on items that have no fact from elsewhere."""
    rows = table(spark, sf, "list_feed").where("item_uuid IS NOT NULL")
    items = rows.groupBy("item_uuid").agg(F.min(F.coalesce("sponsorship", F.lit(""))).alias("lowest"), F.max(F.coalesce("sponsorship", F.lit(""))).alias("highest"), F.max(F.length("title")).alias("n"))
    known = sponsorship(F.col("lowest"))
    from_text = F.col("n") > 30
    kept = items.select("item_uuid", F.when(from_text, F.coalesce(known, F.lit("unclear"))).alias("sponsorship"), F.when(from_text, "text").alias("sponsorship_source"))
    offered = items.select("item_uuid", sponsorship(F.col("highest")).alias("sponsorship"))
    return state.set_fact(kept, offered, ["item_uuid"], "sponsorship")


def open_postings(spark: SparkSession, sf: str) -> DataFrame:
    boards = table(spark, sf, "companies").where("ats = 'greenhouse'").groupBy("board_token").agg(F.max("entry_name").alias("entry_name"), F.max("company_id").alias("company_id"))
    rows = _latest(_rows(spark, sf), "title", "closed_at").where("closed_at IS NULL")
    return rows.join(boards, "board_token", "left").select(*KEY, "title", "company_id", "entry_name").orderBy("job_id")


def _evaluated(rows: DataFrame) -> DataFrame:
    norm = text.normalize(F.col("title"))
    return rows.where("title IS NOT NULL").select(*KEY, text.contains_phrase(norm, "senior").alias("passed"))


def evaluations_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluations of all deliveries, those of the last one in the place of older ones."""
    return state.replace_rows(_evaluated(_state(spark, sf, "title")), _evaluated(_seen(spark, sf, "title")), KEY)


def posting_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    kept = _latest(rows, "title", "closed_at").select(*KEY, "title", "first_seen", "closed_at")
    evaluations = _evaluated(_seen(spark, sf, "title"))
    sources = rows.select(*KEY, F.format_string("delivery %02d", "snapshot_no").alias("source"))
    where: list[Column] = [F.col("closed_at").isNull(), F.col("status") != "filtered_out"]
    return state.listing(kept, evaluations, sources, KEY, where, [F.col("first_seen").desc_nulls_last(), F.col("job_id").desc(), F.col("board_token")], 50)


def boards_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Boards in the company list, and those that only a delivery or a board's records name."""
    boards = table(spark, sf, "companies").groupBy("ats", "board_token").agg(F.max("entry_name").alias("name"), F.max("staffing_agency").alias("agency"))
    named = [table(spark, sf, t).select(F.lit(a).alias("ats"), "board_token", c.alias("name")) for t, a, c in (("greenhouse_jobs", "greenhouse", F.col("company_name")), ("lever_postings", "lever", F.lit(None).cast("string")), ("ashby_jobs", "ashby", F.lit(None).cast("string")))]
    offered = named[0].unionByName(named[1]).unionByName(named[2]).where("board_token IS NOT NULL").groupBy("ats", "board_token").agg(F.max("name").alias("name")).withColumn("agency", F.lit(None).cast("boolean"))
    return state.upsert_boards(boards, offered, ["ats", "board_token"], "name", "agency")


def boards_retired(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs of boards that the last delivery no longer has."""
    kept = _state(spark, sf, "closed_at").select(*KEY, "closed_at")
    return state.retire(kept, kept.select("board_token"), _seen(spark, sf, "title"), ["board_token"], NOW)[1]


def companies_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").select("company_id", "entry_name", "ats", "board_token", "staffing_agency").orderBy("company_id")


def urls_queued(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned addresses of comments, and those of the feed that aren't among them."""
    clean = lambda df: df.select(urls.clean_url(F.col("url")).alias("url")).where("url IS NOT NULL")
    first = clean(table(spark, sf, "leads").select(F.explode("urls").alias("url"))).distinct().withColumn("found_in", F.lit("leads"))
    return state.insert_new(first, clean(table(spark, sf, "list_feed")).withColumn("found_in", F.lit("list_feed")), ["url"])


def probes_cached(spark: SparkSession, sf: str) -> DataFrame:
    tried = table(spark, sf, "list_feed").where("company_name IS NOT NULL").groupBy("company_name").agg(F.max(seconds("fetched_at")).alias("probed_at"), F.max(F.coalesce("active", F.lit(False))).alias("hit"))
    return state.cached(tried, "probed_at", "hit", NOW, 60 * DAY)


def listings_attached(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of the feed's listings beside the addresses that comments have named, each host being a board."""
    page = lambda df: df.select(urls.clean_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().withColumn("host", urls.host_of(F.col("url")))
    known = page(table(spark, sf, "leads").select(F.explode("urls").alias("url")))
    return state.attach(page(table(spark, sf, "list_feed")), known, known, ["url"], ["host"]).groupBy("fate").agg(F.count("*").alias("n"))


def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What one run did, per board."""
    seen = _seen(spark, sf, "title", "company_name").select(*KEY, "title", "company_name")
    done = state.upsert(_state(spark, sf, "title", "company_name", "closed_at"), seen, KEY, "title", NOW, keep=["company_name"])
    return done.groupBy("board_token").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "reopened", "updated", "unchanged")], F.count_if(F.col("status").isNull()).alias("not_seen"))


_ROWS = "r AS (SELECT *, max(snapshot_no) OVER () AS last FROM posting_snapshots WHERE snapshot_no IS NOT NULL AND board_token IS NOT NULL AND job_id IS NOT NULL)"


def _sql_value(column: str, where: str, *before: str) -> str:
    """board_token, job_id, the column of the last snapshot's row with the largest values."""
    order = ", ".join(f"{c} DESC" for c in ("snapshot_no", *before))
    return f"(SELECT board_token, job_id, {column} FROM (SELECT *, row_number() OVER (PARTITION BY board_token, job_id ORDER BY {order}) AS k FROM r WHERE {where}) WHERE k = 1)"


_T, _C, _X = "coalesce(title, '')", "coalesce(company_name, '')", "coalesce(closed_at, -1)"
_OLD, _NEW = "snapshot_no < last", "snapshot_no = last"
_UPSERTED = (
    f"WITH {_ROWS}, o AS (SELECT board_token, job_id, nullif(title, '') AS title, nullif(company_name, '') AS company_name, closed_at, a.first_seen, a.last_seen FROM {_sql_value('title, company_name, closed_at', _OLD, _T, _C, _X)} JOIN (SELECT board_token, job_id, min(first_seen) AS first_seen, max(first_seen) AS last_seen FROM r WHERE {_OLD} GROUP BY 1, 2) a USING (board_token, job_id)), "
    f"n AS (SELECT board_token, job_id, nullif(title, '') AS title, nullif(company_name, '') AS company_name, true AS here FROM {_sql_value('title, company_name', _NEW, _T, _C)}), "
    f"u AS (SELECT board_token, job_id, CASE WHEN here THEN n.title ELSE o.title END AS title, coalesce(n.company_name, o.company_name) AS company_name, coalesce(o.first_seen, {NOW}) AS first_seen, CASE WHEN here THEN {NOW} ELSE o.last_seen END AS last_seen, CASE WHEN here IS NULL THEN o.closed_at END AS closed_at, 0 AS missed, CASE WHEN here IS NULL THEN NULL WHEN o.first_seen IS NULL THEN 'new' WHEN o.closed_at IS NOT NULL THEN 'reopened' WHEN o.title IS DISTINCT FROM n.title THEN 'updated' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (board_token, job_id))"
)
_CLEAN_BASE = "split_part(split_part({0}, '#', 1), '?', 1)"
_CLEAN = (
    "CASE WHEN regexp_matches(" + _CLEAN_BASE + ", '^https?://[^/]+') THEN lower(regexp_extract(" + _CLEAN_BASE + ", '^https?://[^/]+')) || CASE WHEN regexp_full_match(" + _CLEAN_BASE + ", 'https?://[^/]+') THEN '/' ELSE regexp_replace(" + _CLEAN_BASE + ", '^https?://[^/]+', '') END"
    " || coalesce(nullif('?' || array_to_string(list_filter(string_split(CASE WHEN contains(split_part({0}, '#', 1), '?') THEN split_part(split_part({0}, '#', 1), '?', 2) ELSE '' END, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN (" + ", ".join(f"'{t}'" for t in urls.TRACKING) + ")), '&'), '?'), '') END"
)
_MAPPED = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPONSORSHIP.items()) + " END"
_PAGES = f"l AS (SELECT DISTINCT {_CLEAN.format('url')} AS url FROM (SELECT unnest(urls) AS url FROM leads)), f AS (SELECT DISTINCT {_CLEAN.format('url')} AS url FROM list_feed)"
_HOST = "regexp_extract({}, '^https?://(?:[^/?#]*@)?([^/?#:]*)', 1)"

SQL = {
    "posting_upsert": f"{_UPSERTED} SELECT * FROM u",
    "run_counts": f"{_UPSERTED} SELECT board_token, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'reopened') AS reopened, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status IS NULL) AS not_seen FROM u GROUP BY 1",
    "sources_known": f"WITH {_ROWS} SELECT board_token, job_id, min(first_seen) AS first_seen, max(first_seen) AS seen_at, arg_max(url, (first_seen, url)) AS url FROM r WHERE {_OLD} AND (board_token, job_id) IN (SELECT (board_token, job_id) FROM r WHERE {_NEW}) GROUP BY 1, 2",
    "board_reconcile": f"WITH {_ROWS}, s AS (SELECT board_token, job_id, closed_at AS was FROM {_sql_value('closed_at', 'snapshot_no < last - 1', _T, _X)}), p AS (SELECT s.*, EXISTS (SELECT 1 FROM r WHERE r.board_token = s.board_token AND snapshot_no = last - 1) AS p1, EXISTS (SELECT 1 FROM r WHERE r.board_token = s.board_token AND {_NEW}) AS p0, EXISTS (SELECT 1 FROM r WHERE r.board_token = s.board_token AND r.job_id = s.job_id AND snapshot_no = last - 1) AS l1, EXISTS (SELECT 1 FROM r WHERE r.board_token = s.board_token AND r.job_id = s.job_id AND {_NEW}) AS l0 FROM s), m AS (SELECT *, CASE WHEN was IS NOT NULL OR l1 OR NOT p1 THEN 0 ELSE 1 END AS m1 FROM p), n AS (SELECT *, CASE WHEN was IS NOT NULL THEN 0 WHEN l0 OR (NOT p0 AND m1 = 0) THEN 0 ELSE m1 + 1 END AS m0 FROM m) SELECT board_token, job_id, CASE WHEN was IS NOT NULL THEN was WHEN m0 >= 2 THEN {NOW} END AS closed_at, m0 AS missed FROM n",
    "seen_again": f"WITH {_ROWS}, o AS (SELECT board_token, job_id, closed_at, last_seen FROM {_sql_value('closed_at', _OLD, _X)} JOIN (SELECT board_token, job_id, max(first_seen) AS last_seen FROM r WHERE {_OLD} GROUP BY 1, 2) USING (board_token, job_id)), g AS (SELECT board_token, job_id, count(DISTINCT url) = 1 AND bool_or({_NEW}) AS again FROM r GROUP BY 1, 2) SELECT board_token, job_id, CASE WHEN NOT again THEN closed_at END AS closed_at, 0 AS missed, CASE WHEN again THEN {NOW} ELSE last_seen END AS last_seen FROM o JOIN g USING (board_token, job_id)",
    "feed_facts": f"WITH i AS (SELECT item_uuid, min(coalesce(sponsorship, '')) AS lowest, max(coalesce(sponsorship, '')) AS highest, max(length(title)) > 30 AS t FROM list_feed WHERE item_uuid IS NOT NULL GROUP BY 1) SELECT item_uuid, CASE WHEN t THEN coalesce({_MAPPED.format('lowest')}, 'unclear') ELSE {_MAPPED.format('highest')} END AS sponsorship, CASE WHEN t THEN 'text' WHEN {_MAPPED.format('highest')} IS NOT NULL THEN 'feed' END AS sponsorship_source FROM i",
    "open_postings": f"WITH {_ROWS}, b AS (SELECT board_token, max(entry_name) AS entry_name, max(company_id) AS company_id FROM companies WHERE ats = 'greenhouse' GROUP BY 1) SELECT board_token, job_id, nullif(title, '') AS title, company_id, entry_name FROM {_sql_value('title, closed_at', 'true', _T, _X)} LEFT JOIN b USING (board_token) WHERE closed_at IS NULL ORDER BY job_id",
    "evaluations_saved": f"WITH {_ROWS}, o AS {_sql_value('title', _OLD, _T)}, n AS {_sql_value('title', _NEW, _T)}, e AS (SELECT * FROM n WHERE title <> '' UNION ALL SELECT * FROM o WHERE title <> '' AND (board_token, job_id) NOT IN (SELECT (board_token, job_id) FROM n WHERE title <> '')) SELECT board_token, job_id, {sql_has(sql_norm('title'), 'senior')} AS passed FROM e",
    "posting_listing": f"WITH {_ROWS}, s AS (SELECT board_token, job_id, nullif(title, '') AS title, closed_at, first_seen FROM {_sql_value('title, closed_at', 'true', _T, _X)} JOIN (SELECT board_token, job_id, min(first_seen) AS first_seen FROM r GROUP BY 1, 2) USING (board_token, job_id)), e AS (SELECT board_token, job_id, {sql_has(sql_norm('title'), 'senior')} AS passed FROM {_sql_value('title', _NEW, _T)} WHERE title <> ''), p AS (SELECT s.*, passed, CASE WHEN passed IS NULL THEN 'not_evaluated' WHEN passed THEN 'passed' ELSE 'filtered_out' END AS status FROM s LEFT JOIN e USING (board_token, job_id) WHERE closed_at IS NULL AND (passed IS NULL OR passed) ORDER BY first_seen DESC NULLS LAST, job_id DESC, board_token LIMIT 50) SELECT p.*, (SELECT string_agg(DISTINCT printf('delivery %02d', snapshot_no), '|' ORDER BY printf('delivery %02d', snapshot_no)) FROM r WHERE r.board_token = p.board_token AND r.job_id = p.job_id) AS sources FROM p",
    "boards_upserted": "WITH b AS (SELECT ats, board_token, max(entry_name) AS name, max(staffing_agency) AS agency FROM companies GROUP BY 1, 2), o AS (SELECT ats, board_token, max(name) AS name FROM (SELECT 'greenhouse' AS ats, board_token, company_name AS name FROM greenhouse_jobs UNION ALL SELECT 'lever', board_token, NULL FROM lever_postings UNION ALL SELECT 'ashby', board_token, NULL FROM ashby_jobs) WHERE board_token IS NOT NULL GROUP BY 1, 2) SELECT ats, board_token, CASE WHEN b.name IS NULL OR lower(b.name) = lower(board_token) THEN coalesce(o.name, b.name) ELSE b.name END AS name, agency FROM b FULL JOIN o USING (ats, board_token)",
    "boards_retired": f"WITH {_ROWS}, o AS {_sql_value('closed_at', _OLD, _X)} SELECT board_token, job_id, CASE WHEN closed_at IS NULL AND board_token NOT IN (SELECT board_token FROM r WHERE {_NEW}) THEN {NOW} ELSE closed_at END AS closed_at FROM o",
    "companies_by_id": "SELECT company_id, entry_name, ats, board_token, staffing_agency FROM companies ORDER BY company_id",
    "urls_queued": f"WITH l AS (SELECT DISTINCT {_CLEAN.format('url')} AS url FROM (SELECT unnest(urls) AS url FROM leads)), f AS (SELECT DISTINCT {_CLEAN.format('url')} AS url FROM list_feed) SELECT url, 'leads' AS found_in FROM l WHERE url IS NOT NULL UNION ALL SELECT url, 'list_feed' FROM f WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM l WHERE url IS NOT NULL)",
    "probes_cached": f"SELECT * FROM (SELECT company_name, max(CAST(floor(epoch(fetched_at)) AS BIGINT)) AS probed_at, max(coalesce(active, false)) AS hit FROM list_feed WHERE company_name IS NOT NULL GROUP BY 1) WHERE hit OR probed_at >= {NOW - 60 * DAY}",
    "listings_attached": f"WITH {_PAGES} SELECT fate, count(*) AS n FROM (SELECT CASE WHEN url IN (SELECT url FROM l WHERE url IS NOT NULL) THEN 'attach' WHEN {_HOST.format('url')} IN (SELECT {_HOST.format('url')} FROM l WHERE url IS NOT NULL) THEN 'drop' ELSE 'stand_in' END AS fate FROM f WHERE url IS NOT NULL) GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (posting_upsert, sources_known, board_reconcile, seen_again, feed_facts, open_postings, evaluations_saved, posting_listing, boards_upserted, boards_retired, companies_by_id, urls_queued, probes_cached, listings_attached, run_counts)}
