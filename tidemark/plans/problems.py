"""Queries of the data-cleaning problems in the core: pN_ over whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.instants import epoch_number_ms, with_instant
from tidemark.operators.packed import Regions, explode_pieces, pieces
from tidemark.operators.snapshots import change_events
from tidemark.operators.units import conversion_table, convert, money_period_edges, pay_facts, shortest_compositions, unit_parts
from tidemark.session import salted_join, table

# The columns of a snapshot row that count as its content.
SNAPSHOT_TRACKED = ["company_name", "title", "url", "location_raw", "closed_at", "duplicate_of"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "posting_snapshots")
    dated = with_instant(rows, "updated_at", "_version")
    return change_events(dated, "snapshot_no", "board_token", ["job_id"], SNAPSHOT_TRACKED, F.col("_version"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "companies").select("ats", "board_token", "time_zone", "date_order").groupBy("ats", "board_token").agg(F.max(F.struct("time_zone", "date_order")).alias("b"))
    texts = [
        table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.lit(ats).alias("ats"), "board_token", F.col(rec).cast("string").alias("rec_id"), F.col(at).alias("stated"), "fetched_at")
        for name, ats, rec, at in (("greenhouse_jobs", "greenhouse", "job_id", "first_published"), ("ashby_jobs", "ashby", "job_uuid", "published_at"))
    ]
    latest = texts[0].unionByName(texts[1]).where("rec_id IS NOT NULL").groupBy("src", "rec_id").agg(F.max(F.struct("fetched_at", "ats", "board_token", "stated")).alias("r"))
    rows = latest.select("src", "rec_id", "r.ats", "r.board_token", "r.stated").where("stated IS NOT NULL")
    zoned = salted_join(rows, boards, ["ats", "board_token"], F.col("rec_id")).select("src", "rec_id", "stated", "b.time_zone", "b.date_order")
    dated = with_instant(zoned, "stated", "epoch_ms", "time_zone", "date_order").select("src", "rec_id", "epoch_ms")
    numbers = [
        table(spark, sf_dir, name).select(F.lit(name).alias("src"), F.col(rec).cast("string").alias("rec_id"), F.col(at).alias("stated"), "fetched_at")
        for name, rec, at in (("lever_postings", "posting_id", "created_at"), ("list_feed", "item_uuid", "date_posted"))
    ]
    numbered = numbers[0].unionByName(numbers[1]).where("rec_id IS NOT NULL").groupBy("src", "rec_id").agg(F.max(F.struct("fetched_at", "stated")).alias("r")).select("src", "rec_id", epoch_number_ms(F.col("r.stated")).alias("epoch_ms"))
    return dated.unionByName(numbered).where("epoch_ms IS NOT NULL")


#: Reference tables are read to the driver only up to this many rows.
MAX_REFERENCE_ROWS = 200_000


def regions(spark: SparkSession, sf_dir: str) -> Regions:
    """The regions of places, on the driver after a check of their number."""
    rows = table(spark, sf_dir, "places").select("place_name", "ascii_name", "admin_code", "admin_name", "country_code", "country_name").distinct().limit(MAX_REFERENCE_ROWS + 1).collect()
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError("places is too long to be a reference list")
    return Regions(map(tuple, rows))


def location_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_id, pieces of greenhouse_jobs.location_name, one row per record."""
    rows = table(spark, sf_dir, "greenhouse_jobs").where("job_id IS NOT NULL").groupBy(F.col("job_id").cast("string").alias("rec_id")).agg(F.max(F.struct("fetched_at", "location_name")).alias("r"))
    return rows.select(F.lit("greenhouse_jobs").alias("src"), "rec_id", pieces(F.col("r.location_name"), words=("or",), regions=regions(spark, sf_dir)).alias("pieces"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = table(spark, sf_dir, "hn_items").where("item_id IS NOT NULL AND text IS NOT NULL AND NOT coalesce(deleted, false) AND NOT coalesce(dead, false)")
    headers = comments.groupBy(F.col("item_id").cast("string").alias("rec_id")).agg(F.max(F.substring_index("text", "<p>", 1)).alias("h"))
    packed = location_pieces(spark, sf_dir).unionByName(headers.select(F.lit("hn_items").alias("src"), "rec_id", pieces(F.col("h")).alias("pieces")))
    return explode_pieces(packed, "pieces", "pos", "piece", least=2)


def usd_rates(spark: SparkSession, sf_dir: str) -> dict[str, Fraction]:
    rows = table(spark, sf_dir, "pay_rates").where("currency IS NOT NULL AND usd_per_unit > 0").limit(MAX_REFERENCE_ROWS + 1).collect()
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError("pay_rates is too long to be a table of currencies")
    return {r.currency: Fraction(str(r.usd_per_unit)) for r in rows}


def stated_pay(spark: SparkSession, sf_dir: str, rates: dict[str, Fraction]) -> DataFrame:
    """src, rec_id, low, high, currency, period as stored, and what the text says; one row per record, the latest.

    Texts are read where they are scanned, so that only the facts travel.
    """

    def latest(name: str, rec: str, fields: dict[str, Column], text: Column) -> DataFrame:
        rows = table(spark, sf_dir, name).where(f"{rec} IS NOT NULL")
        rows = rows.select(F.col(rec).cast("string").alias("rec_id"), "fetched_at", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("pay"), pay_facts(text, rates).alias("said"))
        rows = rows.groupBy("rec_id").agg(F.max(F.struct("fetched_at", "pay", "said")).alias("r"))
        return rows.select(F.lit(name).alias("src"), "rec_id", *[F.col(f"r.pay.{k}").alias(k) for k in fields], "r.said")

    def struct_fields(at: str, period: str, currency: str = "currency") -> dict[str, Column]:
        return {"low": F.col(f"{at}.min_value"), "high": F.col(f"{at}.max_value"), "currency": F.col(f"{at}.{currency}"), "period": F.col(f"{at}.{period}")}

    lever_lists = F.concat_ws("\n", F.transform("lists", lambda x: F.concat_ws("\n", x["heading"], x["content_html"])))
    salary = F.filter("compensation_info.summary_components", lambda x: (x["compensation_type"] == "Salary") & (x["min_value"].isNotNull() | x["max_value"].isNotNull()))
    first = F.get(salary, F.lit(0))
    ashby = {"low": first["min_value"], "high": first["max_value"], "currency": first["currency_code"], "period": first["pay_interval"]}
    return (
        latest("greenhouse_jobs", "job_id", struct_fields("pay", "pay_period"), F.col("content_html"))
        .unionByName(latest("lever_postings", "posting_id", struct_fields("salary_range", "pay_interval"), F.concat_ws("\n", "description_plain", lever_lists, "additional_plain")))
        .unionByName(latest("ashby_jobs", "job_uuid", ashby, F.col("description_plain")))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = usd_rates(spark, sf_dir)
    conversions = conversion_table(spark, shortest_compositions(money_period_edges(rates), "USD|one|year"))
    read = stated_pay(spark, sf_dir, rates).withColumn("own", unit_parts(F.col("currency"), F.col("period"), rates))
    has = F.col("low").isNotNull() | F.col("high").isNotNull()
    scale = F.when(F.col("own.scale") != "one", F.col("own.scale")).otherwise(F.col("said.scale"))
    unit = lambda *parts: F.when(F.forall(F.array(*parts), lambda x: x.isNotNull()), F.concat_ws("|", *parts))
    field_unit = unit(F.coalesce("own.currency", "said.currency", "said.said_currency"), scale, F.coalesce("own.period", "said.period", "said.said_period"))
    picked = read.select(
        "src", "rec_id", F.when(has, F.col("low")).otherwise(F.col("said.low")).alias("low"), F.when(has, F.col("high")).otherwise(F.col("said.high")).alias("high"),
        F.when(has, field_unit).otherwise(unit(F.col("said.said_currency"), F.lit("one"), F.col("said.said_period"))).alias("unit"),
    )
    usd = convert(picked.where("unit IS NOT NULL AND (low IS NOT NULL OR high IS NOT NULL)"), conversions, "unit", {"usd_min": "low", "usd_max": "high"})
    whole = lambda c: F.coalesce(F.round(c, 0).cast("bigint"), F.lit(-1))
    return usd.where("usd_min IS NOT NULL OR usd_max IS NOT NULL").select("src", "rec_id", whole(F.col("usd_min")).alias("usd_year_min"), whole(F.col("usd_max")).alias("usd_year_max"))
