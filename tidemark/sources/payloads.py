"""Recorded payloads of boards, feeds and threads → rows with one schema.

Schemas are written down, never inferred. A body that can't be read, or lacks a field it must have,
gives an error row of its own and fails nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.html import links, to_text, unescape
from tidemark.functions.pay import pay
from tidemark.functions.text import job_type, work_mode

# The payload schemas.
GREENHOUSE = "struct<jobs array<struct<id bigint, title string, absolute_url string, location struct<name string>, content string, company_name string, first_published string, updated_at string, metadata array<struct<name string, value string>>>>>"
LEVER = "array<struct<id string, text string, hostedUrl string, categories struct<commitment string, location string, allLocations array<string>>, createdAt bigint, workplaceType string, descriptionPlain string, lists array<struct<text string, content string>>, additionalPlain string, salaryRange struct<min double, max double, currency string, interval string>>>"
ASHBY = "struct<jobs array<struct<id string, title string, location string, secondaryLocations array<struct<location string>>, isListed boolean, isRemote boolean, workplaceType string, employmentType string, publishedAt string, jobUrl string, descriptionPlain string>>>"
FEED = "array<struct<id string, company_name string, title string, locations array<string>, url string, date_posted bigint, active boolean, is_visible boolean, sponsorship string>>"
ITEM = "struct<id bigint, title string, kids array<bigint>, text string, deleted boolean, dead boolean>"

#: The columns that every board gives.
POSTING = ["ats", "board_token", "job_id", "company_name", "title", "url", "locations", "published_at", "description"]


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """path, body of recorded files, each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def _lacks(field: str):
    return lambda x: x[field].isNull()


def read_body(df: DataFrame, body: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with ``parsed``, error rows). required: fields that must not be null in any element, as 'jobs.id' or 'id'."""
    parsed = df.withColumn("parsed", F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}))
    bad = F.col("parsed").isNull()
    for field in required:
        outer, _, inner = field.rpartition(".")
        elements = F.col(f"parsed.{outer}") if outer else F.col("parsed")
        bad = bad | elements.isNull() | F.exists(elements, _lacks(inner))
    bad = F.coalesce(bad, F.lit(True))
    return parsed.where(~bad), parsed.where(bad).drop("parsed").withColumn("error", F.lit("unreadable body"))


def greenhouse(df: DataFrame, body: str, token: Column, company: Column) -> DataFrame:
    jobs = read_body(df, body, GREENHOUSE, ["jobs.id", "jobs.title"])[0].select(token.alias("board_token"), company.alias("company"), F.explode("parsed.jobs").alias("j"))
    return jobs.select(
        F.lit("greenhouse").alias("ats"), F.lower("board_token").alias("board_token"), F.col("j.id").cast("string").alias("job_id"), F.coalesce("j.company_name", "company").alias("company_name"), "j.title", F.col("j.absolute_url").alias("url"),
        F.array_compact(F.array("j.location.name")).alias("locations"), F.unix_seconds(F.try_to_timestamp(F.coalesce("j.first_published", "j.updated_at"))).alias("published_at"), to_text(F.col("j.content"), escaped=True).alias("description"),
    )


def lever(df: DataFrame, body: str, token: Column, company: Column) -> DataFrame:
    jobs = read_body(df, body, LEVER, ["id", "text"])[0].select(token.alias("board_token"), company.alias("company"), F.explode("parsed").alias("j"))
    listed = F.concat_ws("\n", F.transform("j.lists", lambda x: F.concat_ws("\n", x["text"], x["content"])))
    return jobs.select(
        F.lit("lever").alias("ats"), "board_token", F.lower("j.id").alias("job_id"), F.col("company").alias("company_name"), F.col("j.text").alias("title"), F.col("j.hostedUrl").alias("url"),
        F.coalesce(F.when(F.size("j.categories.allLocations") > 0, F.col("j.categories.allLocations")), F.array_compact(F.array("j.categories.location"))).alias("locations"),
        F.expr("j.createdAt div 1000").alias("published_at"), F.concat_ws("\n", "j.descriptionPlain", to_text(listed), "j.additionalPlain").alias("description"),
    )


def ashby(df: DataFrame, body: str, token: Column, company: Column) -> DataFrame:
    jobs = read_body(df, body, ASHBY, ["jobs.id", "jobs.title"])[0].select(token.alias("board_token"), company.alias("company"), F.explode("parsed.jobs").alias("j")).where(F.coalesce(F.col("j.isListed"), F.lit(True)))
    return jobs.select(
        F.lit("ashby").alias("ats"), F.lower("board_token").alias("board_token"), F.col("j.id").alias("job_id"), F.col("company").alias("company_name"), "j.title", F.col("j.jobUrl").alias("url"),
        F.array_compact(F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda x: x["location"]), F.array()))).alias("locations"),
        F.unix_seconds(F.try_to_timestamp("j.publishedAt")).alias("published_at"), F.col("j.descriptionPlain").alias("description"),
    )


def feed(df: DataFrame, body: str) -> DataFrame:
    items = read_body(df, body, FEED, ["id", "url"])[0].select(F.explode("parsed").alias("i")).select("i.*")
    return items.where(F.col("active") & F.coalesce(F.col("is_visible"), F.lit(True)))


def thread_leads(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, company, urls of comments: the first field of a header with a bar, if it is short and no address."""
    header = unescape(F.substring_index(F.col(text), "<p>", 1))
    first = F.trim(F.substring_index(header, "|", 1))
    company = F.when(header.contains("|") & (F.octet_length(first) <= 60) & (first != "") & ~F.lower(first).startswith("http"), first)
    return items.select(item_id, company.alias("company"), links(F.col(text)).alias("urls"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated list of cities; rows of the wrong shape are left out."""
    schema = "name string, ascii string, alternates string, lat double, lon double, country string, admin1 string, population bigint"
    return spark.read.csv(path, sep="\t", schema=schema, mode="DROPMALFORMED", quote="").where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")


#: The facts that boards state in fields of their own.
FACTS = ["ats", "board_token", "job_id", "work_mode", "job_type", "pay"]
# What a list feed says about sponsorship.
SPONSORSHIP = {"Offers Sponsorship": "offered", "Does Not Offer Sponsorship": "not_offered", "U.S. Citizenship is Required": "citizenship_required"}
# Fixed value: how the title of a hiring thread begins.
HIRING_THREAD = "Ask HN: Who is hiring?"
# Fixed value: the payload of a job's form.
_ITEM = "struct<label string, required boolean, type string, fields array<struct<type string, values array<struct<label string>>>>, answer_options array<struct<label string>>>"
FORM = f"struct<questions array<{_ITEM}>, location_questions array<{_ITEM}>, compliance array<struct<questions array<{_ITEM}>>>, demographic_questions struct<questions array<{_ITEM}>>>"
ASHBY_PAY = "array<struct<compensationType string, interval string, currencyCode string, minValue double, maxValue double>>"
_NO_PAY = "struct<low double, high double, currency string, period string, ceiling double>"


def canonical_token(ats: str, token: Column) -> Column:
    """Board tokens count in any case where the provider says so."""
    return F.lower(token) if ats in ("greenhouse", "ashby") else token


def _meta(metadata: Column, words: str) -> Column:
    """The first text among the metadata whose name has the words."""
    return F.get(F.filter(metadata, lambda m: F.lower(m["name"]).contains(words) & m["value"].isNotNull()), F.lit(0))["value"]


def greenhouse_facts(df: DataFrame, body: str, token: Column) -> DataFrame:
    jobs = read_body(df, body, GREENHOUSE, ["jobs.id", "jobs.title"])[0].select(token.alias("t"), F.explode("parsed.jobs").alias("j"))
    kind = F.coalesce(job_type(_meta(F.col("j.metadata"), "employment type")), job_type(F.col("j.title")))
    return jobs.select(F.lit("greenhouse").alias("ats"), canonical_token("greenhouse", F.col("t")).alias("board_token"), F.col("j.id").cast("string").alias("job_id"), work_mode(_meta(F.col("j.metadata"), "workplace")).alias("work_mode"), kind.alias("job_type"), F.lit(None).cast(_NO_PAY).alias("pay"))


def lever_facts(df: DataFrame, body: str, token: Column) -> DataFrame:
    jobs = read_body(df, body, LEVER, ["id", "text"])[0].select(token.alias("t"), F.explode("parsed").alias("j"))
    stated = pay(F.col("j.salaryRange.min"), F.col("j.salaryRange.max"), F.col("j.salaryRange.currency"), F.col("j.salaryRange.interval"))
    kind = F.coalesce(job_type(F.col("j.categories.commitment")), job_type(F.col("j.text")))
    return jobs.select(F.lit("lever").alias("ats"), F.col("t").alias("board_token"), F.lower("j.id").alias("job_id"), work_mode(F.col("j.workplaceType")).alias("work_mode"), kind.alias("job_type"), stated.alias("pay"))


def ashby_facts(df: DataFrame, body: str, token: Column) -> DataFrame:
    """The first salary or hourly component with a readable period and an amount is the pay."""
    schema = ASHBY.removesuffix(">>>") + f", compensation struct<summaryComponents {ASHBY_PAY}>>>>"
    jobs = read_body(df, body, schema, ["jobs.id", "jobs.title"])[0].select(token.alias("t"), F.explode("parsed.jobs").alias("j")).where(F.coalesce(F.col("j.isListed"), F.lit(True)))
    paid = F.transform(F.filter("j.compensation.summaryComponents", lambda c: c["compensationType"].isin("Salary", "Hourly")), lambda c: pay(c["minValue"], c["maxValue"], c["currencyCode"], c["interval"]))
    mode = F.coalesce(work_mode(F.col("j.workplaceType")), F.when(F.col("j.isRemote"), "remote"))
    kind = F.coalesce(job_type(F.col("j.employmentType")), job_type(F.col("j.title")))
    return jobs.select(F.lit("ashby").alias("ats"), canonical_token("ashby", F.col("t")).alias("board_token"), F.lower("j.id").alias("job_id"), mode.alias("work_mode"), kind.alias("job_type"), F.get(F.array_compact(paid), F.lit(0)).alias("pay"))


def sponsorship(stated: Column) -> Column:
    """What a feed's text says about sponsorship; null for any other text."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SPONSORSHIP.items() for x in kv]), stated)


def listing_postings(items: DataFrame, source: str) -> DataFrame:
    """Postings from a feed's items alone: POSTING columns, an empty description, the source in the place of a board."""
    return items.select(F.lit("external").alias("ats"), F.lit(source).alias("board_token"), F.col("id").alias("job_id"), F.trim("company_name").alias("company_name"), F.trim("title").alias("title"), "url", "locations", F.col("date_posted").alias("published_at"), F.lit("").alias("description"))


def is_hiring_thread(title: Column) -> Column:
    return F.coalesce(title.startswith(HIRING_THREAD), F.lit(False))


def submitted(df: DataFrame, body: str) -> DataFrame:
    """item_id of what a user has submitted, in the payload's order by pos; a body of null or without a list gives none."""
    return df.select(F.posexplode(F.from_json(F.col(body), "struct<submitted array<bigint>>")["submitted"]).alias("pos", "item_id"))


def thread_items(df: DataFrame, body: str) -> DataFrame:
    """One row per item body; a body of null is a missing item and gives none."""
    return df.select(F.from_json(F.col(body), ITEM).alias("i")).where("i.id IS NOT NULL").select("i.*")


def board_name(body: Column) -> Column:
    """The name that a board gives itself; null for an unreadable body."""
    return F.from_json(body, "struct<name string>")["name"]


def job_questions(df: DataFrame, body: str) -> DataFrame:
    """df's other columns, pos, group, label, types, options, required of every question in a job's form; groups in the payload's order, empty labels left out."""
    form = F.from_json(F.col(body), FORM)
    nested = {"questions": form["questions"], "location_questions": form["location_questions"], "compliance": F.flatten(F.transform(form["compliance"], lambda c: F.coalesce(c["questions"], F.array()))), "demographic_questions": form["demographic_questions"]["questions"]}
    tag = lambda items, name: F.transform(F.coalesce(items, F.array()), lambda q: F.struct(F.lit(name).alias("group"), q.alias("q")))
    tagged = [tag(items, name) for name, items in nested.items()]
    fields = F.coalesce(F.col("g.q.fields"), F.array())
    values = F.flatten(F.transform(fields, lambda f: F.coalesce(f["values"], F.array())))
    labels = F.transform(F.concat(values, F.coalesce(F.col("g.q.answer_options"), F.array())), lambda v: F.trim(v["label"]))
    ordered = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    rows = df.withColumn("_all", F.concat(*tagged)).select(*[c for c in df.columns if c != body], F.posexplode("_all").alias("pos", "g"))
    kinds = F.concat(F.array("g.q.type"), F.transform(fields, lambda f: f["type"]))
    return rows.select(*[c for c in df.columns if c != body], "pos", "g.group", F.trim("g.q.label").alias("label"), ordered(kinds).alias("types"), ordered(labels).alias("options"), F.coalesce("g.q.required", F.lit(False)).alias("required")).where("label <> ''")
