"""Queries of the problems about text; pN_ over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.entity_names import entity_pairs, link_names
from tidemark.llm.gazetteer import map_places
from tidemark.llm.leakage import cleaned, leaks, test_items
from tidemark.llm.packing import TOKENIZER, pack, token_counts
from tidemark.llm.truncation import cut_texts, truncation_by_source
from tidemark.operators.packed import explode_pieces
from tidemark.plans.problems import location_pieces
from tidemark.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (("list_feed", "company_name"), ("leads", "company"), ("companies", "entry_name"))
    names = [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in columns]
    return entity_pairs(link_names(names[0].unionByName(names[1]).unionByName(names[2]), "name"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = explode_pieces(location_pieces(spark, sf_dir), "pieces", "pos", "value")
    lever = table(spark, sf_dir, "lever_postings").where("posting_id IS NOT NULL").groupBy(F.col("posting_id").cast("string").alias("rec_id")).agg(F.max(F.struct("fetched_at", F.col("categories.location_name").alias("value"))).alias("r"))
    feed = table(spark, sf_dir, "list_feed").where("item_uuid IS NOT NULL").groupBy(F.col("item_uuid").cast("string").alias("rec_id")).agg(F.max(F.struct("fetched_at", "locations")).alias("r"))
    values = (
        packed.unionByName(lever.select(F.lit("lever_postings").alias("src"), "rec_id", F.lit(0).alias("pos"), F.col("r.value").alias("value")))
        .unionByName(feed.select(F.lit("list_feed").alias("src"), "rec_id", F.posexplode("r.locations").alias("pos", "value")))
    )
    return map_places(values.where("value IS NOT NULL"), "value", table(spark, sf_dir, "places"), "place_id").select("src", "rec_id", "pos", "place_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = test_items(table(spark, sf_dir, "eval_items"), "item_id", "item_text")
    return leaks(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), "doc_id", "text", items).distinct()


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a span, and how many characters stay."""
    items = test_items(table(spark, sf_dir, "eval_items"), "item_id", "item_text")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").distinct()
    left = cleaned(docs.select(F.struct("doc_id", F.length("text").alias("n")).alias("d"), "text"), "d", "text", items)
    return left.select("doc_id.doc_id", F.col("doc_id.n").alias("n_before"), F.length("text").alias("n_left")).where("n_left < n_before")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "board_token").select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates, and by what it shows."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("fetched_at", "text", "source", "board_token")).alias("d")).select("doc_id", "d.*")
    return truncation_by_source(docs, cut_texts(docs, "doc_id", "text", "source", "board_token"), "source")


#: Tokens that a container holds.
CONTAINER = 2048


def p7_containers(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", token_counts(F.col("text"), tokenizer).alias("size"))
    return pack(sizes, "doc_id", "size", CONTAINER).select(F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), "n_tokens", F.col("container").alias("container_id"))


QUERIES = {name: value for name, value in dict(globals()).items() if name[0] == "p" and name[1:2].isdigit()}
ORACLES: dict[str, str] = {}
