"""Rollups over answers, labels and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States that count as covered.
COVERED = ["answered", "declined", "not_applicable", "composable"]


def harvest(labels: DataFrame, group: Column, label: Column, normalized: Column, order: Column, board: Column, record: Column) -> DataFrame:
    """Per group and normalised label: the first text, and how many boards and records asked it; empty labels dropped."""
    rows = labels.select(group.alias("group"), label.alias("label"), normalized.alias("normalized"), order.alias("at"), board.alias("board"), record.alias("record")).where("normalized <> ''")
    return rows.groupBy("group", "normalized").agg(F.min_by("label", "at").alias("first_label"), F.count_distinct("board").alias("boards"), F.count_distinct("board", "record").alias("records"))


def coverage(states: DataFrame, state: str, weight: str, always: Column, section: str, pack: str) -> DataFrame:
    """section, pack (null where totalled): counts, weights and the covered share of what isn't always asked."""
    rows = states.select(F.col(section).alias("section"), F.col(pack).alias("pack"), F.col(weight).alias("weight"), F.col(state).isin(COVERED).alias("covered"), always.alias("always"))
    counted = F.when(~F.col("always"), F.col("weight")).otherwise(0)
    out = rows.groupingSets([[], ["section"], ["pack"]], "section", "pack").agg(
        F.grouping_id().alias("level"), F.count("*").alias("questions"), F.count_if("covered").alias("covered"), F.sum(counted).alias("weight"), F.sum(F.when(F.col("covered"), counted).otherwise(0)).alias("covered_weight")
    )
    return out.withColumn("share", F.try_divide("covered_weight", "weight"))


# The states of a question.
STATES = ["answered", "suggested", "declined", "always_ask", "not_applicable", "missing", "composable"]
# The state that a policy sets.
POLICIES = {"decline": "declined", "always_ask": "always_ask", "not_applicable": "not_applicable"}


def state_of(policy: Column, items: Column, verified: Column, least: Column, default_policy: Column) -> Column:
    """Where a question stands: its policy, then what is stored, then its default policy, then missing.

    items, verified: stored entries and those of them verified (1 and 0 or 1 for a single value); null where nothing is stored.
    """
    set_by = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in POLICIES.items() for x in kv]), p)
    stored = F.when(verified >= F.greatest(least, F.lit(1)), "answered").when(items > 0, "suggested")
    return F.coalesce(set_by(policy), stored, set_by(default_policy), F.lit("missing"))


def compose(states: DataFrame, id_: str, state: str, draws_on: DataFrame) -> DataFrame:
    """states with 'composable' for missing questions of which an entry in draws_on (id, entry) matches an answered one."""
    met = prefix_matches(draws_on.select("entry"), "entry", states.where(F.col(state) == "answered"), id_).select("entry").distinct()
    able = draws_on.join(met, "entry", "left_semi").select(F.col("id").alias(id_)).distinct().withColumn("_able", F.lit(True))
    changed = F.when((F.col(state) == "missing") & F.col("_able"), "composable").otherwise(F.col(state))
    return states.join(able, id_, "left").withColumn(state, changed).drop("_able")


def tally(states: DataFrame, state: str, group: list[str]) -> DataFrame:
    """How many questions of a group stand in each state; a column per state."""
    return states.groupBy(*group).agg(*[F.count_if(F.col(state) == s).alias(s) for s in STATES], F.count("*").alias("questions"))


def top_missing(states: DataFrame, id_: str, state: str, weight: str, n: int = 10) -> DataFrame:
    """The heaviest missing questions, a report of n rows."""
    return states.where(F.col(state) == "missing").select(id_, weight).orderBy(F.col(weight).desc_nulls_last(), id_).limit(n)


def unknown_paths(stored: DataFrame, path: str, known: DataFrame, id_: str) -> DataFrame:
    """Stored paths that no question defines."""
    return stored.where(F.col(path).isNotNull()).join(known.select(F.col(id_).alias(path)).distinct(), path, "left_anti")


def intake(questions: DataFrame, id_: str, rank: str) -> DataFrame:
    """The questions that are asked first, in their order."""
    return questions.where(F.col(rank).isNotNull()).orderBy(rank, id_)


def first_rule(rows: DataFrame, value: str, rules: DataFrame) -> DataFrame:
    """rows with the outcome of the first rule (by position) whose ``equals`` is the row's value; null where none is.

    rules: position, equals, outcome; a rule list is written by hand, so its size doesn't follow the rows.
    """
    first = rules.groupBy("equals").agg(F.min_by("outcome", "position").alias("outcome"))
    return rows.join(F.broadcast(first), rows[value] == first["equals"], "left").drop("equals")


def prefix_matches(entries: DataFrame, entry: str, ids: DataFrame, id_: str) -> DataFrame:
    """entry, id for every id that is the entry, or begins with it where the entry ends in ".*".

    Each id is met by its own dotted prefixes, an equi-join instead of a comparison of all pairs.
    """
    parts = F.split(F.col(id_), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "."), F.when(k < F.size(parts), ".*").otherwise("")))
    return entries.select(entry).distinct().join(ids.select(F.explode(prefixes).alias(entry), F.col(id_)), entry)
