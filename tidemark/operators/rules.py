"""Tri-state rules: each check passes, fails or stays unknown, each with a reason.

A rule gives a check struct or null (no check). A record passes unless a hard check fails.
Everything is a column expression, so predicates reach the scan where they can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contains_phrase, first_phrase

# Verdicts from worst to best.
VERDICTS = ["fail", "unknown", "pass"]


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def check(name: str, hard: bool, verdict: Column, detail: Column | str = "") -> Column:
    """A check struct; null where the verdict is null."""
    reason = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(verdict.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(hard).alias("hard"), verdict.alias("verdict"), reason.alias("detail")))


def outcome(*checks: Column) -> Column:
    """struct<passed, checks>: the checks that apply, in the order given."""
    applied = F.array_compact(F.array(*checks))
    return F.struct((~F.exists(applied, lambda c: c["hard"] & (c["verdict"] == "fail"))).alias("passed"), applied.alias("checks"))


def tri(condition: Column) -> Column:
    """pass, fail or, for null, unknown."""
    return F.when(condition.isNull(), "unknown").when(condition, "pass").otherwise("fail")


def best_of(verdicts: Column) -> Column:
    """The best verdict in an array; unknown for an empty or null one."""
    ranks = F.array_max(F.transform(verdicts, rank))
    return F.coalesce(F.get(F.array(*map(F.lit, VERDICTS)), (ranks - 1).cast("int")), F.lit("unknown"))


def keywords(normalized: Column, require_any: list[str], exclude: list[str]) -> Column:
    """fail on an excluded phrase, then pass on a required one; exclusion wins. Nothing required passes."""
    excluded = F.lit(False)
    for p in exclude:
        excluded = excluded | contains_phrase(normalized, p)
    wanted = F.lit(not require_any)
    for p in require_any:
        wanted = wanted | contains_phrase(normalized, p)
    return F.when(normalized.isNull(), "unknown").when(excluded, "fail").when(wanted, "pass").otherwise("fail")


def titled(normalized: Column, targets: list[str], exclude: list[str]) -> tuple[Column, Column]:
    """(verdict, the phrase that decided it)."""
    bad, good = first_phrase(normalized, exclude), first_phrase(normalized, targets)
    verdict = F.when(bad.isNotNull(), "fail").when(good.isNotNull(), "pass")
    return (verdict.otherwise("fail") if targets else verdict), F.coalesce(bad, good)


def fresh(seconds: Column, now: int, max_days: int) -> Column:
    """Age in whole days, never negative, against a limit."""
    age = F.when(seconds.isNotNull(), F.floor(F.greatest(F.lit(0).cast("bigint"), F.lit(now).cast("bigint") - seconds) / 86400))
    return tri(age <= max_days)
