"""Which paths a list of allow and disallow patterns leaves open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """A path pattern ('*' for anything, '$' at the end for the end, else a beginning) as a regex."""
    end = pattern.endswith("$")
    return "^" + ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else "")


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(pattern_regex(pattern)) if pattern else F.lit(False)


def allowed(paths: DataFrame, path: str, rules: list[tuple[bool, str]]) -> DataFrame:
    """paths with ``allowed``: the longest matching pattern decides, allow wins a tie, no match is open."""
    hits = F.array_compact(F.array(*[F.when(matches(F.col(path), p), F.struct(F.lit(len(p)).alias("n"), F.lit(ok).alias("ok"))) for ok, p in rules])) if rules else F.array()
    return paths.withColumn("allowed", F.coalesce(F.array_max(hits)["ok"], F.lit(True)) if rules else F.lit(True))
