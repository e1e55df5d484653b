"""Words of company names, slugs and hosts, and where texts mention a company."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contains_phrase, normalize

# Legal forms that end a company's name.
LEGAL_FORMS = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "sa", "plc", "ag", "bv", "pbc", "lp", "llp", "pty"]
# Host labels that name a part of a site.
SITE_LABELS = ["www", "careers", "career", "jobs", "job", "apply", "work", "hire", "talent", "join", "co", "com", "org", "net"]


def name_words(name: Column) -> Column:
    """Normalised words without a leading "the" and trailing legal forms; at least one word stays."""
    bare = F.regexp_replace(normalize(name), "^the( |$)", "")
    return F.filter(F.split(F.regexp_replace(bare, f"( ({'|'.join(LEGAL_FORMS)}))+$", ""), " "), lambda w: w != "")


def slug_variants(name: Column) -> Column:
    """The words joined, and joined with hyphens; ASCII names of 2 to 60 letters only."""
    words = name_words(name)
    both = F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-")))
    return F.filter(both, lambda s: s.rlike("^[\\x00-\\x7F]{2,60}$"))


def names_match(a: Column, b: Column) -> Column:
    joined = F.array_join(name_words(a), "")
    return (joined != "") & (joined == F.array_join(name_words(b), ""))


def host_company(host: Column) -> Column:
    """The rightmost label, the top domain aside, that is longer than two letters and no part of a site."""
    labels = F.split(host, r"\.")
    return F.try_element_at(F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (F.length(x) > 2) & ~x.isin(SITE_LABELS)), F.lit(-1))


def mentions_words(description: Column, first: str, second: str) -> Column:
    """Whether a description has the first two words of a longer name next to each other."""
    return contains_phrase(normalize(description), f"{first} {second}")


#: What stands before a word that opens a sentence or an item, and what makes such a word a subject all the same.
_OPENS = re.compile(r"(?:^|[.!?:•–—-][\s*_]*|[\n\"“‘'(\[][\s\"“‘'(\[*_]*)$")
_SUBJECT = re.compile(r"[*_]*(?: is | was |['’]s )")


def names_word(text: str | None, word: str | None) -> bool:
    """Whether a text has the word as a name: whole, with a capital, and not only because a sentence or an item opens with it."""
    if not text or not word:
        return False
    for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text, re.I):
        before = text[max(0, m.start() - 40) : m.start()]
        if m[0] != m[0].lower() and (not _OPENS.search(before) or _SUBJECT.match(text, m.end())):
            return True
    return False


def mentions_company(description: Column, name: Column) -> Column:
    """Whether a description mentions the company: the first two words of its name together, or its only word as a name."""

    @F.pandas_udf("boolean")
    def alone(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([names_word(t, w) for t, w in zip(texts, words)], dtype=bool)

    words = name_words(name)
    both = F.concat(F.lit(" "), normalize(description), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(F.slice(words, 1, 2), " "), F.lit(" ")))
    return F.coalesce(F.when(F.size(words) >= 2, both).when(F.size(words) == 1, alone(description, F.get(words, F.lit(0)))), F.lit(False))
